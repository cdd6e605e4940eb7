"""HTML to text, links, metadata and rows: the standard library's parser inside Arrow functions and table functions."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from tidemark.functions.text import even, interest_labels


def _row(**fields: type) -> StructType:
    return StructType([StructField(k, v()) for k, v in fields.items()])

# Elements whose text is no content, the main part's names, what is no part of it, elements that end a
# line, elements without an end, elements that their like ends.
SKIPPED = {"script", "style", "nav", "footer", "header", "noscript", "template"}
MAIN = {"main", "article", "role=main", "#main-content", "#main", ".main-content", ".person-profile", ".profile-content"}
ASIDE = {"script", "style", "noscript", "template", "nav", "footer", "aside", "form", "role=banner", ".site-header", "#masthead", ".navigation", ".nav", ".menu", ".footer", ".breadcrumbs", ".breadcrumb", ".related-content", ".related-news"}
BLOCKS = {"p", "div", "br", "li", "ul", "ol", "tr", "td", "th", "table", "section", "article", "h1", "h2", "h3", "h4", "h5", "h6", "title", "dd", "dt"}
VOID = {"br", "img", "hr", "meta", "link", "input", "area", "base", "col", "source", "wbr"}
CLOSED = {"p", "li", "tr", "td", "th", "dd", "dt", "option"}


def only_references(html: Column, *names: str) -> Column:
    """The page with no references but the named ones, each with its semicolon; other ampersands stand for themselves.

    A parser reads a reference without its end too, so a text that was cut inside of one would change."""
    return F.regexp_replace(html, rf"&(?!(?:{'|'.join(names)});)", "&amp;")


def _names(tag: str, a: dict[str, str]) -> set[str]:
    """The element's tag, id, classes and role, as a style sheet would name them."""
    return {tag, f"#{a.get('id', '')}", f"role={a.get('role', '')}", *(f".{c}" for c in a.get("class", "").split())}


class _Nested(HTMLParser):
    """Keeps the open elements: an element without an end tag closes with its like or with what is around it."""

    def __init__(self, html: str) -> None:
        super().__init__(convert_charrefs=True)
        self._open: list[tuple[str, object]] = []
        self._there: Counter[str] = Counter()
        self.feed(html)
        self.close()
        while self._open:
            self._pop()

    def opened(self, tag: str, a: dict[str, str]) -> object:
        return None

    def ended(self, tag: str, mark: object) -> None:
        pass

    def _pop(self) -> str:
        tag, mark = self._open.pop()
        self._there[tag] -= 1
        self.ended(tag, mark)
        return tag

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        ends = ("tr", "td", "th") if tag == "tr" else (tag,) if tag in CLOSED else ()
        while self._open and self._open[-1][0] in ends:
            self._pop()
        mark = self.opened(tag, {k: v or "" for k, v in attrs})
        if tag not in VOID:
            self._open.append((tag, mark))
            self._there[tag] += 1

    def handle_endtag(self, tag: str) -> None:
        if self._there[tag]:
            while self._pop() != tag:
                pass


class Page(_Nested):
    """One pass over a page: text by blocks, links, metadata, and the blocks of the main part: the first element that is
    named so, else the whole page, without what is beside it."""

    def __init__(self, html: str) -> None:
        self.text: list[str] = []
        self.links: list[tuple[str, str]] = []
        self.blocks: list[tuple[str, str]] = []
        self.main: list[tuple[str, str]] = []
        self.meta: dict[str, str] = {}
        self.title = ""
        self._href: str | None = None
        self._label: list[str] = []
        self._buffer: list[str] = []
        self._own: list[str] = []
        self._tag = ""
        self._depth = Counter()  # open elements: "skip", "aside", "title"
        self._root = ""  # "": none yet, "open", "closed"
        super().__init__(html)
        self._end_block()

    def _end_block(self) -> None:
        t, own = (" ".join("".join(x).split()) for x in (self._buffer, self._own))
        if t:
            self.blocks.append((self._tag or "text", t))
            self.text.append(t)
        if own and self._root != "closed":
            self.main.append((self._tag or "text", own))
        self._buffer, self._own = [], []

    def opened(self, tag: str, a: dict[str, str]) -> object:
        if tag == "meta" and (name := a.get("name") or a.get("property")):
            self.meta.setdefault(name.lower(), a.get("content", ""))
        if tag == "a":
            self._href, self._label = a.get("href", ""), []
        names = _names(tag, a)
        root = not self._root and not self._depth["aside"] and bool(names & MAIN)
        if tag in BLOCKS or root:
            self._end_block()
            self._tag = tag if tag in BLOCKS else ""
        if root:
            self.main, self._root = [], "open"
        kinds = [k for k, held in (("skip", tag in SKIPPED), ("aside", bool(names & ASIDE)), ("title", tag == "title")) if held]
        if tag not in VOID:
            self._depth.update(kinds)
        return kinds, root

    def ended(self, tag: str, mark: object) -> None:
        kinds, root = mark
        if tag == "a" and self._href is not None:
            self.links.append((self._href, " ".join("".join(self._label).split())))
            self._href = None
        if tag in BLOCKS or root:
            self._end_block()
            self._tag = ""
        self._depth.subtract(kinds)
        if root:
            self._root = "closed"

    def handle_data(self, data: str) -> None:
        if self._depth["title"]:
            self.title += data
            return
        if self._href is not None:
            self._label.append(data)
        if not self._depth["skip"]:
            self._buffer.append(data)
        if not self._depth["aside"]:
            self._own.append(data)


@F.pandas_udf(StringType())
def page_text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The page's own text, a line per block, without navigation, scripts and the like."""
    for s in batches:
        yield s.map(lambda x: None if x is None else "\n".join(Page(x).text))


@F.pandas_udf(_row(title=StringType, description=StringType, author=StringType, doi=StringType, published=StringType))
def page_metadata(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """Title and the usual metadata, the citation's own fields first; null where there is none."""
    for s in batches:
        rows = []
        for x in s:
            p = Page(x or "")
            get = lambda *names, m=p.meta: next((m[n] for n in names if m.get(n)), None)
            doi = get("citation_doi", "dc.identifier", "doi")
            found = re.search(r"10\.\d{4,9}/[^\s\"<>]+", doi or "")
            rows.append((get("citation_title", "og:title") or p.title.strip() or None, get("description", "og:description"), get("citation_author", "author"), found[0] if found else None, get("citation_publication_date", "article:published_time", "date")))
        yield pd.DataFrame(rows, columns=["title", "description", "author", "doi", "published"])


_PERSON = re.compile(r"^[A-Z][\w.'-]+(?: [A-Z][\w.'-]*){1,4}$")
_TITLE = re.compile(r"(?i)\b(professor|lecturer|scientist|instructor|fellow)\b[^\n]*")
_MAIL = re.compile(r"[\w.+-]+@[\w-]+\.[\w.-]+")


@F.udtf(returnType=_row(name=StringType, title=StringType, email=StringType, profile_url=StringType), useArrow=True)
class Directory:
    """People of a directory page: a linked or bare name, and the title and address that follow before the next name."""

    def eval(self, html: str):
        p = Page(html or "")
        hrefs = {label: href for href, label in p.links if _PERSON.match(label)}
        person: list | None = None
        for _, text in p.blocks:
            if _PERSON.match(text) and len(text) <= 80:
                if person and person[1]:
                    yield tuple(person)
                person = [text, None, None, hrefs.get(text)]
            elif person:
                if not person[1] and _TITLE.search(text):
                    person[1] = text[:160]
                if not person[2] and (m := _MAIL.search(text)):
                    person[2] = m[0]
        if person and person[1]:
            yield tuple(person)


_YEAR = re.compile(r"\b((?:19|20)\d{2})\b")
_HEAD = re.compile(r"(?i)^(selected )?(publications?|papers|articles|books|research output)\b")


@F.udtf(returnType=_row(title=StringType, authors=StringType, year=IntegerType, doi=StringType, evidence=StringType), useArrow=True)
class Publications:
    """Works listed below a heading on publications: quoted titles, else the longest sentence."""

    def eval(self, html: str):
        inside = False
        for tag, text in Page(html or "").blocks:
            if tag in ("h1", "h2", "h3", "h4"):
                inside = bool(_HEAD.match(text))
            elif inside and (y := _YEAR.search(text)):
                quoted = re.search(r"[“\"]([^”\"]{12,})[”\"]", text)
                parts = [x.strip() for x in re.split(r"\.\s+|\(\d{4}\)\.?\s*", text) if x.strip()]
                title = quoted[1].rstrip(".,") if quoted else max(parts, key=len)
                doi = re.search(r"10\.\d{4,9}/[^\s\"<>]+", text)
                yield title, text.split(title)[0].strip(" .,“\"(") or None, int(y[1]), doi[0].rstrip(".") if doi else None, text[:400]


_PAIR = "array<struct<{}:string,{}:string>>"


def parse(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, title, main, blocks, links, meta) of every page, each parsed once in Arrow batches. ``main`` holds the blocks
    of the main part, all but those beside it where a page marks none; null pages are empty."""
    import pyarrow as pa

    kind = pages.schema[id_col].dataType.simpleString()
    two = lambda a, b: pa.list_(pa.struct([(a, pa.string()), (b, pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [Page(x or "") for x in b.column(1).to_pylist()]
            pairs = lambda rows, m, n: pa.array([[{m: x, n: y} for x, y in r] for r in rows], two(m, n))
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array([p.title.strip() or None for p in got], pa.string()),
                    pairs([p.main for p in got], "tag", "text"),
                    pairs([p.blocks for p in got], "tag", "text"),
                    pairs([p.links for p in got], "href", "label"),
                    pa.array([list(p.meta.items()) for p in got], pa.map_(pa.string(), pa.string())),
                ],
                [id_col, "title", "main", "blocks", "links", "meta"],
            )

    schema = f"`{id_col}` {kind}, title string, main {_PAIR.format('tag', 'text')}, blocks {_PAIR.format('tag', 'text')}, links {_PAIR.format('href', 'label')}, meta map<string,string>"
    return pages.select(id_col, html_col).mapInArrow(run, schema)


# Headings of sections on interests, on a life and on works.
INTERESTS = r"(?i)^(?:research|scholarly|academic)?\s*(?:interests?|areas?|expertise|specialt(?:y|ies)|research focus|areas? of interest|areas? of expertise)$"
LIFE = r"(?i)^(?:biography|bio|about(?: me)?|profile|professional background)$"
WORKS = r"(?i)\b(?:publications?|selected works?|research papers?)\b"


def section(blocks: Column, heading: str, most: int = 8000) -> Column:
    """The items and paragraphs below the first heading that matches, up to the next heading of its level or above, a
    line each; '' where there is none."""
    level = lambda b: F.when(b["tag"].rlike("^h[1-6]$"), F.right(b["tag"], F.lit(1)).cast("int"))
    at = F.array_position(F.transform(blocks, lambda b: F.coalesce(level(b) > 0, F.lit(False)) & F.regexp_replace(b["text"], r"^[ :]+|[ :]+$", "").rlike(heading)), True).cast("int")
    head = F.get(blocks, at - 1)
    after = F.slice(blocks, at + 1, F.size(blocks))
    ends = F.array_position(F.transform(after, lambda b: F.coalesce(level(b) <= level(head), F.lit(False))), True)
    own = F.filter(F.when(ends > 0, F.slice(after, 1, (ends - 1).cast("int"))).otherwise(after), lambda b: b["tag"].isin("li", "p", "dd"))
    return F.when(at > 0, F.left(F.array_join(F.transform(own, lambda b: b["text"]), "\n"), F.lit(most))).otherwise("")


def interests(blocks: Column) -> Column:
    """The labels of the page's section on research interests."""
    return interest_labels(section(blocks, INTERESTS))


def biography(blocks: Column) -> Column:
    """The section on the person's life; without one of 80 characters, the page's substantial paragraphs."""
    told = section(blocks, LIFE, 16000)
    whole = F.filter(blocks, lambda b: (b["tag"] == "p") & F.length(b["text"]).between(80, 3000) & ~F.left(b["text"], F.lit(100)).rlike(WORKS))
    return F.when(F.length(told) >= 80, told).otherwise(F.left(F.array_join(F.transform(whole, lambda b: b["text"]), "\n"), F.lit(16000)))


def profile_signals(blocks: Column, name: Column) -> Column:
    """struct<aliases, titles>: the name with short headings that may be other spellings of it, and the entries below a
    heading on works (20 to 350 characters, 25 at most)."""
    heads = F.transform(F.slice(F.filter(blocks, lambda b: b["tag"].isin("h1", "h2")), 1, 5), lambda b: b["text"])
    short = F.filter(heads, lambda h: F.size(F.split(h, " ")).between(2, 7) & ~h.rlike(r"(?i)\b(professor|lecturer|instructor|faculty)\b"))
    works = F.filter(F.split(section(blocks, WORKS, 16000), "\n"), lambda x: F.length(x).between(20, 350))
    return F.struct(F.slice(F.array_distinct(F.concat(F.array(even(name)), short)), 1, 8).alias("aliases"), F.slice(F.array_distinct(works), 1, 25).alias("titles"))


class _Classed(_Nested):
    """Texts of elements with one of the wanted classes or ids, in order; (class, None) marks a row's start."""

    def __init__(self, html: str, wanted: set[str], marks: set[str]) -> None:
        self.found: list[list] = []
        self._wanted, self._marks = wanted, marks
        super().__init__(html)

    def opened(self, tag: str, a: dict[str, str]) -> object:
        names = {*a.get("class", "").split(), a.get("id", "")}
        for m in names & self._marks:
            self.found.append([m, None])
        hit = next(iter(names & self._wanted), None)
        if tag in VOID or not hit:
            return None
        self.found.append([hit, ""])
        return self.found[-1]

    def handle_data(self, data: str) -> None:
        for _, own in self._open:
            if own is not None:
                own[1] += data


@F.udtf(returnType=_row(name=StringType, affiliation=StringType, verified_email=StringType, title=StringType, authors=StringType, venue=StringType, year=IntegerType), useArrow=True)
class ScholarProfile:
    """A row per work of a saved scholar profile, with the profile's name, affiliation and verified mail."""

    def eval(self, html: str):
        found = _Classed(html or "", {"gsc_prf_in", "gsc_prf_il", "gsc_a_at", "gs_gray", "gsc_a_y"}, {"gsc_a_tr"}).found
        name, details, works = "", [], []
        for kind, text in found:
            t = " ".join((text or "").split())
            if kind == "gsc_prf_in":
                name = name or t
            elif kind == "gsc_prf_il":
                details.append(t)
            elif kind == "gsc_a_tr":
                works.append({"gray": []})
            elif works and kind == "gs_gray":
                works[-1]["gray"].append(t)
            elif works:
                works[-1].setdefault(kind, t)
        mail = next((d for d in details if "verified email" in d.lower()), None)
        for w in works:
            if w.get("gsc_a_at"):
                y = _YEAR.search(w.get("gsc_a_y", ""))
                yield name, (details or [None])[0], mail, w["gsc_a_at"], (w["gray"] or [None])[0], w["gray"][1] if len(w["gray"]) > 1 else None, int(y[1]) if y else None


class _Rows(_Nested):
    """Tables as lists of rows, a row as a list of cells [text, links]. Grids of a page builder count as tables: the rows
    carry an id, the columns a class, and the labels stand in a row of titles or in a row before the grid."""

    def __init__(self, html: str) -> None:
        self.tables: list[list[list]] = []
        self._grids: list[list[list]] = []
        self._header: list = []
        self._since = 0
        super().__init__(html)

    def _around(self, *kinds: str) -> tuple | None:
        return next((m for _, m in reversed(self._open) if m and m[0] in kinds), None)

    def opened(self, tag: str, a: dict[str, str]) -> object:
        names = _names(tag, a)
        top = self._open[-1][1] if self._open else None
        if tag == "table":
            self.tables.append([])
            return "table", self.tables[-1]
        if ".js-wpv-view-layout" in names:
            self.tables.append(grid := [])
            return "grid", grid
        if tag == "a" and a.get("href"):
            return "link", [a["href"], ""]
        if tag == "tr" and self._around("table"):
            return "row", []
        if self._around("grid"):
            if {".row", ".titles"} <= names:
                return "titles", []
            if names & {"#profile-inside-row", "#profile_row"}:
                return "row", []
        elif ".vc_row" in names:
            return "loose", []
        cell = top and (
            (top[0] == "titles" and tag == "div") or (top[0] in ("row", "loose") and (tag in ("td", "th") or ".vc_column_container" in names))
        )
        if cell:
            top[1].append(made := ["", []])
            return "cell", made
        return None

    def ended(self, tag: str, mark: object) -> None:
        if not mark:
            return
        kind, held = mark
        if kind == "link":
            for _, m in self._open:
                if m and m[0] == "cell":
                    m[1][1].append((held[0], " ".join(held[1].split())))
        if kind == "loose":
            said = {" ".join(c[0].split()).lower() for c in held}
            self._since += 1
            if "name" in said and said & {"title", "position"}:
                self._header, self._since = held, 0
        home = self._around("table", "grid") if kind in ("row", "titles") else None
        if home:
            if home[0] == "grid" and kind == "row" and not home[1] and self._since < 20:
                home[1].append(self._header)
            if home[0] == "table" or kind == "titles" or len(held) == len(home[1][0] if home[1] else []):
                home[1].append(held)

    def handle_data(self, data: str) -> None:
        for _, m in self._open:
            if m and m[0] == "cell":
                m[1][0] += data + " "
            elif m and m[0] == "link":
                m[1][1] += data


# What the columns of a roster are called, and labels of links to a person's own page.
COLUMNS = {
    "title": lambda h: h in ("title", "position", "rank", "role"),
    "office": lambda h: "office" in h and "phone" not in h,
    "section": lambda h: "department" in h or h in ("program", "dept/office"),
    "interests": lambda h: h in ("expertise", "areas of expertise") or h == "research" or h.startswith("research "),
}
OWN_PAGE = re.compile(r"(?i)\b(?:view|meet|profile|bio)\b")


def _members(rows: list[list], url: str, least: int) -> Iterator[dict[str, str]]:
    """People of one table whose first row names its columns; a row without a link to a page is nobody's."""
    heads = [" ".join(c[0].split()).lower() for c in rows[0]] if len(rows) >= least else []
    at = {h: heads.index(h) for h in ("name", "first name", "last name") if h in heads}
    named = [at["name"]] if "name" in at else [at[h] for h in ("first name", "last name") if h in at]
    if not named or ("name" not in at and len(named) < 2):
        return
    place = {k: next((i for i, h in enumerate(heads) if f(h)), None) for k, f in COLUMNS.items()}
    for cells in rows[1:]:
        if max(named) >= len(cells):
            continue
        text = [" ".join(c[0].split()) for c in cells]
        every = [x for c in cells for x in c[1]]
        links = [x for x in every if not x[0].lower().startswith(("mailto:", "tel:")) and "/cdn-cgi/" not in x[0] and x[0] != "#"]
        if not links:
            continue
        own = [x for x in cells[at["name"]][1] if x in links] if "name" in at else []
        chosen = (own or [x for x in links if OWN_PAGE.search(x[1])] or links[-1:])[0]
        mails = [x[0][7:].split("?", 1)[0] for x in every if x[0].lower().startswith("mailto:")]
        got = {k: text[i] if i is not None and i < len(text) else "" for k, i in place.items()}
        yield {"name": " ".join(text[i] for i in named).strip(), **got, "email": mails[0] if mails else "", "profile_url": urljoin(url, chosen[0]), "card": " | ".join(text)}


MEMBER = ("name", "title", "office", "section", "interests", "email", "profile_url", "card")


def roster_tables(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", url_col: str = "url", least: int = 4) -> DataFrame:
    """(id, url, name, title, office, section, interests, email, profile_url, card): a row per person of the tables and
    grids of every page with at least ``least`` rows, the header included; '' for what a table doesn't tell."""
    import pyarrow as pa

    kind = pages.schema[id_col].dataType.simpleString()
    person = pa.list_(pa.struct([(m, pa.string()) for m in MEMBER]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [[m for t in _Rows(h or "").tables if t for m in _members(t, u or "", least)] for h, u in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(found, person)], ["id", "url", "m"])

    df = pages.select(id_col, html_col, url_col).mapInArrow(run, f"id {kind}, url string, m array<struct<{','.join(f'{m}:string' for m in MEMBER)}>>")
    return df.select(F.col("id").alias(id_col), "url", F.inline("m"))
