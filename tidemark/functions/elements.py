"""Pages as trees of elements: one Arrow pass gives every element its place, and what follows is native.

Elements are numbered in the order in which they begin; ``last`` is the number of the last one inside, so "b lies inside
a" is ``a.i < b.i <= a.last``, and a section is an interval. The page's text is one string, and an element's text the part
of it between ``a`` and ``z``.

Null and empty pages have no elements. Scripts, styles and templates have no text; a script's own data is ``raw``.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import word_rules as W
from tidemark.functions.html import VOID, _Nested
from tidemark.functions.text import bound, even

ELEMENT = "i int, last int, parent int, depth int, tag string, classes array<string>, attrs map<string,string>, a int, z int, raw string"
TREE = f"struct<said:string,tree:array<struct<{', '.join(x.replace(' ', ':', 1) for x in ELEMENT.split(', '))}>>>"
_FIELDS = [("i", pa.int32()), ("last", pa.int32()), ("parent", pa.int32()), ("depth", pa.int32()), ("tag", pa.string()), ("classes", pa.list_(pa.string())), ("attrs", pa.map_(pa.string(), pa.string())), ("a", pa.int32()), ("z", pa.int32()), ("raw", pa.string())]
SILENT = {"script", "style", "noscript", "template"}


class Tree(_Nested):
    def __init__(self, html: str) -> None:
        self.rows: list[dict] = []
        self.said: list[str] = []
        self.size = 0
        super().__init__(html)

    def _say(self, data: str) -> None:
        self.said.append(data)
        self.size += len(data)

    def opened(self, tag: str, a: dict[str, str]) -> object:
        self._say(" ")
        parent = self._open[-1][1] if self._open else -1
        i = len(self.rows)
        self.rows.append({"i": i, "last": i, "parent": parent, "depth": len(self._open), "tag": tag, "classes": a.get("class", "").split(), "attrs": list(a.items()), "a": self.size, "z": self.size, "raw": None})
        return i

    def ended(self, tag: str, mark: object) -> None:
        self.rows[mark]["last"], self.rows[mark]["z"] = len(self.rows) - 1, self.size
        if tag not in VOID:
            self._say(" ")

    def handle_data(self, data: str) -> None:
        if self._open and self._open[-1][0] in SILENT:
            if self._open[-1][0] == "script":
                row = self.rows[self._open[-1][1]]
                row["raw"] = (row["raw"] or "") + data
            return
        self._say(data)


def tree(html: Column) -> Column:
    """struct<said, tree>: a page's text and its elements."""
    return F.arrow_udf(_tree, TREE)(html)


def _tree(html: pa.Array) -> pa.Array:
    out = []
    for h in html.to_pylist():
        t = Tree(h or "")
        out.append({"said": "".join(t.said), "tree": t.rows})
    return pa.array(out, pa.struct([("said", pa.string()), ("tree", pa.list_(pa.struct(_FIELDS)))]))


def planted(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` with ``said`` and ``tree`` beside their columns."""
    return pages.withColumn("__t", tree(F.col(html))).select("*", F.col("__t.said").alias("said"), F.col("__t.tree").alias("tree")).drop("__t")


def exploded(trees: DataFrame, *keep: str) -> DataFrame:
    """One row per element of ``planted`` pages: the columns to keep, the element's fields and its ``text``."""
    rows = trees.select(*keep, "said", F.explode("tree").alias("e"))
    return rows.select(*keep, "e.*", text_of(F.col("said"), F.col("e")).alias("text"))


def text_of(said: Column, e: Column) -> Column:
    return even(F.substring(said, e["a"] + 1, e["z"] - e["a"]))


def attr(e: Column, name: str) -> Column:
    return F.try_element_at(e["attrs"], F.lit(name))


def first_of(tree_: Column, *tests) -> Column:
    """Of the elements that meet the first test that any meets, the first value that is not blank; tests give a value or
    null."""
    values = [F.get(F.filter(F.transform(tree_, t), lambda v: F.trim(F.coalesce(v, F.lit(""))) != ""), F.lit(0)) for t in tests]
    return F.coalesce(*values)


def meta(key: str, value: str):
    """The content of a ``meta`` element that has the attribute."""
    return lambda e: F.when((e["tag"] == "meta") & (F.lower(attr(e, key)) == value), attr(e, "content"))


# Where a page says when it was published, in order, and its title, abstract and DOI.
DATES = (meta("property", "article:published_time"), meta("name", "date"), meta("name", "dcterms.date"), meta("itemprop", "datepublished"), lambda e: F.when(e["tag"] == "time", attr(e, "datetime")))
TITLES = (meta("name", "citation_title"), meta("property", "og:title"))
ABSTRACTS = (meta("name", "citation_abstract"), meta("name", "dc.description"), meta("name", "description"), meta("property", "og:description"))
DOIS = (meta("name", "citation_doi"), meta("name", "dc.identifier"))


def metadata(trees: DataFrame, *keep: str) -> DataFrame:
    """(keep, title, abstract, doi) of ``planted`` pages: ``meta`` elements by their order, then the page's title, then the
    objects of ``ld+json`` scripts, alone or in a list, in the order in which they stand.

    The scripts are parsed as variants; what is no JSON, and what in a list is no object, says nothing.
    """
    raw = F.filter(F.transform("tree", lambda e: F.when((e["tag"] == "script") & (F.lower(attr(e, "type")) == "application/ld+json"), e["raw"])), lambda x: x.isNotNull())
    title_tag = F.get(F.filter("tree", lambda e: e["tag"] == "title"), F.lit(0))
    known = trees.select(*keep, first_of(F.col("tree"), *TITLES).alias("t"), even(text_of(F.col("said"), title_tag)).alias("page_title"), first_of(F.col("tree"), *ABSTRACTS).alias("a"), first_of(F.col("tree"), *DOIS).alias("d"), raw.alias("raw"))
    scripts = known.select(*keep, F.posexplode("raw").alias("n", "s")).withColumn("v", F.try_parse_json("s")).where("v IS NOT NULL")
    listed = scripts.withColumn("list", F.try_variant_get("v", "$", "array<variant>"))
    objects = listed.select(*keep, "n", F.posexplode(F.coalesce("list", F.array("v"))).alias("m", "o")).where(F.schema_of_variant("o").startswith("OBJECT"))
    say = lambda *names: F.coalesce(*[F.nullif(F.try_variant_get("o", f"$.{x}", "string"), F.lit("")) for x in names])
    objects = objects.select(*keep, "n", "m", say("headline", "name").alias("lt"), say("abstract", "description").alias("la"), say("doi").alias("ld"))
    best = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct("n", "m", c)))[c].alias(c)
    said = objects.groupBy(*keep).agg(best("lt"), best("la"), best("ld"))
    j = known.join(said, list(keep), "left")
    pick = lambda most, *cols: F.left(F.coalesce(*[F.nullif(even(F.col(c)), F.lit("")) for c in cols], F.lit("")), F.lit(most))
    return j.select(*keep, pick(1000, "t", "page_title", "lt").alias("title"), pick(20000, "a", "la").alias("abstract"), pick(300, "d", "ld").alias("doi"))


def inside(tree_: Column, e: Column, *tags: str) -> Column:
    """Does the element lie in one of these?"""
    return F.exists(tree_, lambda x: x["tag"].isin(*tags) & (x["i"] < e["i"]) & (e["i"] <= x["last"]))


def headings(said: Column, tree_: Column) -> Column:
    """The page's headings h1 to h6 in order: array<struct<at, level, heading, spaced>>, ``spaced`` being its bare words."""
    head = lambda e, t: F.struct(e["i"].alias("at"), F.right(e["tag"], F.lit(1)).cast("int").alias("level"), t.alias("heading"), W.bare(t).alias("spaced"))
    return F.transform(F.filter(tree_, lambda e: e["tag"].rlike("^h[1-6]$")), lambda e: bound(text_of(said, e), lambda t: head(e, t)))


def sections(heads: Column, wanted: list[str], unwanted: list[str], categories: list[str]) -> Column:
    """array<struct<start, stop>>: sections under ``headings`` h1 to h5 that hold a wanted phrase and no unwanted one.

    A section ends before the next heading of its level or above, or before one a level below that is neither wanted nor
    a category.
    """
    says = lambda h: W.within(h["spaced"], wanted)
    belongs = lambda h: says(h) | F.trim(h["spaced"]).isin(*categories)
    own = F.filter(heads, lambda h: (h["level"] < 6) & says(h) & ~W.within(h["spaced"], unwanted))
    ends = lambda o, h: (h["at"] > o["at"]) & ((h["level"] <= o["level"]) | ((h["level"] == o["level"] + 1) & ~belongs(h)))
    stop = lambda o: F.coalesce(F.get(F.filter(heads, lambda h: ends(o, h)), F.lit(0))["at"], F.lit(2**31 - 1))
    return F.transform(own, lambda o: F.struct(o["at"].alias("start"), stop(o).alias("stop")))


# Headings over works, headings that only look so, and kinds of works that divide a list.
WORKS = ["publication", "publications", "papers", "articles", "selected works", "recent works", "bibliography", "books"]
NO_WORKS = ["students", "talks", "patents"]
KINDS = ["journal articles", "conference papers", "book chapters", "books", "preprints", "edited volumes", "working papers"]


def works(trees: DataFrame, *keep: str) -> DataFrame:
    """(keep, i, year, doi, title, authors, venue, entry): list items and paragraphs under headings over works. A page is
    parsed once and worked out in its own row: nothing is joined or shuffled.

    An entry in several nested sections counts once. A year that a heading between states dates the entries below it. The
    title stands in quotation marks or in an emphasised part of its own, else behind "(year)." as authors, year, title,
    venue.
    """
    said, text = F.col("said"), lambda e: text_of(F.col("said"), e)
    page = trees.select(*keep, "said", "tree", headings(said, F.col("tree")).alias("heads"))
    dated = F.filter("heads", lambda h: (h["level"] >= 2) & h["heading"].rlike(r"^(?:19|20)\d\d$"))
    page = page.select("*", sections(F.col("heads"), WORKS, NO_WORKS, KINDS).alias("own"), dated.alias("dated"))
    held = F.filter("tree", lambda e: e["tag"].isin("li", "p") & F.exists("own", lambda o: (e["i"] > o["start"]) & (e["i"] < o["stop"])))
    entries = F.filter(F.transform(held, lambda e: F.struct(e["i"].alias("i"), e["last"].alias("last"), text(e).alias("entry"))), lambda e: F.length(e["entry"]) >= 12)
    page = page.select(*keep, "said", "tree", "dated", entries.alias("entries"))
    # Innermost entries only: an item around other items is no entry, and the first of these comes next to it.
    inner = F.filter("entries", lambda e, k: F.coalesce(F.get("entries", k + 1)["i"] > e["last"], F.lit(True)))
    # What lies inside an element stands behind it in the tree.
    marks = lambda e: F.filter(F.slice("tree", e["i"] + 2, e["last"] - e["i"]), lambda x: x["tag"].isin("em", "i", "cite", "strong", "b", "a"))
    mark = lambda e: F.get(F.filter(F.transform(marks(e), text), lambda t: F.length(t) >= 8), F.lit(0))
    stated = lambda e: F.try_element_at(F.filter("dated", lambda h: h["at"] < e["i"]), F.lit(-1))["heading"].cast("int")
    rows = F.transform(inner, lambda e: F.struct(e["i"].alias("i"), e["entry"].alias("entry"), mark(e).alias("mark"), stated(e).alias("stated")))
    under = page.select(*keep, F.inline(rows))
    e = F.col("entry")
    cited = lambda k: F.nullif(F.trim(F.regexp_extract(e, r"^([^()]{3,600}?)\s*\(((?:19|20)\d\d)[a-z]?\)\.\s*([^.]+)\.\s*(.*)$", k)), F.lit(""))
    quoted = F.nullif(F.regexp_extract(e, r"[“\x22]([^”\x22]{8,}?)[.,]?[”\x22]", 1), F.lit(""))
    year = F.coalesce(cited(2), F.nullif(F.regexp_extract(e, r"\b((?:19|20)\d\d)\b(?!.*\b(?:19|20)\d\d\b)", 1), F.lit(""))).cast("int")
    doi = F.rtrim(F.regexp_extract(e, r"(?i)\b(10\.\d{4,9}/[^\s<>\"]+)", 1), F.lit(".,;)"))
    return under.select(*keep, "i", F.coalesce(year, "stated").alias("year"), doi.alias("doi"), F.coalesce(quoted, cited(3), "mark", e).alias("title"), cited(1).alias("authors"), cited(4).alias("venue"), "entry")


def cards(trees: DataFrame, role: str, *keep: str) -> DataFrame:
    """(keep, i, name, title, href, email): people on cards, the innermost elements that hold a heading or a linked name, a
    line with a role, and at most one such name.

    A card is found from its name: the nearest element around the name that also holds a line with a role, if no other
    name lies in it. ``role`` is an expression for what a role says.
    """
    items = exploded(trees, *keep)
    named = items.where(F.col("tag").isin("h2", "h3", "h4", "h5", "h6", "strong", "a")).where(F.col("text").rlike(r"^\p{Lu}[\w'’.-]+(?: [\w'’.-]+){0,3} \p{Lu}[\w'’-]+$") & ~F.col("text").rlike(role))
    named = named.select(*keep, F.col("i").alias("ni"), F.col("text").alias("name"))
    roles = items.where(F.col("tag").isin("p", "span", "div", "li", "td", "dd") & (F.length("text") <= 160) & F.col("text").rlike(role)).select(*keep, F.col("i").alias("ri"), F.col("last").alias("rlast"), F.regexp_extract("text", role, 0).alias("title"))
    around = items.where(F.col("tag").isin("div", "li", "article", "section", "tr", "td")).select(*keep, "i", "last", "depth")
    pairs = around.join(named, list(keep)).where("ni > i AND ni <= last").join(roles, list(keep)).where("ri > i AND rlast <= last AND NOT (ni > ri AND ni <= rlast)")
    one = pairs.groupBy(*keep, "i", "last", "depth").agg(F.count_distinct("name").alias("n"), F.min(F.struct("ni", "name"))["name"].alias("name"), F.min(F.struct("ri", "title"))["title"].alias("title")).where("n = 1")
    links = items.where("tag = 'a'").select(*keep, F.col("i").alias("li"), F.try_element_at("attrs", F.lit("href")).alias("href"))
    mail = F.col("href").startswith("mailto:")
    same = [F.col(c) == F.col(f"of_{c}") for c in keep]
    links = links.select(*[F.col(c).alias(f"of_{c}") for c in keep], "li", "href")
    kinds = (("href", ~mail & ~F.col("href").startswith("tel:") & (F.col("href") != "#")), ("email", mail))
    held = one.join(links, [*same, F.col("li") > F.col("i"), F.col("li") <= F.col("last")], "left").groupBy(*keep, "i", "last", "depth", "name", "title").agg(*[F.min(F.when(test, F.struct("li", "href")))["href"].alias(c) for c, test in kinds])
    # The innermost card of a name is the one to keep.
    best = held.groupBy(*keep, "name").agg(F.max(F.struct("depth", "i", "title", "href", "email")).alias("b"))
    return best.select(*keep, "b.i", "name", "b.title", "b.href", F.split(F.regexp_replace("b.email", "^mailto:", ""), r"\?", 2)[0].alias("email"))


def snapshot(trees: DataFrame, recruits, *keep: str) -> DataFrame:
    """(keep, title, source_date, links, blocks, signals, grades) of ``planted`` pages: what a check of a page keeps.

    500 links and 1000 blocks at most, five recruiting sentences and ten on grades, each once; blocks of menus, footers
    and scripts are left out. ``recruits`` tells of a sentence whether it recruits.
    """
    title = even(text_of(F.col("said"), F.get(F.filter("tree", lambda e: e["tag"] == "title"), F.lit(0))))
    links = F.slice(F.transform(F.filter("tree", lambda e: (e["tag"] == "a") & attr(e, "href").isNotNull()), lambda e: F.struct(attr(e, "href").alias("href"), text_of(F.col("said"), e).alias("label"))), 1, 500)
    hidden = F.filter("tree", lambda e: e["tag"].isin("nav", "footer", "script", "style", "noscript"))
    block = lambda e: e["tag"].isin("p", "li", "h1", "h2", "h3", "h4", "h5", "h6") & ~F.exists(F.col("hidden"), lambda h: (h["i"] < e["i"]) & (e["i"] <= h["last"]))
    staged = trees.withColumn("hidden", hidden)
    blocks = F.filter(F.transform(F.filter("tree", block), lambda e: F.struct(e["tag"].alias("tag"), text_of(F.col("said"), e).alias("text"))), lambda b: b["text"] != "")
    staged = staged.select(*keep, title.alias("title"), F.coalesce(F.trim(first_of(F.col("tree"), *DATES)), F.lit("")).alias("source_date"), links.alias("links"), blocks.alias("blocks"))
    sentences = F.flatten(F.transform("blocks", lambda b: F.transform(F.split(b["text"], r"(?<=[.!?])\s+|[;\t]+"), even)))
    staged = staged.withColumn("sentences", F.array_distinct(sentences))
    signals = F.slice(F.filter("sentences", lambda s: (F.length(s) > 15) & (F.length(s) < 500) & recruits(s)), 1, 5)
    grades = F.slice(F.filter("sentences", lambda s: (F.length(s) > 10) & (F.length(s) < 500) & W.holds(s, ("gpa",))), 1, 10)
    return staged.select(*keep, F.coalesce("title", F.lit("")).alias("title"), "source_date", "links", F.slice("blocks", 1, 1000).alias("blocks"), signals.alias("signals"), grades.alias("grades"))
