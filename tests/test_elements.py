"""The element tree against walking the same markup, and page rules on markup of other kinds."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import elements, profiles


def nested(rng, depth=0):
    """Markup and, in order of their beginnings, (tag, number of elements inside, words inside)."""
    out, found = "", []
    for _ in range(rng.randint(0, 3 if depth < 4 else 0)):
        tag = rng.choice(["div", "span", "section", "em"])
        inner, below = nested(rng, depth + 1)
        word = f"w{rng.randint(0, 99)}"
        out += f"<{tag} class='a b' id=x{depth}>{word} {inner}</{tag}>"
        found += [(tag, len(below), word, depth)] + below
    return out, found


def test_places(spark):
    rng = random.Random(2)
    pages = [nested(rng) for _ in range(30)]
    df = spark.createDataFrame([(i, m, "x") for i, (m, _) in enumerate(pages)] + [(98, None, "x"), (99, "", "x")], "page_id int, html string, said string").drop("said")
    rows = elements.exploded(elements.planted(df), "page_id").orderBy("page_id", "i").collect()
    by = {}
    for r in rows:
        by.setdefault(r["page_id"], []).append(r)
    assert not {98, 99} & set(by)
    for i, (_, found) in enumerate(pages):
        got = by.get(i, [])
        assert [(r["tag"], r["last"] - r["i"], r["depth"]) for r in got] == [(t, n, d) for t, n, _, d in found]
        for r, (_, n, word, d) in zip(got, found):
            assert r["text"].split() == [w for _, _, w, _ in found[r["i"] : r["last"] + 1]] and r["text"].split()[0] == word
            assert r["classes"] == ["a", "b"] and r["attrs"]["id"] == f"x{d}"
            assert r["parent"] == max((p["i"] for p in got if p["i"] < r["i"] <= p["last"]), default=-1)


META = [
    ('<meta name="citation_title" content="A"><meta property="og:title" content="B">', ("A", "", "")),
    ('<title> Page  title </title><meta property="og:description" content="D">', ("Page title", "D", "")),
    ('<script type="application/ld+json">{"headline": "H", "abstract": "X", "doi": "10.1/x"}</script>', ("H", "X", "10.1/x")),
    ('<script type="application/ld+json">[{"name": "N"}, 4, {"abstract": "Y"}]</script><script>var x</script>', ("N", "Y", "")),
    ('<script type="application/ld+json">{broken</script><meta name="dc.identifier" content="10.2/y">', ("", "", "10.2/y")),
    (None, ("", "", "")),
]


def test_metadata(spark):
    df = spark.createDataFrame([(i, h, "clash") for i, (h, _) in enumerate(META)], "page_id int, html string, title string")
    got = {r["page_id"]: (r["title"], r["abstract"], r["doi"]) for r in elements.metadata(elements.planted(df.drop("title")), "page_id").collect()}
    assert got == {i: want for i, (_, want) in enumerate(META)}


@pytest.mark.parametrize(
    ("html", "titles"),
    [
        ("<h2>Publications</h2><ul><li>“A paper of note,” 2020.</li></ul><h2>Talks</h2><p>“A talk of note,” 2020.</p>", ["A paper of note"]),
        ("<h1>Research publications</h1><h2>Journal articles</h2><p><em>Inside a kind</em>, 2019</p><h2>Teaching</h2><p><em>Not this one</em>, 2019</p>", ["Inside a kind"]),
        ("<h2>Talks and publications</h2><p><em>Neither of them</em>, 2019</p>", []),
        ("<p><em>No heading at all</em>, 2019</p>", []),
        ("<h2>Papers</h2><h3>Selected works</h3><p><em>Only once here</em>, 2019</p>", ["Only once here"]),
    ],
)
def test_works(spark, html, titles):
    df = elements.planted(spark.createDataFrame([(1, html)], "page_id int, html string"))
    assert [r["title"] for r in elements.works(df, "page_id").collect()] == titles


@pytest.mark.parametrize(
    ("html", "people"),
    [
        ("<main><div><h3>Jane Doe</h3><p>Assistant Professor</p><a href='/jane'>View</a></div><div><h3>John Smith</h3><p>Professor</p></div></main>", [("Jane Doe", "Assistant Professor", "/jane"), ("John Smith", "Professor", None)]),
        ("<div><h3>Jane Doe</h3><p>Assistant</p></div>", []),
        ("<p>Professor</p>", []),
    ],
)
def test_cards(spark, html, people):
    df = elements.planted(spark.createDataFrame([(1, html)], "page_id int, html string"))
    assert sorted((r["name"], r["title"], r["href"]) for r in elements.cards(df, profiles.ROLE, "page_id").collect()) == people


def test_empty_table(spark):
    df = elements.planted(spark.createDataFrame([], "page_id int, html string"))
    for f in (elements.metadata(df, "page_id"), elements.works(df, "page_id"), elements.cards(df, profiles.ROLE, "page_id"), elements.snapshot(df, lambda s: F.lit(True), "page_id")):
        assert f.collect() == []


def test_works_stay_in_their_page(spark):
    """Works were joined over several parses of each page; a page is parsed once and shuffled nowhere."""
    df = elements.planted(spark.createDataFrame([(1, "<h2>Papers</h2><li>A work of some length, 2019")], "page_id long, html string"))
    plan = elements.works(df, "page_id")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "Exchange" not in plan and "Join" not in plan
