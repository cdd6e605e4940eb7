"""Walks against one that keeps a queue, on random links with turns back, missing pages, nulls and both ways to end."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import composites as C
from tidemark.operators import walks
from tidemark.sources import readers


def queue_walk(links, found, home, pages, most, distinct):
    pending, seen, got = list(home), [], []
    while pending and len(seen) < pages and (len(set(got)) if distinct else len(got)) < most:
        page = pending.pop(0)
        if page in seen:
            continue
        seen.append(page)
        pending += [u for p, _, u in links if p == page]
        got += [u for p, _, u in found if p == page]
    return seen, list(dict.fromkeys(got))[:most]


@pytest.mark.parametrize("distinct", [True, False])
def test_equals_a_queue(spark, distinct):
    r = random.Random(11)
    links, found, homes, want = [], [], [], {}
    for site in range(12):
        pages = [f"p{i}" for i in range(r.choice([2, 6, 30]))]
        mine = sorted((r.choice(pages), place, r.choice([*pages, "gone"])) for place in range(r.choice([3, 40, 200])))
        hits = sorted((r.choice(pages), place, f"u{r.randrange(15)}") for place in range(r.choice([0, 10, 60])))
        home = r.sample(pages, 2)
        links += [(site, *x) for x in mine]
        found += [(site, *x) for x in hits]
        homes += [(site, i, u) for i, u in enumerate(home)]
        want[site] = queue_walk(mine, hits, home, 6, 8, distinct)
    extra = [(None, "p0", 0, "p1"), (0, None, 0, "p1"), (0, "p0", 0, None)]
    make = lambda rows: spark.createDataFrame(rows, "site int, page string, place int, url string")
    hits = make(found)
    visits = walks.walk(make(links + extra), hits, spark.createDataFrame(homes, "site int, place int, url string"), "site", 6, 8, distinct).cache()
    rows, kept = {}, {}
    for v in sorted(visits.collect(), key=lambda v: v.visit):
        rows.setdefault(v.site, []).append(v.page)
    for v in sorted(walks.first_found(visits, hits, "site", 8).collect(), key=lambda v: v["rank"]):
        kept.setdefault(v.site, []).append(v.url)
    assert rows == {s: w[0] for s, w in want.items()}
    assert kept == {s: w[1] for s, w in want.items() if w[1]}


def test_no_rows(spark):
    links = spark.createDataFrame([], "site int, page string, place int, url string")
    home = spark.createDataFrame([(1, 0, "a")], "site int, place int, url string")
    assert [tuple(r) for r in walks.walk(links, links, home, "site", 3, 5).collect()] == [(1, "a", 1)]
    assert walks.walk(links, links, home.limit(0), "site", 3, 5).count() == 0


def test_broken_maps(spark):
    maps = [(0, "<urlset><sm:loc>https://a.edu/x?a=1&amp;b=2</sm:loc><loc><![CDATA[ https://a.edu/y ]]></loc><loc>https://a.edu/"), (1, "no xml"), (2, None), (3, "")]
    got = readers.sitemap_locations(spark.createDataFrame(maps, "id int, xml string"), "xml").collect()
    assert [(r.id, r.place, r.loc) for r in got] == [(0, 0, "https://a.edu/x?a=1&b=2"), (0, 1, "https://a.edu/y")]


def test_directories_of_units(spark):
    units = spark.createDataFrame([(1, 1, "https://a.edu/physics"), (1, 2, "https://a.edu/art"), (1, 3, "https://a.edu/law")], "site int, rank int, url string")
    rows = [("https://a.edu/art", 0, "https://a.edu/art/faculty", "Our Faculty"), ("https://a.edu/physics", 1, "https://a.edu/physics/people/?x=1", "People Directory"), ("https://a.edu/physics", 0, "https://a.edu/physics/news/faculty", "directory"), ("https://a.edu/physics", 2, "https://a.edu/physics/faculty", "Faculty"), ("https://a.edu/law", 0, "https://a.edu/law/faculty", "Faculty and staff")]
    links = spark.createDataFrame([(1, *r) for r in rows], "site int, page string, place int, url string, label string").withColumn("domain", F.lit("a.edu"))
    got = C.roster_candidates(units, links, "site", "domain", most_units=2).orderBy("rank").collect()
    assert [r.url for r in got] == ["https://a.edu/physics/people", "https://a.edu/art/faculty"]


def test_more_visits_than_a_session_allows(spark):
    """900,000 sites of seven maps passed the million rows that a recursive query may give in a session made elsewhere."""
    before = spark.conf.get("spark.sql.cteRecursionRowLimit")
    spark.conf.set("spark.sql.cteRecursionRowLimit", "20")
    try:
        docs = [(f"s{i}.edu", f"https://s{i}.edu/sitemap.xml", f"<loc>https://s{i}.edu/a.xml</loc><loc>https://s{i}.edu/faculty/?q=1</loc><loc>https://s{i}.edu/x</loc>") for i in range(40)]
        docs += [("none.edu", "https://none.edu/sitemap.xml", None), ("bare.edu", "https://bare.edu/sitemap.xml", "<loc>https://other.edu/faculty</loc>")]
        got = C.sitemap_directories(spark.createDataFrame(docs, "domain string, page string, xml string"), "domain").collect()
        assert sorted((r.domain, r["rank"], r.url) for r in got) == sorted((f"s{i}.edu", 1, f"https://s{i}.edu/faculty") for i in range(40))
    finally:
        spark.conf.set("spark.sql.cteRecursionRowLimit", before)
