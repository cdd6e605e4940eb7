"""Literal cases for what the synthetic tables don't hold."""

from pyspark.sql import functions as F

from tidemark.functions import html, text, urls
from tidemark.operators import relational as R
from tidemark.operators import state as S
from tidemark.sources import readers

PAGE = """<html><head><title>Dept</title><meta name="citation_doi" content="doi:10.1234/ab"></head><body><nav><a href="/home">Home</a></nav>
<div><h3><a href="/p/ann">Ann B. Lee</a></h3><p>Associate Professor of Things</p><p>ann@x.edu</p></div>
<div><h3>Bob Ray</h3><p>Lecturer</p></div>
<h2>Publications</h2><p>A. Lee, B. Ray. "Learning things from other things," Venue, 2021. 10.1000/xyz.</p><p>no year here</p></body></html>"""


def rows(spark, name, function):
    spark.udtf.register(name, function)
    spark.createDataFrame([(PAGE,)], "html string").createOrReplaceTempView("one_page")
    return [tuple(r) for r in spark.sql(f"SELECT x.* FROM one_page, LATERAL {name}(html) x").collect()]


def test_directory_and_publications(spark):
    assert rows(spark, "t_people", html.Directory) == [("Ann B. Lee", "Associate Professor of Things", "ann@x.edu", "/p/ann"), ("Bob Ray", "Lecturer", None, None)]
    (work,) = rows(spark, "t_works", html.Publications)
    assert work[0] == "Learning things from other things" and work[2] == 2021 and work[3] == "10.1000/xyz"


def test_page_text_and_metadata(spark):
    r = spark.createDataFrame([(PAGE,), (None,), ("",)], "h string").select(html.page_text("h").alias("t"), html.page_metadata("h").alias("m")).collect()
    assert "Home" not in r[0]["t"] and "Bob Ray" in r[0]["t"] and r[0]["m"]["doi"] == "10.1234/ab" and r[0]["m"]["title"] == "Dept"
    assert r[1]["t"] is None and r[2]["t"] == ""


def test_text_functions(spark):
    df = spark.createDataFrame([("The Art; of (x) ;; a b", "Café Topic"), (None, None)], "a string, b string")
    r = df.select(text.interests(F.col("a")).alias("i"), text.topic(F.col("b")).alias("t"), text.covers(F.lit("deep nets"), F.array(F.lit("deep learning"), F.lit("neural nets"))).alias("c")).collect()
    assert r[0]["i"] == ["The Art", "of (x)", "a b"] and r[0]["t"] == "café topic" and r[0]["c"]
    assert r[1]["t"] is None


def test_canonical_url(spark):
    cases = {"HTTP://www.A.org//x//y/?utm_source=q&b=2&a=1#z": "https://a.org/x/y?a=1&b=2", "https://a.org/archive/x": "", "nothing": ""}
    got = spark.createDataFrame([(k,) for k in cases], "u string").select("u", urls.canonical(F.col("u")).alias("c")).collect()
    assert {r["u"]: r["c"] for r in got} == cases


def test_latest_child_ties_and_empty(spark):
    p = spark.createDataFrame([(1,), (2,)], "k int")
    c = spark.createDataFrame([(1, 5, "b"), (1, 5, "a"), (1, None, "z")], "k int, v int, id string")
    got = {r["k"]: (r["id"], r["n"]) for r in R.latest_child(p, c, "k", [F.desc_nulls_last("v"), F.asc("id")], ["id"], count="n").collect()}
    assert got == {1: ("a", 3), 2: (None, 0)}
    none = R.latest_child(p, c.limit(0), "k", [F.asc("id")], ["id"]).collect()
    assert [r["id"] for r in none] == [None, None]


def test_upsert_null_keys_and_lock(spark):
    a = spark.createDataFrame([(None, 1, "x"), (1, 2, "y")], "k int, n int, s string")
    b = spark.createDataFrame([(None, 5, " "), (2, 3, "w"), (1, 9, "q")], "k int, n int, s string")
    got = {r["k"]: (r["n"], r["s"]) for r in S.upsert(a, b, ["k"], {"n": S.added, "s": S.filled}, locked=F.col("o.n") == 2).collect()}
    assert got == {None: (6, "x"), 1: (2, "y"), 2: (3, "w")}


def test_claim_takes_one_model_job(spark):
    rows_ = [(i, "queued", 1, 0, 3, "2026-01-01 00:00:00", True, "A") for i in range(3)] + [(9, "queued", 0, 0, 3, "2026-01-01 00:00:00", False, "A")]
    jobs = spark.createDataFrame(rows_, "id int, status string, priority int, attempts int, max_attempts int, available_at string, model boolean, job_type string")
    jobs = jobs.withColumn("available_at", F.col("available_at").cast("timestamp")).withColumn("created_at", F.col("available_at"))
    got = [r["id"] for r in S.claim(jobs, F.lit("2026-01-02").cast("timestamp"), 5).collect()]
    assert sorted(got) == [0, 9]


def test_registry_csv(spark, tmp_path):
    (tmp_path / "r.csv").write_bytes("﻿UNITID,INSTNM,INSTURL,CURROPER\n1,A,a.edu,1\nx,B,b.edu,0\n2,,c.edu,0\n3,C,https://c.edu,\n".encode())
    got = {r["unit_id"]: (r["name"], r["homepage"], r["operating"]) for r in readers.registry(spark, str(tmp_path / "r.csv")).collect()}
    assert got == {1: ("A", "https://a.edu", True), 3: ("C", "https://c.edu", None)}


def test_document_queries_return_scores(spark, tmp_path):
    import re

    from tidemark.plans import catalog

    texts = ["Physics of a machine", "learning by machine", "privacy of the database", "a data security note", "training data for a model", "model training data language", "data", "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    scores = {r["doc_id"]: r["score"] for r in catalog.QUERIES["document_score_shares"](spark, str(tmp_path)).collect()}
    asked = {"model", "training", "data", "language"}
    for i, t in enumerate(texts):
        r = len(asked & set(re.findall("[a-z0-9]+", (t or "").lower()))) / 4
        assert scores[i] == (85.0 if "model training data language" in (t or "") else 45 + 25 * r if r >= 0.75 else 0.0)
    got = {(r["doc_id"], r["field"]): (r["combined"], r["decision"]) for r in catalog.QUERIES["classify_documents_decided"](spark, str(tmp_path)).collect()}
    assert len(got) == 3 * len(texts)
    assert got[(0, "physics")] == (54.0, "REVIEW_REQUIRED")
    assert got[(1, "machine learning")] == (66.75, "AUTO_ACCEPTED")  # two of the three tokens of name and alias
    assert got[(2, "data security")] == (35.0, "AUTO_REJECTED")
    assert got[(3, "data security")] == (92.2, "AUTO_ACCEPTED")
    assert got[(7, "physics")] == got[(8, "physics")] == (0.0, "AUTO_REJECTED")


def test_main_part_and_tables():
    p = html.Page("<nav>menu</nav><main><header><h1>Ana Lee</h1></header><p>One<p>Two <a href=/x>lab</a><aside><p>side</aside><h2>End</h2></main><p>after")
    assert p.main == [("h1", "Ana Lee"), ("p", "One"), ("p", "Two lab"), ("h2", "End")] and ("p", "after") in p.blocks and ("p", "side") in p.blocks
    assert html.Page("<div class='menu'><p>x</p></div><p>body</p>").main == [("p", "body")]
    row = "<tr><td>Bo<td>Ray<td>Lecturer<td><a href='mailto:b@a.edu?x'>mail</a> <a href='/bo'>View</a>"
    head = "<tr><th>First Name<th>Last Name<th>Rank<th>Page"
    members = lambda text: [m for t in html._Rows(text).tables if t for m in html._members(t, "https://a.edu/people", 4)]
    got = members(f"<table>{head}{row * 3}</table>")
    assert len(got) == 3 and got[0]["name"] == "Bo Ray" and got[0]["email"] == "b@a.edu" and got[0]["profile_url"] == "https://a.edu/bo" and got[0]["title"] == "Lecturer"
    assert members(f"<table>{head}{row * 2}</table>") == [] and members("") == [] and members("</td></table><tr>") == []
