"""The automaton against looking for each phrase, and the category rules on the cases that name them."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import phrases, scoring, text


def test_hits_equal_to_looking(spark):
    rng = random.Random(1)
    voc = ["a", "b", "ab", "of", "c"]
    lexicon = phrases.Lexicon()
    asked = [" ".join(rng.choice(voc) for _ in range(rng.randint(1, 4))) for _ in range(60)]
    for p in asked:
        lexicon.add(p)
    assert lexicon.add("", "!?", None) == []
    rows = [(i, *(" ".join(rng.choice(voc) for _ in range(rng.randint(0, 9))) for _ in range(2))) for i in range(80)] + [(90, None, "a b"), (91, "a b", None), (92, "", "")]
    df = spark.createDataFrame(rows, "id int, t string, b string")
    got = df.select("t", "b", phrases.hits(lexicon, text.plain(F.col("t")), text.plain(F.col("b"))).alias("f")).collect()
    for r in got:
        t, b = phrases.plain(r["t"]), phrases.plain(r["b"])
        for where, s in (("title", t), ("body", b), ("whole", f"{t} {b}".strip())):
            assert r["f"][where] == sorted(i for p, i in lexicon.number.items() if f" {p} " in f" {s} ")


def test_no_phrases(spark):
    found = spark.range(1).select(phrases.hits(phrases.Lexicon(), F.lit("a"), F.lit("b")).alias("f")).first()["f"]
    assert found["title"] == found["body"] == found["whole"] == []


#: Category, title, body, combined score, decision.
CASES = [
    (("machine learning", ["deep learning"], ["neural network"], ["learning to teach"], [], False), "Deep learning for vision", "x", 97.4, "AUTO_ACCEPTED"),
    (("machine learning", ["deep learning"], ["neural network"], ["learning to teach"], [], False), "A study", "We use a neural network.", 77.75, "AUTO_ACCEPTED"),
    (("machine learning", ["deep learning"], ["neural network"], ["learning to teach"], [], False), "Machine learning", "learning to teach well", 20.0, "AUTO_REJECTED"),
    (("data security", [], [], [], [["data", "database"], ["security", "privacy"]], False), "Privacy in database systems", "data security matters", 92.2, "AUTO_ACCEPTED"),
    (("data security", [], [], [], [["data"], ["privacy"]], False), "Data security", "", 54.0, "REVIEW_REQUIRED"),
    (("physics", [], [], [], [], True), "Physics", "y", 54.0, "REVIEW_REQUIRED"),
    (("social work", [], [], [], [], True), "Work on social computing", "", 54.0, "REVIEW_REQUIRED"),
    (("social work", [], [], [], [], True), "Social work", "", 97.4, "AUTO_ACCEPTED"),
    (("quantum gravity theory", [], [], [], [], False), "Gravity of quantum kinds", "", 80.08, "AUTO_ACCEPTED"),
    (("x", [], [], [], [], False), None, None, 0.0, "AUTO_REJECTED"),
]


@pytest.mark.parametrize(("category", "title", "body", "combined", "decision"), CASES)
def test_category_rules(spark, category, title, body, combined, decision):
    df = spark.createDataFrame([(title, body, "clash")], "title string, body string, main string")
    m = scoring.classify(df, "title", "body", [category]).first()["m"]
    assert (m["combined"], m["decision"]) == (combined, decision)


def test_matched_phrases(spark):
    df = spark.createDataFrame([("deep learning", "a neural network")], "title string, body string")
    m = scoring.classify(df, "title", "body", [("machine learning", ["deep learning"], ["neural network"], [], [], False)]).first()["m"]
    assert m["matched"] == [1, 2]
