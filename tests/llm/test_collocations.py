"""Collocations against counting every run in plain Python, and against their SQL on the smallest tables."""

import random
import re
from collections import Counter

import duckdb
import pytest

from tidemark.llm import collocations
from tidemark.llm import queries as llm

SCHEMA = "doc_id long, text string, lang string, phrase string, f string"


def rows():
    rng = random.Random(3)
    voc = [f"w{i}" for i in range(12)] + ["É", "Ab", "x\u0085y", "naïve"]
    out = [(0, None, "en"), (1, "", "en"), (2, " \t\n.,;", None), (3, "Only", None), (4, "a b c " * 4000, "de"), (5, "hot " * 500 + ".", "de")]
    for i in range(6, 120):
        t = "".join(rng.choice(voc) + rng.choice([" ", " ", "  ", "\t", ", ", "\n", "! ", "\r\n"]) for _ in range(rng.randint(1, 60)))
        out.append((i, t, rng.choice(["en", "en", "de", None])))
    return out + [out[20], out[20], (21, out[21][1], "fr")]


def brute(data, max_n, least, cover, top):
    counts = Counter()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for _, text, lang in data:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            w = re.findall(r"[^\x20\x09]+", piece)
            for n in range(1, max_n + 1):
                counts.update((lang or "und", tuple(w[i : i + n])) for i in range(len(w) - n + 1))
    totals = Counter()
    for (lang, p), f in counts.items():
        totals[lang] += f * (len(p) == 1)
    cand = {k: f for k, f in counts.items() if len(k[1]) > 1 and f >= least}
    held = Counter()
    for (lang, p), f in cand.items():
        for n in range(2, len(p)):
            for i in range(len(p) - n + 1):
                held[lang, p[i : i + n]] = max(held[lang, p[i : i + n]], f)
    by = {}
    for (lang, p), a in cand.items():
        if held[lang, p] and 100 * held[lang, p] >= cover * a:
            continue
        cuts = [(1000000 * a * a // (counts[lang, p[:k]] * counts[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        by.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), counts[lang, p[:k]], counts[lang, p[k:]]))
    out = set()
    for lang, found in by.items():
        for i, (s, a, p, l, r) in enumerate(sorted(found)[:top], 1):
            out.add((lang, i, p.decode(), -a, l, r, totals[lang], -s))
    return out


@pytest.mark.parametrize(("max_n", "least", "cover", "top", "buffer"), [(3, 10, 50, 2000, 1 << 20), (4, 2, 80, 7, 100), (2, 1, 1, 5, 1)])
def test_equal_to_counting(spark, monkeypatch, max_n, least, cover, top, buffer):
    monkeypatch.setattr(collocations, "BUFFER", buffer)
    monkeypatch.setattr(collocations, "SHARES", 3)
    monkeypatch.setattr(collocations, "SENT", 0 if buffer == 100 else 1 << 20)
    data = rows()
    docs = spark.createDataFrame([(*r, "clash", "clash") for r in data], SCHEMA).repartition(3)
    got = [tuple(r) for r in collocations.collocations(docs, max_n, least, cover, top).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(data, max_n, least, cover, top)


def test_products_beyond_64_bits(spark):
    """Counts of 10^14 are scored exactly; they are set, not counted."""
    a, l, r = 99_999_999_999_999, 100_000_000_000_000, 123_456_789_012_345
    row = spark.sql(f"SELECT {collocations.SCORE} AS s FROM VALUES ({a}L, {l}L, {r}L) t(a, l, r)").first()
    assert row["s"] == 1000000 * a * a // (l * r)


def test_empty(spark):
    assert collocations.collocations(spark.createDataFrame([], SCHEMA)).collect() == []


def test_equal_to_sql(spark):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    res = con.execute(llm.ORACLES["op13_collocations"])
    names = [d[0] for d in res.description]
    want = {tuple(r) for r in res.fetchall()}
    got = {tuple(r) for r in llm.op13_collocations(spark, folder).select(*names).collect()}
    assert got == want and got
