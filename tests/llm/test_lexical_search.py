"""Lexical search against scoring every document in plain Python, and against its SQL on the smallest tables."""

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from tidemark.llm import lexical_search
from tidemark.llm import queries as llm

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, term string, score string"


def rows():
    rng = random.Random(9)
    voc = [f"t{int(rng.paretovariate(0.5)) % 90}" for _ in range(300)] + ["É", "Über", "x_y", "naïve　z"]
    out = [(0, None), (1, ""), (2, " ,.;_"), (3, "T1"), (4, "t1"), (5, "t1 " * 5000), (None, "t1 t2 t3")]
    out += [(i, " ".join(rng.choice(voc) for _ in range(rng.randint(1, 80)))) for i in range(6, 400)]
    return out + [(11, out[20][1]), (12, out[20][1]), (12, out[20][1])]


def items():
    rng = random.Random(4)
    out = [(0, None), (1, ""), (2, "unheard of"), (3, "t1"), (4, "t1 T1 t2 t2 t2"), (5, "É über"), (None, "t3 t4"), (7, "t5"), (7, "t6 t5")]
    return out + [(i, " ".join(f"t{rng.randint(0, 95)}" for _ in range(rng.randint(1, 30)))) for i in range(8, 40)]


def brute(docs, asked, k):
    tf = [(i, Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in docs]
    tf = [(i, c, sum(c.values())) for i, c in tf if c]
    n_docs, n_terms = len(tf), sum(n for *_, n in tf)
    df = Counter(t for _, c, _ in tf for t in c)
    q = {}
    for i, t in asked:
        q.setdefault(i, Counter()).update(TERM.findall((t or "").translate(LOWER)))
    out = []
    for item, want in q.items():
        w = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in want if df[t]}
        found = []
        for i, c, n in tf:
            m = 100 - 75 + (75 * n * n_docs) // n_terms
            s = sum(want[t] * w[t] * (1000000000 * c[t] // (1000 * c[t] + 8 * m)) for t in w if c[t])
            if s:
                found.append((-s, i is None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize(("shard", "per_task", "few"), [(2000, 1000, 10), (1 << 20, 7, 10**6), (1, 1000, 10**6)])
def test_equal_to_scoring_all(spark, monkeypatch, shard, per_task, few):
    for name, value in (("SHARD", shard), ("ITEMS", per_task), ("BROADCAST_TERMS", few)):
        monkeypatch.setattr(lexical_search, name, value)
    docs = spark.createDataFrame([(*r, "clash", "clash") for r in rows()], SCHEMA).repartition(3)
    asked = spark.createDataFrame([(*r, "x", "y") for r in items()], "item_id long, text string, shard string, asks string")
    got = lexical_search.search(lexical_search.build_index(docs), asked, 10).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows(), items(), 10)


@pytest.mark.parametrize(("block", "step"), [(1, 1), (2, 3), (7, 2), (64, 32)])
def test_best_of_a_shard(monkeypatch, block, step):
    """Any size of blocks and strides gives the best of all documents, with ties in order of the documents."""
    for name, value in (("BLOCK", block), ("STEP", step), ("PRIME", step)):
        monkeypatch.setattr(lexical_search, name, value)
    docs = [(i, t.encode()) for i, t in rows() if t and TERM.search(t) and i is not None]
    parts = [r for b in lexical_search._shard(0, [i for i, _ in docs], [t for _, t in docs]) for r in b.to_pylist()]
    own = next(r for r in parts if r["term"] is None)
    n_docs, n_terms = len(docs), sum(own["sizes"])
    middle = lexical_search.damping(np.array(own["sizes"], np.int64), n_docs, n_terms)
    lists = {r["term"]: (math.floor(1000 * math.log((2 * n_docs + 2) / (2 * r["df"] + 1))), lexical_search.Postings(r["df"], r["heads"], r["data"], middle, (n_docs, n_terms))) for r in parts if r["term"]}
    for item, text in items()[3:]:
        if item is None or item == 7:
            continue
        want = Counter(TERM.findall(text.translate(LOWER)))
        d, s = lexical_search.best([(lists[t][0] * n, lists[t][1]) for t, n in want.items() if t in lists], n_docs, 10)
        got = [(item, r, own["ids"][i], x) for r, (i, x) in enumerate(zip(d.tolist(), s.tolist()), 1)]
        assert sorted(got) == sorted(brute([(i, t.decode()) for i, t in docs], [(item, text)], 10))


def test_varints():
    v = np.array([0, 1, 127, 128, 16383, 16384, 2**31, 5])
    data, at = lexical_search._varints(v)
    assert lexical_search._numbers(data).tolist() == v.tolist() and len(at) == len(v)


def test_blocks_below_the_threshold_stay_closed():
    """Documents of the rare term beat all others, so most blocks of the common one are never opened."""
    texts = [b"common " + (b"rare rare rare" if 500 <= i < 510 else b"x" * (i % 7 + 1)) for i in range(4000)]
    sizes = np.full(4000, 2, np.int64)
    sizes[500:510] = 4
    middle = lexical_search.damping(sizes, 4000, int(sizes.sum()))
    rows = [r for b in lexical_search._shard(0, list(range(4000)), texts) for r in b.to_pylist()]
    p = {r["term"]: lexical_search.Postings(r["df"], r["heads"], r["data"], middle, (4000, int(sizes.sum()))) for r in rows if r["term"]}
    docs, scores = lexical_search.best([(1, p["common"]), (5000, p["rare"])], 4000, 10)
    assert docs.tolist() == list(range(500, 510)) and len(set(scores.tolist())) == 1
    assert len(p["common"].first) == 63 and len(p["common"].opened) <= 2


def test_empty(spark):
    docs = spark.createDataFrame([], SCHEMA)
    asked = spark.createDataFrame(items()[:4], "item_id long, text string")
    assert lexical_search.search(lexical_search.build_index(docs), asked).collect() == []
    some = lexical_search.build_index(spark.createDataFrame([(1, "t1", "", "")], SCHEMA))
    assert lexical_search.search(some, asked.where("false")).collect() == []


def test_equal_to_sql(spark):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    res = con.execute(llm.ORACLES["op12_lexical_search"])
    names = [d[0] for d in res.description]
    want = sorted(res.fetchall())
    assert want and sorted(tuple(r) for r in llm.op12_lexical_search(spark, folder).select(*names).collect()) == want
