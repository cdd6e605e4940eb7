"""Mixing against sharing out in plain Python, and what any mixture must satisfy."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidemark.llm import mixing
from tidemark.llm import queries as llm

SCHEMA = "doc_id long, text string, source string, row string, size string, target string, pass string"


def rows():
    rng = random.Random(7)
    out = [(0, None, "a"), (1, "", "a"), (2, " \t\n", None), (3, "one two", None), (4, "w " * 3000, "hot"), (5, "x y z", "tiny"), (5, "x y z", "tiny"), (6, "", "blank")]
    out += [(i, " ".join(f"w{j}" for j in range(rng.randint(0, 60))), rng.choice(["hot", "hot", "b", "é", "Z"])) for i in range(7, 200)]
    return out + [(None, "a null id", "b")]


def shares(sizes, weights, repeat):
    """Targets by sharing out the excess until none is above its limit."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, target, open_ = float(sum(sizes.values())), {}, set(names)
    while open_:
        part = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if part[s] >= repeat * sizes[s]}
        if not over:
            target |= part
            break
        for s in over:
            target[s] = float(repeat * sizes[s])
            left -= target[s]
        open_ -= over
    return target


@pytest.mark.parametrize(("weights", "block", "shard"), [((5, 2, 1), 16, 500), ((1, 40), 7, 90), ((5, 2, 1), 4096, 1 << 22)])
def test_mixture(spark, weights, block, shard):
    data = rows()
    docs = spark.createDataFrame([(*r, "no", "no", "no", "no") for r in data], SCHEMA).repartition(3)
    mixed, known = mixing.mix(docs, weights, 3, block_words=block, shard_words=shard)
    mixed, known = mixed.collect(), {r["row"]: r for r in known.collect()}
    assert len(known) == len(data)
    size, count = Counter(), Counter()
    for i, t, s in data:
        size[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want = shares(size, weights, 3)
    for r in known.values():
        assert r["source_size"] == size[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
    words, seen = Counter(), defaultdict(set)
    for r in mixed:
        k = known[r["row"]]
        words[k["source"]] += r["length"]
        count[r["row"]] += r["length"]
        span = set(range(r["start"], r["start"] + r["length"]))
        assert span and max(span) < k["size"] and not span & seen[r["row"], r["pass"]]
        seen[r["row"], r["pass"]] |= span
    assert all(words[s] == int(want[s] + 1e-6) or abs(words[s] - want[s]) < 1 for s in size)
    assert all(n <= 3 * known[r]["size"] for r, n in count.items())
    # Blocks are gapless inside, full but for one per source, and of one source; shards hold equal numbers of them.
    by = defaultdict(list)
    for r in mixed:
        by[r["shard"], r["slot"]].append(r)
    short = Counter()
    for own in by.values():
        own.sort(key=lambda r: r["at"])
        assert [r["at"] for r in own] == list(np.cumsum([0] + [r["length"] for r in own])[:-1])
        assert len({known[r["row"]]["source"] for r in own}) == 1
        short[known[own[0]["row"]]["source"]] += sum(r["length"] for r in own) < block
    assert max(short.values()) <= 1
    per = Counter(s for s, _ in by)
    assert max(per.values()) - min(per.values()) <= 1
    assert {(s, i) for s in per for i in range(per[s])} == set(by)


def test_reruns_agree(spark):
    data = [r for i, r in enumerate(rows()) if r[0] is not None and r[0] != 5]
    docs = spark.createDataFrame([(*r, "no", "no", "no", "no") for r in data], SCHEMA)
    once, again = (sorted((r["shard"], r["slot"], r["at"], r["doc_id"], r["pass"], r["start"], r["length"]) for r in mixing.mix(d, block_words=16, shard_words=300)[0].collect()) for d in (docs.repartition(2), docs.repartition(5)))
    assert once == again


def test_draws_are_hypergeometric(spark):
    """Counts of a source over shards have the mean and the spread of draws without return."""
    quotas = spark.createDataFrame([(5, 0, 3000), (6, 1, 900), (7, 2, 100)], "key long, source_no long, n long")
    got = defaultdict(Counter)
    for seed in range(3):
        for r in mixing.deal(quotas, 100, 4000, seed).collect():
            got[r["source_no"]][seed, r["first"]] = r["n"]
    for no, n in ((0, 3000), (1, 900), (2, 100)):
        x = np.array([got[no][s, i] for s in range(3) for i in range(100)])
        assert x.sum() == 3 * n
        p = n / 4000
        assert x.var() == pytest.approx(40 * p * (1 - p) * (3960 / 3999), rel=0.35)
    assert all(sum(got[no][s, i] for no in range(3)) == 40 for s in range(3) for i in range(100))


@pytest.mark.parametrize("count", [1, 2, 5, 64, 1000])
def test_permutation(count):
    assert sorted(mixing.permuted(np.arange(count), count, -12345)) == list(range(count))


def test_empty_tables(spark):
    for data in ([], [(1, None, "a", "", "", "", "")]):
        mixed, known = mixing.mix(spark.createDataFrame(data, SCHEMA))
        assert mixed.collect() == [] and [r["target"] for r in known.collect()] == [0.0] * len(data)


def test_query(spark):
    got = llm.op11_mixing(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == len({r["doc_id"] for r in got}) and all(r["taken"] <= 3 * r["size"] for r in got)
