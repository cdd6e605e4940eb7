"""Closed aliases against a search from each name; names and hosts that must not match."""

import random

from pyspark.sql import functions as F

from tidemark.operators import identity as I


def reachable(pairs, node):
    seen, todo = {node}, [node]
    while todo:
        x = todo.pop()
        for a, b in pairs:
            for u, v in ((a, b), (b, a)):
                if u == x and v not in seen:
                    seen.add(v)
                    todo.append(v)
    return seen


def test_closure(spark):
    r = random.Random(4)
    chain = [(f"c{i:03}", f"c{i + 1:03}") for i in range(70)]
    hub = [("hub", f"h{i}") for i in range(60)]
    pairs = chain + hub + [(f"n{r.randrange(60)}", f"n{r.randrange(60)}") for _ in range(45)]
    r.shuffle(pairs)
    df = spark.createDataFrame([*pairs, *pairs[:20], (None, "x"), ("y", None), ("z", "z")], "a string, b string")
    got = {x.node: x.root for x in I.closure(df, "a", "b").collect()}
    linked = {x for p in pairs if p[0] != p[1] for x in p}
    assert got == {x: min(reachable(pairs, x)) for x in linked}
    assert I.closure(df.limit(0), "a", "b").count() == 0


def test_names(spark):
    registry = spark.createDataFrame([(1, "Üni of A", "a.edu", True), (2, "A Univ", "a.edu", False), (3, "A Campus North", "a.edu", True), (4, None, None, True), (None, "Lost", "", True)], "id int, name string, domain string, main boolean")
    aliases = spark.createDataFrame([("A Univ", "AU"), ("AU", "Uni of A!"), ("Free", "Loose"), (None, "A Campus North"), ("...", "AU")], "name string, alias string")
    names = I.registry_names(registry, aliases, [F.desc("main")])
    said = spark.createDataFrame([(0, "au"), (1, "UNI  of a"), (2, "A campus"), (3, "loose"), (4, None), (5, "A-Campus North"), (6, "lost")], "i int, said string")
    got = {r.i: (r.institution_id, r.institution) for r in I.canonical(said, "said", names).collect()}
    assert got == {0: (1, "Üni of A"), 1: (1, "Üni of A"), 2: (None, "A campus"), 3: (None, "loose"), 4: (None, None), 5: (3, "A Campus North"), 6: (None, "lost")}
    pairs = spark.createDataFrame([(0, "AU", "a univ"), (1, "AU", "A Campus North"), (2, "Loose", "free"), (3, "Ü", "u"), (4, None, None), (5, "?", "!")], "i int, l string, r string")
    assert {r.i for r in I.equivalent(pairs, "l", "r", names).where("equivalent").collect()} == {0, 2, 3}
    hosts = spark.createDataFrame([(0, "X.a.edu."), (1, "ba.edu"), (2, None), (3, "")], "i int, h string")
    assert {r.i: r.institution_id for r in I.of_hosts(hosts, "i", "h", registry, [F.desc("main")]).collect()} == {0: 1, 1: None, 2: None, 3: None}
