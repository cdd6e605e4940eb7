"""Admission against a fold over one request at a time: ties, nulls, empty tables, state, a key with half of all requests."""

import datetime
import random

import pytest

from tidemark.operators import admission as A

T0 = datetime.datetime(2024, 1, 30)


def fold(rows, rule, state=None):
    """One request at a time, as written down in the rules; times in whole seconds."""
    known, grants, out = state or {}, {}, {}
    for key, at, i in sorted(rows, key=lambda r: (r[1], r[2])):
        mine = grants.setdefault(key, [])
        s = known.get(key, {})
        if isinstance(rule, A.Rolling):
            live = [g for g in mine if g > at - datetime.timedelta(seconds=rule.span)]
            reason = "busy" if len(live) >= rule.limit else None
        else:
            reason = None
            if "blocked_until" in s and at < s["blocked_until"]:
                reason = "cooldown"
            elif rule.in_all and len(mine) + s.get("in_all", 0) >= rule.in_all:
                reason = "total"
            elif rule.per_month and sum((g.year, g.month) == (at.year, at.month) for g in mine) >= rule.per_month:
                reason = "month"
            elif rule.per_day and sum(g.date() == at.date() for g in mine) >= rule.per_day:
                reason = "day"
            elif mine and at < mine[-1] + datetime.timedelta(seconds=rule.interval):
                reason = "pace"
        if reason is None:
            mine.append(at)
        out[i] = reason
    return out


def requests(n, seed):
    r = random.Random(seed)
    return [(None if r.random() < 0.1 else "hot" if r.random() < 0.5 else f"k{r.randrange(5)}", T0 + datetime.timedelta(seconds=r.randrange(0, 5 * 86400, 300)), i) for i in range(n)]


RULES = [A.Budget(900, 12, 30, 50), A.Budget(0, 7, 0, 60), A.Budget(3600, 100, 0, 0), A.Budget(0, 9, 12), A.Rolling(3600, 1), A.Rolling(7200, 4)]


@pytest.mark.parametrize("rule", RULES, ids=str)
def test_equals_a_fold(spark, rule):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)  # runs of a key go on in the next batch
    try:
        rows = requests(1500, 3)
        df = spark.createDataFrame(rows, "provider string, at timestamp, id int")
        got = {r.id: r.reason for r in A.admit(df, "provider", "at", ["id"], rule).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == fold(rows, rule)


def test_state_goes_on(spark):
    """Two runs, the second from the state of the first, decide as one run does."""
    rule, rows = A.Budget(900, 12, 30, 50), requests(900, 5)
    cut = T0 + datetime.timedelta(days=2, hours=5)
    schema = "provider string, at timestamp, id int"
    first = A.admit(spark.createDataFrame([r for r in rows if r[1] < cut], schema), "provider", "at", ["id"], rule)
    state = A.used(first, "provider", "at", rule.interval)
    late = spark.createDataFrame([r for r in rows if r[1] >= cut], schema)
    second = A.admit(late, "provider", "at", ["id"], rule, state)
    assert {r.id: r.reason for r in first.unionByName(second).collect()} == fold(rows, rule)
    whole = A.used(A.admit(spark.createDataFrame(rows, schema), "provider", "at", ["id"], rule), "provider", "at", rule.interval)
    assert sorted(map(str, A.used(second, "provider", "at", rule.interval, state).collect())) == sorted(map(str, whole.collect()))


def test_cooldown_and_total(spark):
    rows = requests(300, 7)
    until = T0 + datetime.timedelta(days=1)
    known = {"hot": {"in_all": 20}, "k1": {"blocked_until": until}}
    state = spark.createDataFrame([("hot", None, 20), ("k1", until, None)], "provider string, blocked timestamp, in_all int").selectExpr("provider", "unix_micros(blocked) blocked_until", "in_all")
    rule = A.Budget(300, 50, 0, 40)
    got = {r.id: r.reason for r in A.admit(spark.createDataFrame(rows, "provider string, at timestamp, id int"), "provider", "at", ["id"], rule, state).collect()}
    assert got == fold(rows, rule, known)
    assert {"cooldown", "total", "pace", None} <= set(got.values())


def test_empty_and_timeless(spark):
    df = spark.createDataFrame([("a", None, 1), ("a", T0, 2), ("a", T0, 3), ("a", T0, 3)], "provider string, at timestamp, id int").selectExpr("*", "'x' reasons", "1 n")
    got = sorted((r.id, r.reason or "") for r in A.admit(df, "provider", "at", ["id"], A.Rolling(60, 2)).collect())
    assert got == [(1, "no_time"), (2, ""), (3, ""), (3, "busy")]
    assert A.admit(df.limit(0), "provider", "at", ["id"], A.Budget(1, 1)).count() == 0
