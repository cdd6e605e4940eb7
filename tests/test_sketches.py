"""Sketches against exact counts: daily ones united, within the stated error, nulls and repeats counting for nothing."""

from pyspark.sql import functions as F

from tidemark.operators import sketches as K


def test_united_within_the_error(spark):
    df = spark.range(200_000).select((F.col("id") % 30).alias("day"), (F.col("id") % 3).alias("kind"), F.when(F.col("id") % 10 > 0, F.xxhash64(F.col("id") % 70_000)).alias("v"))
    daily = K.sketches(df, ["kind", "day"], users="v")
    for days in (1, 7, 30):
        some = F.col("day") < days
        got = {r.kind: r.users for r in K.estimates(K.united(daily.where(some), ["kind"], "users"), "users").collect()}
        want = {r.kind: r.n for r in df.where(some).groupBy("kind").agg(F.countDistinct("v").alias("n")).collect()}
        assert got.keys() == want.keys()
        assert all(abs(got[k] - want[k]) <= K.error() * want[k] for k in want), (got, want)
    again = K.united(daily.union(daily), ["kind"], "users")
    assert sorted(K.estimates(again, "users").collect()) == sorted(K.estimates(K.united(daily, ["kind"], "users"), "users").collect())


def test_nothing_to_count(spark):
    df = spark.createDataFrame([("a", None), ("b", 1), ("b", 1)], "k string, v int")
    assert sorted((r.k, r.n) for r in K.estimates(K.sketches(df, ["k"], n="v"), "n").collect()) == [("a", 0), ("b", 1)]
    assert K.estimates(K.sketches(df.limit(0), ["k"], n="v"), "n").count() == 0
