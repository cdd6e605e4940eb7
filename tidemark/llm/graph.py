"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import drop_stash, stash


def _stars(edges: DataFrame) -> tuple[int, int]:
    r = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return r["n"], r["h"]


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges``: (u, v) long. Returns (node, label): the smallest node that each linked node can reach.

    Nodes without edges, self loops and null ends are not in the result. Every round replaces each node's edges by
    edges to the smallest neighbour, first for larger neighbours, then for smaller ones; the number of rounds is
    logarithmic in the diameter. The smallest neighbours are stashed before they are joined back, so both sides of
    each join are plain exchanges that adaptive execution can split when one node has a large share of all edges.
    """
    a, b = F.col("u"), F.col("v")
    now = stash(edges.where((a != b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    before, mark = None, _stars(now)
    while mark != before and mark[0]:
        both = now.unionByName(now.select(b.alias("u"), a.alias("v")))
        low = stash(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "low")
        large = stash(both.join(low, "u").where(b > a).select(b.alias("u"), F.col("m").alias("v")).distinct(), "large")
        least = stash(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        joined = large.join(least, "u")
        small = joined.select(F.explode(F.array(F.struct(a.alias("u"), F.col("m").alias("v")), F.struct(b.alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where(a != b).distinct()
        done = now
        now = stash(small, "edges")
        for x in (done, low, large, least):
            drop_stash(x)
        before, mark = mark, _stars(now)
    return now.select(F.col("u").alias("node"), b.alias("label")).unionByName(now.select(b.alias("node"), b.alias("label")).distinct())
