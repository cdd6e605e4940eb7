"""Institutions told apart by a registry: names and aliases closed into canonical ids, hosts by the longest known domain.

Nothing is matched by likeness. Two names are one institution if their keys are equal or a chain of registered aliases
leads from one to the other; campuses that share a domain stay apart.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import unicode
from tidemark.functions.text import plain
from tidemark.operators import relational as R
from tidemark.streaming.windows import shared_folder


def name_key(c: Column) -> Column:
    """Words of a-z and 0-9 of the folded name, one blank between; null for a name without any."""
    return F.nullif(plain(unicode.fold_marks(F.replace(F.lower(c), F.lit("ß"), F.lit("ss")))), F.lit(""))


def _kept(df: DataFrame) -> DataFrame:
    path = f"{shared_folder(df.sparkSession)}/identity-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def closure(links: DataFrame, a: str, b: str, keep: Callable[[DataFrame], DataFrame] = _kept) -> DataFrame:
    """(node, root): the least node that a chain of links reaches from each linked node, itself included.

    Each round points every node to the least root among its neighbours' and then to that root's own root, so a chain
    halves. A node's neighbours are reduced before they meet, so a node with most links is no bottleneck. Each round is
    a table in the shared folder. Links with a null end and to oneself say nothing.
    """
    e = links.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x <> y")
    e = keep(e.unionByName(e.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct())
    now = keep(e.groupBy("x").agg(F.min("y").alias("low")).select(F.col("x").alias("node"), F.least("x", "low").alias("root")))
    while True:
        # Every link carries a root to the root at its other end: trees hang themselves under lesser ones.
        near = e.join(now.select(F.col("node").alias("y"), F.col("root").alias("r")), "y").groupBy("x").agg(F.min("r").alias("r"))
        met = now.join(near.select(F.col("x").alias("node"), "r"), "node").select("node", "root", F.least("root", "r").alias("r"))
        hook = met.groupBy("root").agg(F.min("r").alias("under"))
        step = keep(met.join(hook, "root").select("node", F.least("r", "under").alias("root"), F.col("root").alias("was")))
        up = step.select(F.col("node").alias("root"), F.col("root").alias("top"))
        then = keep(step.join(up, "root").select("node", F.col("top").alias("root"), "was"))
        if then.where("root <> was").isEmpty():
            return then.select("node", "root")
        now = then.select("node", "root")


def registry_names(registry: DataFrame, aliases: DataFrame, order: list[Column]) -> DataFrame:
    """(key, root, id, name): each known name with its institution, ``root`` being the least key of its aliases. ``registry``: (id, name, ...); ``aliases``: (name, alias), pairs
    of names in any order. Of the records that aliases join, or that share a name, the first by ``order`` and then id
    gives id and name; aliases without any record have neither."""
    rows = registry.withColumn("key", name_key(F.col("name"))).where("key IS NOT NULL AND id IS NOT NULL")
    pairs = _kept(aliases.select(name_key(F.col("name")).alias("a"), name_key(F.col("alias")).alias("b")))
    own = rows.select("key").union(pairs.select("a")).union(pairs.select("b")).where("key IS NOT NULL").distinct()
    roots = own.join(closure(pairs, "a", "b").withColumnRenamed("node", "key"), "key", "left").select("key", F.coalesce("root", "key").alias("root"))
    first = R.distinct_on(rows.join(roots, "key"), "root", [*order, F.asc("id")]).select("root", "id", "name")
    return roots.join(first, "root", "left").select("key", "root", "id", "name")


def canonical(mentions: DataFrame, name: str, names: DataFrame) -> DataFrame:
    """Mentions with ``institution_id`` and ``institution``: the registered name, or the name as written without an id."""
    n = names.select(F.col("key").alias("__k"), F.col("id").alias("institution_id"), F.col("name").alias("__name"))
    j = mentions.withColumn("__key", name_key(F.col(name))).join(n, F.col("__key") == F.col("__k"), "left")
    return j.withColumn("institution", F.coalesce("__name", name)).drop("__key", "__k", "__name")


def equivalent(pairs: DataFrame, left: str, right: str, names: DataFrame) -> DataFrame:
    """Pairs with ``equivalent``: equal keys, or joined by aliases. A pair with a name without a key is none."""
    root = lambda side: names.select(F.col("key").alias(f"__{side}"), F.col("root").alias(f"__{side}r"))
    j = pairs.withColumn("__l", name_key(F.col(left))).withColumn("__r", name_key(F.col(right)))
    j = j.join(root("l"), "__l", "left").join(root("r"), "__r", "left")
    return j.withColumn("equivalent", F.coalesce((F.col("__l") == F.col("__r")) | (F.col("__lr") == F.col("__rr")), F.lit(False))).drop("__l", "__r", "__lr", "__rr")


def of_hosts(hosts: DataFrame, id_col: str, host: str, registry: DataFrame, order: list[Column]) -> DataFrame:
    """Hosts with ``institution_id`` and ``institution`` by the longest of their suffixes that is a registered domain; of
    records with one domain the first by ``order`` and then id. ``id_col`` tells the rows apart."""
    known = registry.where("domain <> ''").withColumn("__domain", F.lower("domain"))
    dim = R.distinct_on(known, "__domain", [*order, F.asc("id")]).select("__domain", F.col("id").alias("institution_id"), F.col("name").alias("institution"))
    h = hosts.withColumn("__host", F.regexp_replace(F.lower(F.coalesce(host, F.lit(""))), r"\.+$", ""))
    return R.suffix_host_join(h, "__host", dim, "__domain", id_col, ["institution_id", "institution"]).drop("__host")
