"""Queries of institution identity over a registry made of all customers, with chains of aliases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import identity as I
from tidemark.plans.registry import query, table

#: Of seven customers in a row each is an alias of the one before; one in four names is in no registry. The first main
#: campus of a chain speaks for it.
_REGISTRY = "(SELECT c_custkey id, 'Collège of Arts & Science ' || c_custkey AS name, c_mktsegment = 'BUILDING' main, 'u' || c_custkey // 2 || '.edu' AS domain, c_custkey // 7 chain FROM customer WHERE c_custkey % 4 <> 3)"
_SPEAKER = f"(SELECT DISTINCT ON (chain) * FROM {_REGISTRY} ORDER BY chain, main DESC, id)"


def _registry(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    name = lambda x: F.concat(F.lit("Collège of Arts & Science "), x.cast("string"))
    domain = F.concat(F.lit("u"), F.floor(k / 2).cast("string"), F.lit(".edu"))
    rows = c.where(k % 4 != 3).select(k.alias("id"), name(k).alias("name"), (F.col("c_mktsegment") == "BUILDING").alias("main"), domain.alias("domain"))
    return rows, c.where(k % 7 != 0).select(name(k).alias("name"), name(k - 1).alias("alias"))


def _spelt(k, form):
    return F.concat(F.when(form == 0, "COLLEGE OF ARTS SCIENCE ").when(form == 1, "collége of arts, science - ").otherwise("The College of Arts & Science "), k.cast("string"))


@query(
    "institution_identity",
    f"""SELECT o_orderkey, CASE WHEN o_orderkey % 3 < 2 THEN s.id END institution_id, CASE WHEN o_orderkey % 3 < 2 AND s.id IS NOT NULL THEN s.name ELSE ['COLLEGE OF ARTS SCIENCE ', 'collége of arts, science - ', 'The College of Arts & Science '][o_orderkey % 3 + 1] || o_custkey END institution
    FROM orders LEFT JOIN {_SPEAKER} s ON s.chain = o_custkey // 7""",
)
def institution_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order names its customer in one of three spellings, the last of which is no registered name."""
    registry, aliases = _registry(spark, sf_dir)
    names = I.registry_names(registry, aliases, [F.desc("main")])
    o = table(spark, sf_dir, "orders").select("o_orderkey", _spelt(F.col("o_custkey"), F.col("o_orderkey") % 3).alias("said"))
    return I.canonical(o, "said", names).select("o_orderkey", "institution_id", "institution")


@query(
    "institution_pairs",
    "SELECT o_orderkey, (o_custkey = o_orderkey % 150) OR (o_custkey // 7 = o_orderkey % 150 // 7 AND o_orderkey % 150 IN (SELECT c_custkey FROM customer) AND o_custkey IN (SELECT c_custkey FROM customer)) equivalent FROM orders",
)
def institution_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    registry, aliases = _registry(spark, sf_dir)
    names = I.registry_names(registry, aliases, [F.desc("main")])
    o = table(spark, sf_dir, "orders").select("o_orderkey", _spelt(F.col("o_custkey"), F.lit(0)).alias("l"), _spelt(F.col("o_orderkey") % 150, F.lit(1)).alias("r"))
    return I.equivalent(o, "l", "r", names).select("o_orderkey", "equivalent")


@query(
    "institution_hosts",
    f"SELECT o_orderkey, d.id institution_id, d.name institution FROM orders LEFT JOIN (SELECT DISTINCT ON (domain) * FROM {_REGISTRY} ORDER BY domain, main DESC, id) d ON d.domain = 'u' || o_custkey || '.edu' AND o_orderkey % 3 < 2",
)
def institution_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts below a domain, with capitals and a dot behind, and hosts whose name only ends alike."""
    registry, _ = _registry(spark, sf_dir)
    k, form = F.col("o_custkey").cast("string"), F.col("o_orderkey") % 3
    host = F.when(form == 0, F.concat(F.lit("www.cs.u"), k, F.lit(".edu"))).when(form == 1, F.concat(F.lit("U"), k, F.lit(".EDU."))).otherwise(F.concat(F.lit("notu"), k, F.lit(".edu")))
    o = table(spark, sf_dir, "orders").select("o_orderkey", host.alias("host"))
    return I.of_hosts(o, "o_orderkey", "host", registry, [F.desc("main")]).select("o_orderkey", "institution_id", "institution")
