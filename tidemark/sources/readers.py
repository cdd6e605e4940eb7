"""Sources and sinks: delimited registries, JSON feeds, site maps, catalogs, audit and event files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def registry(spark: SparkSession, path: str) -> DataFrame:
    """A registry of institutions in CSV (UNITID, INSTNM and more): rows with an all-digit id and a name; flags are true,
    false or unknown; addresses get a scheme. A byte order mark and bad bytes do no harm."""
    raw = spark.read.csv(path, header=True, encoding="UTF-8", mode="PERMISSIVE")
    raw = raw.toDF(*[c.lstrip("﻿").strip() for c in raw.columns])
    gone = [c for c in ("UNITID", "INSTNM") if c not in raw.columns]
    if gone:
        raise ValueError(f"missing columns: {', '.join(gone)}")
    has = lambda c: F.trim(F.col(c)) if c in raw.columns else F.lit(None).cast("string")
    flag = lambda c: F.when(has(c) == "1", True).when(has(c) == "0", False)
    url = has("INSTURL")
    home = F.when(F.coalesce(url, F.lit("")) == "", None).when(url.rlike("(?i)^https?://"), url).otherwise(F.concat(F.lit("https://"), url))
    return raw.where(F.trim("UNITID").rlike(r"^\d+$") & (F.trim("INSTNM") != "")).select(F.trim("UNITID").cast("long").alias("unit_id"), F.trim("INSTNM").alias("name"), has("STABBR").alias("state"), home.alias("homepage"), flag("CURROPER").alias("operating"))


def awards(raw: DataFrame, body: str) -> DataFrame:
    """Awards of two feeds as one shape: investigators may be one object or a list, fields go by either feed's name."""
    v = F.try_parse_json(F.col(body))
    get = lambda *paths: F.coalesce(*[F.try_variant_get(v, p, "string") for p in paths])
    return raw.select("*", get("$.title", "$.project_title").alias("title"), get("$.id", "$.project_num").alias("award_id"), get("$.fundsObligatedAmt", "$.award_amount").cast("decimal(14,2)").alias("amount"), get("$.pi.name", "$.investigators[0].name", "$.investigators.name", "$.piName").alias("investigator"))


def people_feed(raw: DataFrame, body: str, most: int = 1000) -> DataFrame:
    """People of an embedded JSON list; ``most`` is the feed's own limit for each page."""
    kind = "array<struct<name:string,title:string,email:string,url:string>>"
    return raw.select("*", F.explode(F.slice(F.from_json(F.col(body), kind), 1, most)).alias("__p")).select(*raw.columns, "__p.*")


def sitemap(raw: DataFrame, xml: str, most: int = 10_000) -> DataFrame:
    """A row per location of a site map, and whether it is a map itself."""
    locs = F.array_distinct(F.slice(F.xpath(F.col(xml), F.lit("//*[local-name()='loc']/text()")), 1, most))
    return raw.select("*", F.explode(locs).alias("loc")).withColumn("is_map", F.col("loc").rlike(r"(?i)sitemap[^/]*\.xml"))


#: An address of a site map, in any namespace, bare or as character data. Its end begins with white space or one of two
#: signs, so what stands before the first of these needs no look for it.
LOCATION = r"(?is)<(?:[\w-]+:)?loc\b[^>]*>\s*(?:<!\[CDATA\[)?([^<\]\s]*+.*?)(?:\]\]>)?\s*</(?:[\w-]+:)?loc\s*>"


def sitemap_locations(raw: DataFrame, xml: str, most: int = 10_000) -> DataFrame:
    """A row per location of a site map as it stands, with its place; the first ``most`` of a map, the feed's own limit.
    Broken documents give what can be read of them, others and nulls nothing."""
    loc = F.trim("loc")
    for mark, letter in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        loc = F.replace(loc, F.lit(mark), F.lit(letter))
    locs = F.slice(F.regexp_extract_all(F.col(xml), F.lit(LOCATION), F.lit(1)), 1, most)
    return raw.select("*", F.posexplode(locs).alias("place", "loc")).withColumn("loc", loc)


def merged_hits(sources: list[DataFrame], key: str, order: list, limit: int) -> DataFrame:
    """Results of several providers with equal columns, the first provider's of each key, best first."""
    from functools import reduce

    from tidemark.operators.relational import distinct_on

    rows = reduce(DataFrame.unionByName, [s.withColumn("__p", F.lit(i)) for i, s in enumerate(sources)])
    return distinct_on(rows, key, [F.col("__p"), *order]).orderBy("__p", *order).limit(limit).drop("__p")


def catalog_columns(spark: SparkSession) -> DataFrame:
    """(table, column, type) of the session's catalog."""
    rows = [(t.name, c.name, c.dataType) for t in spark.catalog.listTables() for c in spark.catalog.listColumns(t.name)]
    return spark.createDataFrame(rows, "table string, column string, type string")


def taxonomy_seeds(spark: SparkSession, groups: dict[str, list[str]]) -> DataFrame:
    rows = [(g, t, i) for g, ts in groups.items() for i, t in enumerate(ts)]
    return spark.createDataFrame(rows, "topic_group string, topic string, position int")


def write_audit(df: DataFrame, path: str) -> None:
    """One CSV file with a header; audits are small reports."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_events(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def snapshot(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)
