"""Breadth-first walks over fetched pages: one recursive query, a row for each visit of a site.

A walk reads pages in the order in which they were found, none twice, until it has read or found enough. Its state is a
row: what is still to be read, what was read, what was found, all bounded by the limits. A level takes every site one page
on by a join with what each page leads to, so sites walk side by side and links that meet or turn back cost nothing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import relational as R
from tidemark.streaming.windows import shared_folder


def _firsts(rows: DataFrame, site: str, name: str, most: int) -> DataFrame:
    """(site, page, the first ``most`` different addresses on it in order)."""
    once = rows.groupBy(F.col(site).alias("site"), "page", "url").agg(F.min("place").alias("place"))
    top = R.topk_per_key(once, ["site", "page"], [F.asc("place"), F.asc("url")], most, "__r")
    return top.groupBy("site", "page").agg(F.transform(F.array_sort(F.collect_list(F.struct("__r", "url"))), lambda x: x["url"]).alias(name))


def walk(links: DataFrame, found: DataFrame, home: DataFrame, site: str, pages: int, most: int, distinct: bool = True) -> DataFrame:
    """(site, page, visit from 1) of the pages that each site's walk reads: ``pages`` at most, and none once ``most``
    addresses are found, each once if ``distinct``.

    ``links`` and ``found``: (site, page, place, url), what leads on and what is looked for; ``home``: (site, place, url),
    where to begin. Links are read by place, equal places by address. Null sites, pages and addresses take no part. A page
    that nothing is known of is read and leads nowhere. What pages lead to is written to the shared folder once, since each
    level reads it again. The session's limits of recursive queries (a million rows, a hundred levels) are lifted, since the
    walk ends by its own.
    """
    spark = links.sparkSession
    for limit in ("spark.sql.cteRecursionRowLimit", "spark.sql.cteRecursionLevelLimit"):
        spark.conf.set(limit, "-1")
    whole = [c.where(F.col(site).isNotNull() & F.col("url").isNotNull()) for c in (links, found, home)]
    links, found, home = whole[0].where(F.col("page").isNotNull()), whole[1].where(F.col("page").isNotNull()), whole[2]
    # Of a page's links no more than pages are followed, and no more than pages are behind it already.
    onward = _firsts(links, site, "onward", 2 * pages)
    if distinct:
        got = _firsts(found, site, "got", most)
    else:
        got = found.groupBy(F.col(site).alias("site"), "page").agg(F.count(F.lit(1)).alias("got"))
    folder = f"{shared_folder(spark)}/walk-{uuid.uuid4().hex}"
    onward.join(got, ["site", "page"], "full").write.parquet(folder)
    start = _firsts(home.withColumn("page", F.lit("")), site, "queue", pages).select("site", "queue")
    none = "cast(array() as array<string>)"
    more, enough, zero = (f"slice(array_union(w.got, coalesce(n.got, {none})), 1, {most})", f"size(got) < {most}", none) if distinct else ("w.got + coalesce(n.got, 0L)", f"got < {most}", "0L")
    out = spark.sql(
        f"""WITH RECURSIVE w(site, visit, page, queue, seen, got) AS (
            SELECT site, 1, queue[0], slice(queue, 2, {pages}), array(queue[0]), {zero} FROM {{start}}
            UNION ALL
            SELECT site, visit + 1, queue[0], slice(queue, 2, {pages}), array_append(seen, queue[0]), got FROM (
                SELECT w.site, w.visit, w.seen, {more} AS got, slice(array_except(array_union(w.queue, coalesce(n.onward, {none})), w.seen), 1, {pages} - w.visit) AS queue
                FROM w LEFT JOIN {{nxt}} n ON w.site = n.site AND w.page = n.page WHERE w.visit < {pages})
            WHERE {enough} AND size(queue) > 0)
        SELECT site, page, visit FROM w""",
        start=start,
        nxt=spark.read.parquet(folder),
    )
    return out.withColumnRenamed("site", site)


def first_found(visits: DataFrame, found: DataFrame, site: str, most: int, extra: list[Column] | None = None) -> DataFrame:
    """(site, rank, url) of the first ``most`` different addresses in the order of the walk."""
    j = found.join(visits, [site, "page"])
    g = j.groupBy(site, "url").agg(F.min(F.struct("visit", "place")).alias("__first"), *(extra or []))
    return R.topk_per_key(g, site, [F.asc("__first"), F.asc("url")], most, "rank").drop("__first")
