"""Queries that walk documents made of the tables: site maps of customers, pages of units of suppliers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import composites as C
from tidemark.plans.registry import query, table

#: Each customer is a site whose map names a map per order and each order's map a map of late lines; maps name the first
#: one again. A walk ends at 7 maps (the second usual one is missing) or 12 addresses, whichever comes first.
_PAGES, _MOST = 7, 12


def _site(key: str):
    return F.concat(F.lit("c"), F.col(key).cast("string"), F.lit(".edu"))


def _map(urls):
    return F.concat(F.lit("<urlset>"), F.array_join(F.transform(urls, lambda u: F.concat(F.lit("<url><loc> "), u, F.lit(" </loc></url>"))), ""), F.lit("</urlset>"))


@query(
    "sitemap_walk",
    f"""WITH l AS (SELECT o_custkey c, o_orderkey o, l_linenumber n, l_partkey % 50 p, l_linenumber > 3 late, row_number() OVER (PARTITION BY o_orderkey, l_linenumber > 3 ORDER BY l_linenumber, l_partkey) place FROM orders JOIN lineitem ON l_orderkey = o_orderkey),
    maps AS (SELECT c, o, late, count(*) n FROM l GROUP BY ALL UNION ALL SELECT c, o, FALSE, 0 FROM l GROUP BY 1, 2 HAVING min(n) > 3),
    turns AS (SELECT c, o, late, n, 2 + row_number() OVER (PARTITION BY c ORDER BY late, o) visit FROM maps),
    read AS (SELECT * FROM (SELECT *, coalesce(sum(n) OVER (PARTITION BY c ORDER BY visit ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) sofar FROM turns) WHERE visit <= {_PAGES} AND sofar < {_MOST}),
    found AS (SELECT c, p, min(visit * 1000 + place) first FROM (SELECT read.c, p, visit, place FROM read JOIN l ON l.c = read.c AND l.o = read.o AND l.late = read.late) GROUP BY 1, 2),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY first) r FROM found)
    SELECT 'c' || c || '.edu' site, r::INTEGER AS rank, 'https://c' || c || '.edu/faculty/' || p url FROM ranked WHERE r <= {_MOST}""",
)
def sitemap_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of possible directories from every customer's site maps, in the order of the walk."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")  # noqa: E741
    j = l.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    top = F.concat(F.lit("https://"), _site("o_custkey"))
    home = F.concat(top, F.lit("/sitemap.xml"))
    of = lambda late: F.concat(top, F.lit("/late-" if late else "/order-"), F.col("o_orderkey").cast("string"), F.lit(".xml"))
    line = lambda late: F.array_sort(F.collect_list(F.when((F.col("l_linenumber") > 3) == F.lit(late), F.struct("l_linenumber", "l_partkey"))))
    orders = j.groupBy("o_custkey", "o_orderkey").agg(line(False).alias("soon"), line(True).alias("late"))
    address = lambda x: F.concat(top, F.lit("/faculty/"), (x["l_partkey"] % 50).cast("string"))
    news = F.array(F.concat(top, F.lit("/news/today")), F.lit("https://other.org/m.xml"), home)
    of_late = F.when(F.size("late") > 0, F.array(of(True))).otherwise(F.array().cast("array<string>"))
    maps = orders.select(_site("o_custkey").alias("site"), F.inline(F.array(
        F.struct(of(False).alias("page"), _map(F.concat(F.transform("soon", address), news, of_late)).alias("xml")),
        F.struct(of(True).alias("page"), _map(F.transform("late", address)).alias("xml")),
    )))
    first = orders.groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("os"))
    url = lambda k: F.concat(top, F.lit("/order-"), k.cast("string"), F.lit(".xml"))
    roots = first.select(_site("o_custkey").alias("site"), home.alias("page"), _map(F.transform("os", url)).alias("xml"))
    return C.sitemap_directories(roots.unionByName(maps), "site", _PAGES, _MOST)
