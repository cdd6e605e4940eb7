"""Queries against their SQL on rows that the smallest tables don't hold."""

import duckdb
import pytest

from test_queries import same
from tidemark.plans import catalog

PAGE = "<html><head><title>{0}</title></head><body><nav><a href=\"/x\">Home</a></nav><article><h1>{0}</h1><p>Text.</p></article></body></html>"
#: References that are cut off, not ended, other than the usual four, or written as text.
TITLES = ["A &amp;&amp;&amp", "token = &quot;7&quot", "&lt;b&gt; &copy; R&D &#38; 1", "&amp;lt; &am", "C"]
PAGES = [(i, PAGE.format(TITLES[i % 5])) for i in (*range(40), *range(10_000, 10_010), 99_999, 100_000)]
TABLES = {"pages": ("page_id long, html string", PAGES), "customer": ("c_custkey long", [(i,) for i in (*range(1990, 2040), 20_250, 202_501)])}


@pytest.mark.parametrize(
    "name, table",
    [
        ("article_headings", "pages"),
        ("page_main", "pages"),
        ("page_records", "pages"),
        ("page_sections", "pages"),
        ("page_snapshots", "pages"),
        ("recruiting_scan", "customer"),
    ],
)
def test_odd_rows(spark, tmp_path, name, table):
    kind, rows = TABLES[table]
    spark.createDataFrame(rows, kind).write.parquet(f"{tmp_path}/{table}.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
    same(con, catalog.QUERIES[name](spark, str(tmp_path)), catalog.ORACLES[name])
