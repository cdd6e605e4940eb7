"""Every query of the engine's own operators against its SQL in DuckDB, on the smallest tables."""

import datetime
import decimal
import math

import duckdb
import pytest

from tidemark.plans import catalog

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


#: Queries that SQL doesn't express, with the rows they give at least; what they hold is tested beside them.
UNSPOKEN = {"breaker_states": 1, "classify_documents_decided": 1, "document_score_shares": 1, "page_text": 1, "page_metadata": 1, "page_blocks": 1, "roster_parse": 0, "publication_parse": 0}


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float | decimal.Decimal):
        v = float(v)
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, datetime.datetime | datetime.date):
        return v.isoformat()
    return v


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, FOLDER)
    if name not in catalog.ORACLES:
        assert name in UNSPOKEN, "a query without SQL needs a test of its own"
        assert df.count() >= UNSPOKEN[name]
        return
    same(duck, df, catalog.ORACLES[name])


@pytest.mark.parametrize("name", sorted(catalog.CASES))
def test_cases(spark, duck, name):
    rule, sql = catalog.CASES[name]
    same(duck, rule(spark, FOLDER), sql)


def same(duck, df, sql):
    cols = sorted(df.columns)
    got = ordered(tuple(plain(r[c]) for c in cols) for r in df.collect())
    res = duck.execute(sql)
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert got == ordered(tuple(plain(r[i]) for i in at) for r in res.fetchall())


def test_every_oracle_has_a_query():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)
