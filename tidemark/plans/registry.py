"""All registered queries of the engine's own operators with their SQL, gathered from the modules that define them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
#: Rules on literal cases with the values they must give; tests run them, they are no queries of the engine.
CASES: dict[str, tuple[Query, str]] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``name``, with the SQL that gives the same rows where SQL can express it."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def case(name: str, sql: str) -> Callable[[Query], Query]:
    """Keep a rule on literal cases for the tests."""

    def add(f: Query) -> Query:
        CASES[name] = f, sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
