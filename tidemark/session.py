"""Session factory: UTC, adaptive execution, Arrow transfer, shuffle partitions by cores unless the cluster sets them."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "tidemark", master: str | None = None, cores: int | None = None, **conf: str) -> SparkSession:
    """A session with the settings that results depend on (UTC) and those that scale depends on (adaptive plans).

    ``master`` and ``cores`` are for local runs; on a cluster both come from spark-submit.
    """
    b = SparkSession.builder.appName(name)
    if master:
        b = b.master(master)
    if cores:
        b = b.config("spark.sql.shuffle.partitions", str(cores))
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.cteRecursionRowLimit": "-1",  # walks give a row for each visit of each site
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()
