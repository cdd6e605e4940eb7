"""Event-time operators; each works on a stream and, but for the stateful one, gives the same on a batch."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of a folder as a stream of files, with its own schema."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    s = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(folder)
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(df: DataFrame, size: str, by: list[str], late: str = "10 minutes") -> DataFrame:
    return df.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), *by).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), *by, "n", "total")


def sliding(df: DataFrame, size: str, step: str, by: list[str], late: str = "10 minutes") -> DataFrame:
    return df.withWatermark("ts", late).groupBy(F.window("ts", size, step).alias("w"), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), *by, "n")


def sessions(df: DataFrame, gap: str, by: list[str], late: str = "10 minutes") -> DataFrame:
    """Runs of events with no longer pause than the gap: liveness of a heartbeat."""
    return df.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), *by, "n")


def first_of_key(df: DataFrame, keys: list[str], late: str) -> DataFrame:
    """Active-key dedupe on a stream: later events of a key within the watermark are dropped."""
    return df.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def live(df: DataFrame, at: str, as_of: Column, ttl: str) -> DataFrame:
    """Rows that have not outlived their time."""
    return df.where(F.col(at).cast("timestamp") > as_of - F.expr(ttl))


BREAKER = "user_id long, failures int, blocked boolean"


def circuit_breaker(df: DataFrame, threshold: int = 3) -> DataFrame:
    """Per key: consecutive failures so far, and whether the circuit has opened; state lives across batches."""

    def step(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, blocked = state.get if state.exists else (0, False)
        for kind in pd.concat(list(batches)).sort_values(["ts", "event_id"])["event_type"]:  # a key may span Arrow batches
            n = n + 1 if kind == "error" else 0
            blocked = blocked or n >= threshold
        state.update((n, blocked))
        yield pd.DataFrame([(key[0], n, blocked)], columns=["user_id", "failures", "blocked"])

    return df.groupBy("user_id").applyInPandasWithState(step, BREAKER, "failures int, blocked boolean", "update", "NoTimeout")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset, a new one on a local master and an error on a cluster."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if top is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        top = "file://" + tempfile.mkdtemp(prefix="tidemark-stream-")
    return top


def run_to_table(stream: DataFrame, mode: str, keys: list[str] | None = None, folder: str | None = None, seconds: int = 600) -> DataFrame:
    """Run a stream over all that is there and return what it gave last; the result is a Parquet table.

    In update mode ``keys`` name the rows: of each the last batch's counts. A stream that doesn't end within
    ``seconds``, or fails, raises.
    """
    spark = stream.sparkSession
    top = folder or shared_folder(spark)
    if mode == "update" and not keys:
        raise ValueError("update mode needs the keys that name a row")
    top = f"{top}/stream-{uuid.uuid4().hex}"

    def sink(batch: DataFrame, epoch: int) -> None:
        # Each batch has a folder of its own, so a batch that is run again replaces itself.
        out = f"{top}/out" if mode == "complete" else f"{top}/out/batch={epoch}"
        batch.write.mode("overwrite").parquet(out)

    run = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{top}/checkpoint").trigger(availableNow=True).foreachBatch(sink).start()
    if not run.awaitTermination(seconds):
        run.stop()
        raise TimeoutError(f"the stream did not end within {seconds} s")
    if mode == "complete":
        return spark.read.schema(stream.schema).parquet(f"{top}/out")
    every = spark.read.option("basePath", f"{top}/out").parquet(f"{top}/out")
    if mode == "append":
        return every.select(*stream.columns)
    last = every.groupBy(*keys).agg(F.max_by(F.struct(*stream.columns), F.col("batch")).alias("r"))
    return last.select("r.*")
