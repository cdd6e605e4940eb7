"""A grouped read model that follows a stream: deltas of each batch merged into hashed buckets, untouched ones left alone.

The model is a Parquet table cut by a hash of its keys. A batch is grouped first, so its delta is small; only buckets that
it touches are read and written again, by dynamic partition overwrite. Each row carries the batch that changed it last, and
a bucket that already holds a batch's rows isn't merged again, so a batch that is run twice counts once, even if the first
run ended between two buckets.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Merge = Callable[[str], Column]

add: Merge = F.sum
least: Merge = F.min
most: Merge = F.max


def newest(version: str) -> Merge:
    """The value of the highest version; a version that comes late loses, an equal one doesn't replace."""
    return lambda c: F.max_by(c, F.struct(version, -F.col("__batch")))


class ReadModel:
    """``merges`` names the measures and how two values of a key become one; measures of a delta have the same names."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], merges: dict[str, Merge], buckets: int = 64) -> None:
        self.spark, self.path, self.keys, self.merges, self.buckets = spark, path, keys, merges, buckets

    def rows(self) -> DataFrame | None:
        """The model as it is; None before the first batch."""
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p):
            return None
        return self.spark.read.option("basePath", self.path).parquet(self.path)

    def merge(self, delta: DataFrame, batch: int) -> None:
        """Take in one batch: ``delta`` has the keys and measures, one row or several a key."""
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        new = delta.select(*self.keys, *self.merges, F.lit(batch).cast("long").alias("__batch"), bucket.alias("bucket"))
        new = new.groupBy("bucket", *self.keys).agg(*[f(c).alias(c) for c, f in self.merges.items()], F.max("__batch").alias("__batch")).persist()
        try:
            touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # at most ``buckets`` numbers
            old = self.rows()
            if old is not None and touched:
                old = old.where(F.col("bucket").isin(touched))
                done = {r["bucket"] for r in old.groupBy("bucket").agg(F.max("__batch").alias("m")).where(F.col("m") >= batch).collect()}
                touched = [b for b in touched if b not in done]
                both = old.unionByName(new).where(F.col("bucket").isin(touched))
                new_rows = both.groupBy("bucket", *self.keys).agg(*[f(c).alias(c) for c, f in self.merges.items()], F.max("__batch").alias("__batch"))
            else:
                new_rows = new
            if touched:
                new_rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path)
        finally:
            new.unpersist()

    def follow(self, stream: DataFrame, grouped: Callable[[DataFrame], DataFrame], checkpoint: str, seconds: int = 600) -> DataFrame:
        """Merge all that a stream holds, batch by batch; ``grouped`` makes a batch's delta."""
        run = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda df, i: self.merge(grouped(df), i)).start()
        if not run.awaitTermination(seconds):
            run.stop()
            raise TimeoutError(f"the stream did not end within {seconds} s")
        return self.rows()
