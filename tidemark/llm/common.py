"""What the operators of this subpackage share: word rules, folds, the shared folder and stashed tables."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The six characters that separate words, and the words' pattern.
BREAKS = " \t\n\x0b\x0c\r"
BREAK_RUN = r"[\x20\x09-\x0D]+"

_own_dir: dict[str, str] = {}
#: Spark's setting for deleting a query's shuffle files when the query ends.
_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder from spark.checkpoint.dir. Where that is unset, a temporary one on a local master
    (tests) and an error on a cluster, whose executors would not see the driver's folder."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if d:
        return d.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dir:
        _own_dir[app] = "file://" + tempfile.mkdtemp(prefix="tidemark-")
    return _own_dir[app]


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: lineage ends there, and any executor can
    reread it after another is lost. The shuffle files behind it go when the table is whole."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidemark/{uuid.uuid4().hex}/{name}"
    before = spark.conf.get(_TIDY, "false")
    spark.conf.set(_TIDY, "true")
    try:
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_TIDY, before)
    return spark.read.schema(df.schema).parquet(path)


def drop_stash(*tables: DataFrame) -> None:
    """Delete stashed tables that nothing reads any more; files outside of stashes stay."""
    for df in tables:
        spark = df.sparkSession
        for f in {x.rpartition("/")[0] for x in df.inputFiles()}:
            if not re.search(r"/tidemark/[0-9a-f]{32}/[^/]+$", f):
                continue
            p = spark._jvm.org.apache.hadoop.fs.Path(f)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p.getParent(), True)


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and use it in ``body`` many times, within one projection."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text as an array; null and blank texts have none."""
    t = F.btrim(text, F.lit(BREAKS))
    return F.when(F.coalesce(t, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(t, BREAK_RUN, -1))


def fold(key: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(n))


def blobs(column) -> list:
    """An Arrow string column as a list of UTF-8 bytes and None."""
    import pyarrow as pa

    return column.cast(pa.binary() if not pa.types.is_large_string(column.type) else pa.large_binary()).to_pylist()


def tokens(text: bytes) -> tuple:
    """The words of a text whose gaps are spaces and line feeds: a number for each, the line each is in, and the words
    by number. Nothing here walks over single words in Python."""
    import numpy as np
    import pyarrow as pa

    raw = np.frombuffer(text, np.uint8)
    end = raw == 10
    inside = ~(end | (raw == 32))
    edge = np.diff(inside, prepend=False, append=False).nonzero()[0]
    start, stop = edge[::2], edge[1::2]
    at = np.zeros(len(start) + 1, np.int64)
    np.cumsum(stop - start, out=at[1:])
    coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(at), pa.py_buffer(raw[inside])]).dictionary_encode()
    line = np.cumsum(end, dtype=np.int32)[start] if len(start) else np.zeros(0, np.int32)
    return coded.indices.to_numpy().astype(np.int64), line, coded.dictionary
