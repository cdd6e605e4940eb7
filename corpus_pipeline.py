"""A training corpus from raw documents: rules, near copies, repeated passages, secrets, packing.

Each stage takes what the one before kept; run() writes every stage as Parquet into the shared folder and rereads it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import packing, quality_rules, recompression, secrets, simhash
from tidemark.llm.common import shared_dir

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass every quality rule."""
    return quality_rules.quality_filter(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: SimHash prints of five-word shingles within 4 bits, or a similarity of 0.8 or more."""
    return simhash.keep_first(docs, shingle=5, similarity=0.8, distance=4)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of passages that also start earlier."""
    return recompression.cut_repeats(docs, window=50)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets masked."""
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 4096 ids, with the ids."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2, length=4096, ids=True)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality),
    ("simhash_near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("secret_scans", redact_secrets),
    ("packing", pack),
]

#: The stages on fingerprints, recompression and token ids have no form in SQL; they are tested against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    top = f"{shared_dir(spark)}/tidemark/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(f"{top}/{name}")
        docs = spark.read.parquet(f"{top}/{name}")
    return docs
