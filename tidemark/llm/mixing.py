"""Mixing sources to target weights: exact block quotas, dealt to output shards by a hypergeometric splitting tree.

1. Targets: sources share all words by weight, none above ``repeat`` times its own words; the excess goes round again.
2. A source's documents are laid end to end in a hashed order, once for each pass over it, up to its quota of words.
   The line is cut into blocks of equal length, the last one shorter.
3. Output shards take equal numbers of blocks. How many of each source a shard takes is drawn by halving: the blocks of
   a node go to its left half as a multivariate hypergeometric draw, down to single shards, so every shard is a random
   sample of the whole and the quotas are met exactly.
4. Each source's blocks are permuted by a keyed bijection and dealt to the shards in runs; a shard shuffles its own.

All draws are keyed by the seed and the node, source or document, so reruns and retried tasks agree.

Edge cases: null and blank texts have size 0 and are taken 0 times; a null source is a source, after all others; rows
that repeat a document are documents of their own; a text of any length is one row; extra columns are not read; an
empty table gives no rows; where all sizes are 0 all targets are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import stash

#: Levels of the splitting tree that one round of tasks draws below each node.
LEVELS = 6
#: A draw's population has at most so many blocks; the block grows beyond it.
MOST_BLOCKS = 1 << 29


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(row, doc_id, source, size, print): each row of ``docs`` with a number of its own, its count of words and a hash
    of what it holds, so that the order does not hang on how the table was read."""
    n = F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    return docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), n.alias("size"), F.xxhash64(F.col(id_col), F.col(source_col), F.col(text_col)).alias("print"))


def targets(sized: DataFrame, weights: tuple[float, ...] = (5, 2, 1), repeat: int = 3) -> DataFrame:
    """(source, source_size, source_no, weight, target): sources in order of their code points, null last, take the weights in turn.

    One row per source is all that is held; a round sends two sums to the driver, and a source that reached its limit
    stays there, so there are at most as many rounds as sources and in practice a few.
    """
    per = stash(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    # Ranks come from one row per source, never from documents.
    per = per.withColumn("source_no", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())).cast("long") - 1)
    weight = F.array(*[F.lit(float(w)) for w in weights])[F.expr(f"CAST(source_no % {len(weights)} AS INT)")]
    per = stash(per.withColumn("weight", weight), "weights")
    limit = repeat * F.col("source_size")
    total = per.agg(F.sum("source_size")).first()[0] or 0
    share = 0.0
    while True:
        free = F.col("weight") * share < limit
        open_, closed = per.agg(F.sum(F.when(free, F.col("weight"))), F.coalesce(F.sum(F.when(~free, limit)), F.lit(0))).first()
        if not open_:
            break
        level = (total - closed) / open_
        if level <= share:
            break
        share = level
    return per.withColumn("target", F.least(F.col("weight") * share, limit.cast("double")))


def _feistel(x: np.ndarray, bits: int, key: int) -> np.ndarray:
    """A bijection of the numbers of ``bits`` (even) binary digits: four rounds on the two halves."""
    half = np.uint64(bits // 2)
    mask = np.uint64((1 << (bits // 2)) - 1)
    left, right = x >> half, x & mask
    for r in range(4):
        m = (right + np.uint64((key * 0x9E3779B97F4A7C15 + r * 0xD1B54A32D192ED03) % (1 << 64))) * np.uint64(0xBF58476D1CE4E5B9)
        m = (m ^ (m >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        left, right = right, left ^ ((m ^ (m >> np.uint64(32))) & mask)
    return (left << half) | right


def permuted(block: np.ndarray, count: int, key: int) -> np.ndarray:
    """The place of each block among ``count``: a keyed bijection of a power of four, walked until it falls inside."""
    bits = max(2, (int(count - 1).bit_length() + 1) // 2 * 2)
    x = _feistel(block.astype(np.uint64), bits, key)
    while (far := x >= count).any():
        x[far] = _feistel(x[far], bits, key)
    return x.astype(np.int64)


def _place(seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key, block, count = (b.column(n).to_numpy() for n in ("key", "block", "blocks"))
            out, order = np.zeros(len(key), np.int64), np.argsort(key, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(key[order])) + 1) if len(key) else []:
                out[own] = permuted(block[own], int(count[own[0]]), int(key[own[0]]) ^ seed)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out)], [*b.schema.names, "place"])

    return run


def _halve(seed: int, levels: int, shards: int, blocks: int):
    """Draws ``levels`` levels below a node. Node k of a level stands for the shards from k * width on."""
    upto = lambda shard: shard * blocks // shards  # noqa: E731  blocks of the shards before

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("key")
        first, width = t["first"][0].as_py(), t["width"][0].as_py()
        key, row = t["key"].combine_chunks(), t["source_no"].to_numpy()
        out = []

        def split(counts: np.ndarray, first: int, width: int, left: int) -> None:
            if width == 1 or not left:
                if counts.any():
                    own = counts.nonzero()[0]
                    out.append((first, width, own, counts[own]))
                return
            half = width // 2
            take = upto(min(first + half, shards)) - upto(min(first, shards))
            rng = np.random.default_rng([seed, first, width])
            one = rng.multivariate_hypergeometric(counts, take, method="marginals")
            split(one, first, half, left - 1)
            split(counts - one, first + half, half, left - 1)

        split(t["n"].to_numpy().astype(np.int64), first, width, levels)
        own = np.concatenate([o[2] for o in out])
        spread = [len(o[2]) for o in out]
        at = lambda i: pa.array(np.repeat([o[i] for o in out], spread).astype(np.int64))
        return pa.Table.from_arrays([at(0), at(1), key.take(pa.array(own)), pa.array(row[own]), pa.array(np.concatenate([o[3] for o in out]))], ["first", "width", "key", "source_no", "n"])

    return run


def deal(quotas: DataFrame, shards: int, blocks: int, seed: int) -> DataFrame:
    """(first, key, source_no, n): the blocks of each source that shard ``first`` takes, from (key, source_no, n) for all
    sources. A task holds one count per source of its node."""
    width = 1 << max(0, math.ceil(math.log2(max(1, shards))))
    tree = quotas.select(F.lit(0).cast("long").alias("first"), F.lit(width).cast("long").alias("width"), "key", "source_no", "n").where("n > 0")
    while width > 1:
        levels = min(LEVELS, width.bit_length() - 1)
        tree = stash(tree.groupBy("first", "width").applyInArrow(_halve(seed, levels, shards, blocks), "first long, width long, key long, source_no long, n long"), "tree")
        width >>= levels
    return tree.drop("width")


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), repeat: int = 3, block_words: int = 4096, shard_words: int = 1 << 22, seed: int = 11, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """The mixture and its documents, after the steps in the head of this file.

    The mixture has one row per piece: (shard, slot, at, row, doc_id, pass, start, length), words ``start`` to
    ``start + length`` of the document in slot ``slot`` of output shard ``shard``, ``at`` words into its block. The
    documents are (row, doc_id, source, size, source_size, target). A source takes floor(target) words, a document at
    most ``repeat`` times each of its words.
    """
    sized = stash(sizes(docs, id_col, text_col, source_col), "sizes")
    per = targets(sized, weights, repeat)
    quota = F.floor("target").cast("long")
    key = F.xxhash64(F.coalesce("source", F.lit("")), F.col("source").isNull())
    per = stash(per.withColumn("quota", quota).withColumn("key", key), "targets")
    rows, words = sized.count(), per.agg(F.sum("quota")).first()[0] or 0
    size = max(block_words, -(-words // MOST_BLOCKS))
    per = per.withColumn("blocks", F.ceil(F.col("quota") / F.lit(size)).cast("long"))
    blocks = per.agg(F.sum("blocks")).first()[0] or 0
    shards = max(1, -(-words // shard_words))

    # Places on a source's line: totals of hashed buckets first, then the order inside each bucket.
    buckets = max(1, math.isqrt(rows))
    known = per.select(F.col("source").alias("s"), "source_no", "key", "source_size", "quota", "blocks")
    turns = sized.where("size > 0").join(known, F.col("source").eqNullSafe(F.col("s")))
    passes = F.when(F.col("quota") > 0, F.sequence(F.lit(0).cast("long"), F.expr("(quota - 1) div source_size"))).otherwise(F.array().cast("array<bigint>"))
    turns = turns.withColumn("pass", F.explode(passes))
    mark = F.xxhash64("print", "pass", F.lit(seed))
    turns = turns.select("row", "doc_id", "source_no", "key", "source_size", "quota", "blocks", "size", "pass", mark.alias("mark")).withColumn("bucket", F.shiftrightunsigned("mark", 8) % F.lit(buckets))
    turns = stash(turns, "turns")
    whole = turns.groupBy("source_no", "pass", "bucket").agg(F.sum("size").alias("words"))
    before = F.sum("words").over(W.partitionBy("source_no", "pass").orderBy("bucket").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("words")
    whole = whole.select("source_no", "pass", "bucket", before.alias("before"))
    inside = F.sum("size").over(W.partitionBy("source_no", "pass", "bucket").orderBy("mark", "row").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("size")
    line = turns.withColumn("inside", inside).join(whole, ["source_no", "pass", "bucket"])
    line = line.withColumn("lo", F.col("pass") * F.col("source_size") + F.col("before") + F.col("inside"))
    line = line.withColumn("hi", F.least(F.col("lo") + F.col("size"), F.col("quota"))).where("lo < hi")
    pieces = line.withColumn("block", F.explode(F.sequence(F.expr(f"lo div {size}"), F.expr(f"(hi - 1) div {size}"))))
    start = F.greatest(F.col("lo"), F.col("block") * size)
    stop = F.least(F.col("hi"), (F.col("block") + 1) * size)
    pieces = pieces.select("row", "doc_id", "source_no", "key", "blocks", "pass", "block", (start - F.col("lo")).alias("start"), (stop - start).alias("length"), (start - F.col("block") * size).alias("at"))
    kinds = dict(pieces.dtypes)
    pieces = pieces.mapInArrow(_place(seed), ", ".join(f"{c} {kinds[c]}" for c in pieces.columns) + ", place long")

    # A shard's run of a source's places, entered under every bin of places that it reaches.
    dealt = deal(per.select("key", "source_no", F.col("blocks").alias("n")), shards, blocks, seed).join(per.select("source_no", "blocks"), "source_no")
    to = F.sum("n").over(W.partitionBy("source_no").orderBy("first").rowsBetween(W.unboundedPreceding, W.currentRow))
    per_bin = F.expr(f"greatest(blocks div {shards}, 1L)")
    runs = dealt.select("source_no", F.col("first").alias("shard"), (to - F.col("n")).alias("from"), to.alias("to"), per_bin.alias("w"))
    runs = runs.withColumn("bin", F.explode(F.sequence(F.expr("`from` div w"), F.expr("(`to` - 1) div w")))).drop("w")
    found = pieces.withColumn("bin", F.expr(f"place div greatest(blocks div {shards}, 1L)")).join(runs, ["source_no", "bin"]).where("place >= `from` AND place < `to`")
    slot = F.dense_rank().over(W.partitionBy("shard").orderBy(F.xxhash64("source_no", "block", F.lit(seed)), "source_no", "block")) - 1
    mixed = found.select("shard", slot.cast("long").alias("slot"), "at", "row", "doc_id", "pass", "start", "length")
    known = per.select(F.col("source").alias("s"), "source_size", "target")
    return mixed, sized.join(known, F.col("source").eqNullSafe(F.col("s"))).drop("s", "print")
