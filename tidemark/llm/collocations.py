"""Collocations: phrases whose parts meet more often than apart, counted over all n-grams of all texts.

Texts are cut into pieces at punctuation and pieces into words. Every run of 1 to ``max_n`` words of a piece becomes a
row (fingerprint, times), where the runs of a few megabytes of text are combined before they leave their task, and rows
are aggregated by fingerprint, 64 bits of language and phrase. Only runs whose fingerprint occurs ``least`` times or more
can be frequent; a second reading gives those their words, and their counts are taken by language and phrase, so two
phrases of one fingerprint cost a row and nothing else. Every part of a frequent phrase is as frequent itself.

Edge cases: null, empty and wordless texts have no phrase; a null language is ``und``; repeated rows count each time;
texts of any length are read whole, one longer than a buffer alone in its buffer; extra columns are not read; an empty
table gives no rows. Ties are ordered by count and then by the phrase's UTF-8 bytes. Counts up to 10^15 are exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import blobs, stash, tokens

# What ends a piece, and what parts the words of a piece.
PIECE_END = b".,;:!?\n\x0b\x0c\r"
GAPS = b" \t"
_BYTES = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ" + PIECE_END + GAPS, b"abcdefghijklmnopqrstuvwxyz" + b"\n" * len(PIECE_END) + b" " * len(GAPS))
#: Bytes of text whose runs are combined at once.
BUFFER = 16 << 20
#: Fingerprints that are sent to all tasks, 8 bytes each; beyond it runs meet them in a join.
SENT = 4 << 20
#: Parts in which a language is ranked before it is ranked as a whole.
SHARES = 256
#: 7 + 15 + 15 digits above, 18 + 18 below: neither product is rounded, and DIV drops what is left over.
SCORE = "CAST(1000000 AS DECIMAL(7,0)) * CAST(a AS DECIMAL(15,0)) * CAST(a AS DECIMAL(15,0)) DIV (CAST(l AS DECIMAL(18,0)) * CAST(r AS DECIMAL(18,0)))"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _runs(text: bytes, max_n: int, lang: str | None) -> Iterator[tuple[np.ndarray, np.ndarray, Callable[[np.ndarray], pa.Array]]]:
    """The distinct runs of 1 to ``max_n`` words, one length after the other: their fingerprints, how often each occurs, and
    a function that gives the phrases of some of them."""
    import xxhash

    ids, piece, words = tokens(text)
    if not len(ids):
        return
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words.to_pylist()), np.uint64, len(words))
    prints = _mix(hashes ^ np.uint64(xxhash.xxh64_intdigest(lang or "")))
    yield prints, np.bincount(ids, minlength=len(words)), lambda own: words.take(pa.array(own))
    key, names = ids, (lambda own: words.take(pa.array(own)))  # the run that begins at each word
    for k in range(1, max_n):
        same = piece[k:] == piece[: len(piece) - k]
        if not same.any():
            return
        pair = key[: len(ids) - k][same] * len(words) + ids[k:][same]
        found = np.sort(pair)
        first = np.flatnonzero(np.diff(found, prepend=-1))
        times, found = np.diff(first, append=len(found)), found[first]
        head, tail = np.divmod(found, len(words))
        prints = _mix(prints[head] * np.uint64(0xD1B54A32D192ED03) + hashes[tail])

        def names(own: np.ndarray, before=names, head=head, tail=tail) -> pa.Array:
            return pc.binary_join_element_wise(before(head[own]), words.take(pa.array(tail[own])), pa.scalar(b" ", pa.large_binary()))

        yield prints, times, names
        if k + 1 < max_n:
            key = np.zeros(len(ids), np.int64)
            key[: len(same)][same] = np.searchsorted(found, pair)


def _read(max_n: int, buffer: int, rows: Callable, names: list[str]):
    """Runs of a buffer's texts, language by language; ``rows`` makes columns of the runs of one length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str | None, list[bytes]] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for lang in sorted(held):
                for n, found in enumerate(_runs(b"\n".join(held[lang]).translate(_BYTES), max_n, lang), 1):
                    for columns in rows(lang, n, *found):
                        yield pa.RecordBatch.from_arrays(columns, names)
            held.clear()
            pa.default_memory_pool().release_unused()

        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), blobs(b.column(1))):
                if text:
                    held.setdefault(lang, []).append(text)
                    size += len(text)
                if size >= buffer:
                    yield from flush()
                    size = 0
        yield from flush()

    return run


def _texts(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("text"))


def prints(docs: DataFrame, max_n: int, text_col: str = "text", lang_col: str = "lang", buffer: int | None = None) -> DataFrame:
    """Rows (h, lang, f): the fingerprints of all runs, combined within a task's buffers, and one row per buffer and language
    with the number of its words under a null fingerprint."""

    def rows(lang: str, n: int, h: np.ndarray, times: np.ndarray, names: Callable) -> Iterator[list]:
        if n == 1:
            yield [pa.nulls(1, pa.int64()), pa.array([lang]), pa.array([int(times.sum())], pa.int64())]
        for at in range(0, len(h), 1 << 18):
            part = h[at : at + (1 << 18)].view(np.int64)
            yield [pa.array(part), pa.nulls(len(part), pa.string()), pa.array(times[at : at + (1 << 18)], pa.int64())]

    return _texts(docs, text_col, lang_col).mapInArrow(_read(max_n, buffer or BUFFER, rows, ["h", "lang", "f"]), "h long, lang string, f long")


def ngrams(docs: DataFrame, max_n: int, text_col: str = "text", lang_col: str = "lang", buffer: int | None = None, kept=None) -> DataFrame:
    """Rows (lang, words, phrase, h, f) of all runs, combined within a task's buffers; ``kept``, a broadcast array of rising
    fingerprints, leaves those that it holds."""

    def rows(lang: str, n: int, h: np.ndarray, times: np.ndarray, names: Callable) -> Iterator[list]:
        h = h.view(np.int64)
        own = np.arange(len(h))
        if kept is not None:
            at = np.searchsorted(kept.value, h)
            at[at == len(kept.value)] = 0
            own = np.flatnonzero(kept.value[at] == h) if len(kept.value) else own[:0]
        for a in range(0, len(own), 1 << 18):
            some = own[a : a + (1 << 18)]
            yield [pa.repeat(lang, len(some)), pa.array(np.full(len(some), n, np.int32)), names(some).cast(pa.binary()).cast(pa.string()), pa.array(h[some]), pa.array(times[some], pa.int64())]

    return _texts(docs, text_col, lang_col).mapInArrow(_read(max_n, buffer or BUFFER, rows, ["lang", "words", "phrase", "h", "f"]), "lang string, words int, phrase string, h long, f long")


def frequent(docs: DataFrame, max_n: int, least: int, text_col: str = "text", lang_col: str = "lang", buffer: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(lang, words, phrase, f) of all phrases that occur ``least`` times, and (lang, n) with the words of each language."""
    # Combined rows are dealt out as they are: another count before the shuffle would find little to add up.
    rows = prints(docs, max_n, text_col, lang_col, buffer)
    counts = rows.repartition("h", "lang").groupBy("h", "lang").agg(F.sum("f").alias("f")).where((F.col("f") >= least) | F.col("h").isNull())
    counts = stash(counts, "prints")
    total = counts.where("h IS NULL").select("lang", F.col("f").alias("n"))
    known = counts.where("h IS NOT NULL").select("h")
    if known.count() <= SENT:
        kept = docs.sparkSession.sparkContext.broadcast(np.sort(known.toArrow().column("h").to_numpy()))
        runs = ngrams(docs, max_n, text_col, lang_col, buffer, kept)
    else:
        runs = ngrams(docs, max_n, text_col, lang_col, buffer).join(known, "h", "left_semi")
    return runs.groupBy("lang", "words", "phrase").agg(F.sum("f").alias("f")).where(F.col("f") >= least), total


def collocations(docs: DataFrame, max_n: int = 3, least: int = 10, cover: int = 50, top: int = 2000, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The first ``top`` phrases of each language: (lang, rank, phrase, a, l, r, n, score).

    a, l and r count the phrase and the two parts of its lowest-scoring cut, n the words of the language; score is
    floor(10^6 a^2 / (l r)). A phrase goes if a phrase one word longer that holds it occurs ``cover`` percent as often:
    any longer one holds such a phrase, which occurs as often at least.
    """
    phrases, total = frequent(docs, max_n, least, text_col, lang_col)
    known = stash(phrases, "phrases")
    cand = known.where("words > 1").select("lang", "words", "phrase", F.col("f").alias("a"))
    w = F.split("phrase", " ", -1)
    span = lambda a, n: F.array_join(F.slice(F.col("w"), a, n), " ")

    longer = cand.where("words > 2").withColumn("w", w)
    held = longer.select("lang", "a", F.explode(F.array(span(1, F.col("words") - 1), span(2, F.col("words") - 1))).alias("phrase"))
    held = held.groupBy("lang", "phrase").agg(F.max("a").alias("longest"))
    c, h = cand.alias("c"), held.alias("h")
    alone = c.join(h, (F.col("c.lang") == F.col("h.lang")) & (F.col("c.phrase") == F.col("h.phrase")) & (100 * F.col("h.longest") >= cover * F.col("c.a")), "left_anti")

    cuts = alone.withColumn("w", w).withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", span(1, F.col("k")).alias("left"), span(F.col("k") + 1, F.col("words") - F.col("k")).alias("right"))
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    score = F.expr(SCORE)
    best = cuts.select("lang", "phrase", "a", F.struct(score.alias("score"), "k", "l", "r").alias("cut")).groupBy("lang", "phrase", "a").agg(F.min("cut").alias("cut"))
    rows = best.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    # The first of each of SHARES parts of a language hold the first of all, so no task ranks a whole language.
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    share = F.pmod(F.xxhash64("phrase"), F.lit(SHARES))
    rows = rows.withColumn("part", share).withColumn("at", F.row_number().over(W.partitionBy("lang", "part").orderBy(*order))).where(F.col("at") <= top)
    ranked = rows.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
