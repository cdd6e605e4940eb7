"""Ranked lexical search: an inverted index of compressed blocks with maximum impacts, searched by Block-Max WAND.

The index is cut by documents: a shard holds the documents of a few megabytes of text, in order of their ids, and one
row per term with its postings in blocks of ``BLOCK``. A block is varints of id gaps and occurrences; its header, which
is read alone, has the first and last document, and the pairs of occurrences and length from which its largest impact
follows for any weights and any average length: pairs that another beats in both are left out.

A search moves over block headers only (shallow moves): where blocks begin and end, the sum of the maxima of those that
overlap bounds every document of the stretch. Stretches below the tenth score so far are passed over, and their blocks
never decompressed. In the others, lists are opened by falling bound, and no further once what is left can't lift any
document to the tenth score. Each shard returns its best; the best of all are ranked.

Edge cases: null, empty and termless texts have no postings and don't count as documents; an item without known terms
has no rows; rows that repeat an item's id are one item with all their terms; rows that repeat a document are documents
of their own; a null id comes after all others; a text of any length is one document; extra columns are not read; empty
tables give no rows. Ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import blobs, stash, tokens

# A term is a run of other characters than these, with A-Z lower-cased.
GAPS = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BYTES = bytes(32 if c < 48 or 57 < c < 65 or 90 < c < 97 or 122 < c < 128 else c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Postings of a block, and bytes of text of a shard.
BLOCK = 64
SHARD = 32 << 20
#: Items that a task searches for at once, and terms up to which they are broadcast (under 200 bytes each).
ITEMS = 1000
BROADCAST_TERMS = 200_000
#: Stretches that set the first threshold, and that are opened together.
PRIME = STEP = 32

INDEX = "shard long, term string, df int, heads binary, data binary, ids array<long>, sizes array<int>"


def _varints(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers as bytes, seven bits each, and where each number begins."""
    size = np.ones(len(v), np.int64)
    for bits in range(7, 63, 7):
        if not (more := v >= 1 << bits).any():
            break
        size += more
    at = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    for k in range(int(size.max(initial=1))):
        own = size > k
        out[at[own] + k] = (v[own] >> 7 * k & 127) | np.where(size[own] > k + 1, 128, 0)
    return out, at


def _numbers(data: np.ndarray) -> np.ndarray:
    """What ``_varints`` wrote."""
    last = np.flatnonzero(data < 128)
    if len(last) == len(data):
        return data.astype(np.int64)
    begin = np.concatenate([[0], last[:-1] + 1])
    shift = 7 * (np.arange(len(data)) - np.repeat(begin, last - begin + 1))
    return np.add.reduceat((data & 127).astype(np.int64) << shift, begin)


def _shard(number: int, ids: list, texts: list[bytes]) -> Iterator[pa.RecordBatch]:
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))
    word, doc, words = tokens(b"\n".join(texts[i].translate(_BYTES) for i in order))
    n_docs = len(ids)
    sizes = np.bincount(doc, minlength=n_docs).astype(np.int64)
    key, tf = np.unique(word * n_docs + doc, return_counts=True)
    term, doc = np.divmod(key, n_docs)
    df = np.bincount(term, minlength=len(words))
    begin = np.cumsum(df) - df  # of a term's postings
    inner = np.arange(len(key)) - begin[term]
    head = inner % BLOCK == 0
    block = np.cumsum(head) - 1
    first = np.flatnonzero(head)
    last = np.append(first[1:], len(key))[: len(first)] - 1
    gap = np.where(head, doc, np.diff(doc, prepend=0))
    data, at = _varints(np.stack([gap, tf], 1).ravel())
    blocks = -(-df // BLOCK)
    first_block = np.cumsum(blocks) - blocks
    owner = np.repeat(np.arange(len(words)), blocks)

    # Of each block, by rising length, the pairs whose occurrences exceed those of all shorter documents.
    length = sizes[doc]
    by = np.argsort(block * (int(length.max(initial=0)) + 1) + length, kind="stable")
    rank = block[by] * (int(tf.max(initial=0)) + 1) + tf[by]
    best = np.maximum.accumulate(rank) if len(rank) else rank
    stand = np.flatnonzero(np.append(True, rank[1:] > best[:-1])) if len(rank) else np.zeros(0, np.int64)
    pair_block, pair_n, pair_tf = block[by][stand], length[by][stand], tf[by][stand]
    pairs = np.bincount(pair_block, minlength=len(first))
    pair_at = np.cumsum(pairs) - pairs
    pairs_of = np.bincount(owner, weights=pairs, minlength=len(words)).astype(np.int64)

    # A term's header: first and last document, end of the bytes and of the pairs of each block, then the pairs.
    width = 4 * blocks + 2 * pairs_of
    base = np.cumsum(width) - width
    heads = np.zeros(int(width.sum()), np.int32)
    local = np.arange(len(first)) - first_block[owner]
    byte_at = np.append(at[::2], len(data))  # of each posting, and the end
    stop = byte_at[np.append(first[1:], len(key))[: len(first)]] if len(first) else first
    origin = byte_at[begin] if len(words) else begin
    put = lambda k, v: heads.__setitem__(base[owner] + k * blocks[owner] + local, v)
    put(0, doc[first])
    put(1, doc[last])
    put(2, stop - origin[owner])
    put(3, pair_at + pairs - pair_at[first_block[owner]])
    mine = owner[pair_block] if len(pair_block) else pair_block
    spot = base[mine] + 4 * blocks[mine] + 2 * (np.arange(len(stand)) - pair_at[first_block[mine]])
    heads[spot], heads[spot + 1] = pair_n, pair_tf

    cut = lambda ends, buf: pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(words), [None, pa.py_buffer(ends), pa.py_buffer(buf)]).cast(pa.binary())
    heads = cut(np.append(base, len(heads)).astype(np.int64) * 4, heads)
    data = cut(np.append(origin, len(data)).astype(np.int64), data)
    names = ["shard", "term", "df", "heads", "data", "ids", "sizes"]
    longs, ints = pa.list_(pa.int64()), pa.list_(pa.int32())
    one = [pa.array([number], pa.int64()), pa.nulls(1, pa.string()), pa.array([int((sizes > 0).sum())], pa.int32()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()), pa.array([[ids[i] for i in order]], longs), pa.array([sizes.astype(np.int32)], ints)]
    yield pa.RecordBatch.from_arrays(one, names)
    for a in range(0, len(words), 1 << 15):
        n = min(1 << 15, len(words) - a)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, number)), words.slice(a, n).cast(pa.binary()).cast(pa.string()), pa.array(df[a : a + n], pa.int32()), heads.slice(a, n), data.slice(a, n), pa.nulls(n, longs), pa.nulls(n, ints)], names)


def _build(shard: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        ids, texts, size = [], [], 0
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), blobs(b.column(1))):
                if t:
                    ids.append(i)
                    texts.append(t)
                    size += len(t)
                if size >= shard:
                    yield from _shard(number, ids, texts)
                    ids, texts, size, number = [], [], 0, number + 1
        if ids:
            yield from _shard(number, ids, texts)

    return run


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard: int | None = None) -> DataFrame:
    """The index of all rows of ``docs``, written to the shared folder; texts are read once and never shuffled.

    One row per shard without a term (documents with terms, ids, sizes), one per shard and term (documents, headers and
    bytes of its blocks).
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return stash(rows.mapInArrow(_build(shard or SHARD), INDEX), "index")


def terms(text: Column) -> Column:
    """The terms of a text, repeats included."""
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(f"([^{GAPS}]+)"), F.lit(1))


class Postings:
    """A term's list in one shard: headers at once, blocks when they are opened."""

    def __init__(self, df: int, heads: bytes, data: bytes, middle: np.ndarray, average: tuple[int, int]) -> None:
        h = np.frombuffer(heads, np.int32).astype(np.int64)
        n = -(-df // BLOCK)
        self.first, self.last, self.stop, ends = h[:n], h[n : 2 * n], h[2 * n : 3 * n], h[3 * n : 4 * n]
        pairs = h[4 * n :].reshape(-1, 2)
        begin = np.append(0, ends[:-1])
        self.most = np.maximum.reduceat(impact(pairs[:, 1], damping(pairs[:, 0], *average)), begin)
        self.data, self.middle, self.opened = np.frombuffer(data, np.uint8), middle, {}

    def open(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and impacts of block ``k``; what one item opened is there for the others."""
        if k not in self.opened:
            v = _numbers(self.data[self.stop[k - 1] if k else 0 : self.stop[k]])
            doc = np.cumsum(v[::2])
            self.opened[k] = doc, impact(v[1::2], self.middle[doc])
        return self.opened[k]


def damping(size: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    return 100 - 75 + (75 * size * n_docs) // n_terms


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def best(lists: list[tuple[int, Postings]], n_docs: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` best documents of a shard and their scores; ``lists`` has the weight of each term and its postings."""
    lists = sorted((x for x in lists if x[0]), key=lambda x: -x[0] * int(x[1].most.max()))
    docs, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not lists:
        return docs, scores
    # Shallow: bounds of all stretches between the begins and ends of blocks, from headers alone.
    bound = np.concatenate([w * p.most for w, p in lists])
    edge = np.concatenate([p.first for _, p in lists] + [p.last + 1 for _, p in lists])
    at, which = np.unique(edge, return_inverse=True)
    step = np.zeros(len(at), np.int64)
    np.add.at(step, which, np.concatenate([bound, -bound]))
    upper = np.cumsum(step)  # of the stretch from at[i] up to at[i + 1]
    least, todo = 1, upper > 0

    def look(a: int, b: int) -> None:
        """Score the documents of the stretches a to b."""
        nonlocal docs, scores, least
        lo, hi = int(at[a]), int(at[b + 1])
        spans = [(np.searchsorted(p.last, lo), np.searchsorted(p.first, hi)) for _, p in lists]
        left = sum(w * int(p.most[x:y].max()) for (w, p), (x, y) in zip(lists, spans) if x < y)
        total = np.zeros(hi - lo, np.int64)
        for (w, p), (x, y) in zip(lists, spans):
            if x >= y:
                continue
            if int(total.max()) + left < least:
                return
            left -= w * int(p.most[x:y].max())
            for i in range(x, y):
                d, v = p.open(i)
                s, e = np.searchsorted(d, (lo, hi))
                total[d[s:e] - lo] += w * v[s:e]
        own = np.flatnonzero(total >= least)
        if len(own):
            docs, scores = np.append(docs, own + lo), np.append(scores, total[own])
            order = np.lexsort((docs, -scores))[:k]
            docs, scores = docs[order], scores[order]
            if len(docs) == k:
                least = int(scores[-1])  # a stretch that only reaches it may still hold a smaller id

    for i in np.argsort(-upper, kind="stable")[:PRIME]:
        if todo[i] and upper[i] >= least:
            look(i, i)
            todo[i] = False
    i = 0
    while i < len(at) - 1:
        if not todo[i] or upper[i] < least:
            rest = np.flatnonzero(todo[i + 1 :] & (upper[i + 1 :] >= least))
            if not len(rest):
                break
            i += 1 + int(rest[0])
        j = i
        while j + 1 < min(len(at) - 1, i + STEP) and todo[j + 1] and upper[j + 1] >= least:
            j += 1
        look(i, j)
        i = j + 1
    return docs, scores


def _search(n_docs: int, n_terms: int, k: int):
    def run(t: pa.Table) -> pa.Table:
        rows = t.to_pylist()
        own = next(r for r in rows if r["term"] is None)
        ids, middle = own["ids"], damping(np.array(own["sizes"], np.int64), n_docs, n_terms)
        asked: dict[int | None, list[tuple[int, Postings]]] = {}
        for r in rows:
            if r["term"] is not None:
                p = Postings(r["df"], r["heads"], r["data"], middle, (n_docs, n_terms))
                for q in r["asks"]:
                    asked.setdefault(q["item_id"], []).append((r["weight"] * q["times"], p))
        items, docs, scores = [], [], []
        for item, lists in asked.items():
            d, s = best(lists, len(ids), k)
            items += [item] * len(d)
            docs += [ids[i] for i in d]
            scores += s.tolist()
        return pa.table({"item_id": pa.array(items, pa.int64()), "doc_id": pa.array(docs, pa.int64()), "score": pa.array(scores, pa.int64())})

    return run


def search(index: DataFrame, items: DataFrame, k: int = 10, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of the index for each row of ``items``.

    A task searches one shard for at most about ``ITEMS`` items; it gets the postings of their terms alone.
    """
    asked = items.select(F.col(id_col).cast("long").alias("item_id"), F.explode(terms(F.col(text_col).cast("string"))).alias("term")).groupBy("item_id", "term").agg(F.count("*").alias("times"))
    asked = stash(asked, "asked")
    n_items = asked.select("item_id").distinct().count()
    parts = max(1, -(-n_items // ITEMS))
    part = F.pmod(F.xxhash64("item_id"), F.lit(parts))
    wanted = stash(asked.groupBy(part.alias("part"), "term").agg(F.collect_list(F.struct("item_id", "times")).alias("asks")), "wanted")
    few = wanted.count() <= BROADCAST_TERMS  # with the askers of a term, at most ITEMS pairs, this is small for few terms
    send = F.broadcast if few else (lambda x: x)
    n_docs, n_terms = index.where("term IS NULL").agg(F.sum("df"), F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x))).first()
    found = index.where("term IS NOT NULL")
    known = found.select("term", "df").join(send(wanted.select("term").distinct()), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("n"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * (n_docs or 0) + 2) / (2 * F.col("n") + 1))).cast("long")
    weighed = wanted.join(known.select("term", weight.alias("weight")), "term")
    hits = found.join(send(weighed), "term").select("shard", "part", "term", "df", "heads", "data", "ids", "sizes", "weight", "asks")
    own = index.where("term IS NULL").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    none = lambda c: F.lit(None).cast(dict(hits.dtypes)[c]).alias(c)
    own = own.select("shard", "part", "term", "df", "heads", "data", "ids", "sizes", none("weight"), none("asks"))
    rows = hits.unionByName(own).groupBy("shard", "part").applyInArrow(_search(n_docs or 0, n_terms or 1, k), "item_id long, doc_id long, score long")
    order = W.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
