"""Toxicity: nearest labelled examples by exact TF-IDF cosine over a block-max inverted index; weighted votes.

The examples are a bounded sample of labelled rows. Vectors are over all terms of the examples, without a limit: term
frequency (log) times inverse document frequency over all documents, counted from the share ``common`` of them on (terms
of more documents weigh nothing, unless they speak for the label), and times the term's standard errors where the
examples show that it speaks for the label. The index holds the examples in blocks with each term's largest weight per
block; a query visits blocks from the largest bound down and stops when no block can reach its k-th best cosine, so its
neighbours are exact. Votes weigh by the squared cosine beside a little weight of the prior; the share of votes is
calibrated on sampled rows that are no examples and had no part in weights, and the neighbours are the evidence.

Terms are known by 64-bit hashes (XXH64), so what goes to tasks is arrays of numbers. Bags of terms, their counts and the
calibration's votes are made in tasks; the driver sees the examples' counted terms and vectors and no text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import blobs, drop_stash, fold, stash

TERM = re.compile(rb"[a-z0-9\x80-\xff]+")
#: The prior's vote beside those of neighbours, in squared cosines.
BLANK = 0.25
TIE = 1e-12
#: Blocks that a query visits first, and the most that it visits by their own parts of the lists.
FIRST, MANY = 8, 24


def terms(text: bytes | None) -> list[bytes]:
    """Runs of lower-cased letters and digits; other scripts by their bytes."""
    return TERM.findall((text or b"").decode("utf-8", "replace").lower().encode())


#: Hashes of terms that a worker keeps, in Python's dictionary.
KEPT = 1 << 19
_hashes: dict[bytes, int] = {}


def bag_of(text: bytes | None) -> dict[int, int]:
    """The hashes of a text's terms and how often each occurs."""
    import xxhash

    if len(_hashes) > KEPT:
        _hashes.clear()
    count = Counter(terms(text))
    own = list(map(_hashes.get, count))
    if None in own:
        for i, w in enumerate(count):
            if own[i] is None:
                h = xxhash.xxh64_intdigest(w)
                _hashes[w] = own[i] = h - (1 << 64) if h >> 63 else h
    return dict(zip(own, count.values()))


def copy_mark(bag: dict[int, int]) -> int:
    """One number for a text and most of its near copies: of the two terms of lowest hash."""
    import xxhash

    return xxhash.xxh64_intdigest(repr(sorted(bag)[:2]).encode()) >> 1


def _bag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, y, text) -> its terms with their frequencies."""
    for b in batches:
        for i in range(b.num_rows):
            bag = bag_of(blobs(b.column(2).slice(i, 1))[0])
            yield pa.RecordBatch.from_arrays(
                [b.column(0).slice(i, 1), b.column(1).slice(i, 1), pa.array([copy_mark(bag)], pa.int64()), pa.array([list(bag)], pa.list_(pa.int64())), pa.array([list(bag.values())], pa.list_(pa.int32()))],
                ["doc_id", "y", "mark", "terms", "tf"],
            )


def stresses(on: np.ndarray, off: np.ndarray, n_on: float, n_off: float, least_z: float = 5.0, least_n: float = 4.0) -> np.ndarray:
    """The factor of each term, from the (weighted) texts with the label and without that hold it: the standard errors
    by which the label's texts hold it more often, if that's at least ``least_z`` and five times as often; else 1."""
    if not n_on or not n_off:
        return np.ones(len(on))
    p = (on + off) / (n_on + n_off)
    z = (on / n_on - off / n_off) / np.sqrt(p * (1 - p) * (1 / n_on + 1 / n_off) + 1e-12)
    return np.where((z >= least_z) & (on >= least_n) & (on / n_on >= 5 * off / n_off), z, 1.0)


def _spread(start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """All places of the ranges [start, stop), one after another."""
    size = stop - start
    total = np.cumsum(size)
    return np.repeat(stop - total, size) + np.arange(int(total[-1]) if len(total) else 0)


class BlockMaxIndex:
    """Examples as sparse unit vectors in blocks, with the largest weight of each term in each block."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], labels: list[int], ids: list[int], n_terms: int, block: int = 32) -> None:
        # Examples with a like strongest term stand together, so that bounds differ between blocks.
        lead = [int(t[w.argmax()]) if len(t) else -1 for t, w in vectors]
        order = sorted(range(len(vectors)), key=lambda i: (lead[i], labels[i], ids[i]))
        self.labels = np.array([labels[i] for i in order], float)
        self.ids = np.array([ids[i] for i in order], np.int64)
        self.n_blocks, self.in_block = -(-len(order) // block), block
        size = np.array([len(vectors[i][0]) for i in order], np.int64)
        row = np.repeat(np.arange(len(order)), size)
        term = np.concatenate([vectors[i][0] for i in order]) if order else np.zeros(0, np.int64)
        weight = np.concatenate([vectors[i][1] for i in order]) if order else np.zeros(0)
        by = np.lexsort((row, term))
        self.row, self.weight = row[by], weight[by]
        self.posting = np.searchsorted(term[by], np.arange(n_terms + 1))
        self._bound()

    def _bound(self) -> None:
        """One entry per term and block: its postings [first, first of the next) and their largest weight."""
        n = len(self.posting) - 1
        group = np.repeat(np.arange(n), np.diff(self.posting)) * max(1, self.n_blocks) + self.row // self.in_block
        first = np.flatnonzero(np.concatenate((np.ones(min(1, len(group)), bool), group[1:] != group[:-1])))
        self.first = np.concatenate((first, [len(group)]))
        self.block = group[first] % max(1, self.n_blocks)
        self.bound = np.maximum.reduceat(self.weight, first) if len(first) else np.zeros(0)
        self.entry = np.searchsorted(first, self.posting)

    def __getstate__(self) -> dict:
        """Only postings travel; bounds are made again from them."""
        return {k: v for k, v in self.__dict__.items() if k not in ("first", "block", "bound", "entry")} | {"row": self.row.astype(np.int32), "posting": self.posting.astype(np.int32)}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state | {"row": state["row"].astype(np.int64), "posting": state["posting"].astype(np.int64)}
        self._bound()

    def nearest(self, term: np.ndarray, weight: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, cosines), best first, of the k nearest with a cosine above 0 and of all that tie with the last."""
        a, z = self.entry[term], self.entry[term + 1]
        at, q = _spread(a, z), np.repeat(weight, z - a)
        block = self.block[at]
        bounds = np.bincount(block, q * self.bound[at], self.n_blocks)
        order = np.argsort(-bounds, kind="stable")
        order = order[bounds[order] > 0]
        rows, scores, least, done = [], [], 0.0, 0
        while done < len(order) and bounds[order[done]] >= least - TIE:
            now = order[done : done + FIRST] if not done else order[done:][bounds[order[done:]] >= least - TIE]
            if len(now) <= MANY:
                mine = np.zeros(self.n_blocks, bool)
                mine[now] = True
                own = np.flatnonzero(mine[block])
                lo, hi, w = self.first[at[own]], self.first[at[own] + 1], q[own]
            else:  # so many blocks can reach the k-th best that whole lists are read sooner than their parts
                lo, hi, w = self.posting[term], self.posting[term + 1], weight
                now, rows, scores = order[done:], [], []
            post = _spread(lo, hi)
            score = np.bincount(self.row[post], self.weight[post] * np.repeat(w, hi - lo), len(self.labels))
            hit = np.flatnonzero(score > 0)
            rows.append(hit)
            scores.append(score[hit])
            every = np.concatenate(scores)
            least = np.partition(every, len(every) - k)[len(every) - k] if len(every) >= k else 0.0
            done += len(now)
        if not rows:
            return np.zeros(0, np.int64), np.zeros(0)
        row, score = np.concatenate(rows), np.concatenate(scores)
        keep = score >= least - TIE
        row, score = row[keep], score[keep]
        best = np.lexsort((row, -score))
        return row[best], score[best]


def places(names: np.ndarray, bag: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    own, n = np.fromiter(bag, np.int64, len(bag)), np.fromiter(bag.values(), float, len(bag))
    order = np.argsort(own)
    own, n = own[order], n[order]
    at = np.searchsorted(names, own)
    held = at < len(names)
    held[held] = names[at[held]] == own[held]
    return at[held], n[held]


class Model:
    """Terms, their weights, the index and the calibration."""

    def __init__(self, names: np.ndarray, k: int) -> None:
        self.names = names  # hashes of the terms, rising
        self.factor = np.ones(len(names))
        self.k = k
        self.index = BlockMaxIndex([], [], [], len(names))
        self.scale, self.shift, self.prior = 1.0, 0.0, 0.0

    def places(self, bag: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
        """The bag's terms that the examples hold, as places in order, and their frequencies."""
        return places(self.names, bag)

    def vector(self, bag: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
        """Unit TF-IDF vector of a bag of terms: places, in order, and weights."""
        return self.unit(*self.places(bag))

    def unit(self, t: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same of places, in order, and frequencies."""
        w = (1 + np.log(n)) * self.factor[t]
        t, w = t[w > 0], w[w > 0]  # a term of every document has no weight
        return t, w / np.sqrt((w * w).sum()) if len(w) else w

    def vote(self, bag: dict[int, int]) -> tuple[float, np.ndarray, np.ndarray]:
        """(share of votes for the label, neighbours' ids, cosines). Examples that tie for the last place share it."""
        return self.vote_at(*self.places(bag))

    def vote_at(self, t: np.ndarray, n: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """The same of places, in order, and frequencies."""
        at, cos = self.index.nearest(*self.unit(t, n), self.k)
        w = cos**2
        if len(at) > self.k:
            tied = cos <= cos[self.k - 1] + TIE
            w[tied] *= (self.k - (~tied).sum()) / tied.sum()
        share = (float(w @ self.index.labels[at]) + BLANK * self.prior) / (float(w.sum()) + BLANK)
        return share, self.index.ids[at[: self.k]], cos[: self.k]

    def score(self, share: float) -> float:
        return float(1 / (1 + np.exp(-(self.scale * share + self.shift))))

    def calibrate(self, shares: np.ndarray, y: np.ndarray) -> None:
        """Logistic regression of the label on the share of votes, by Newton steps with a small ridge."""
        x = np.stack([shares, np.ones(len(shares))], axis=1)
        b = np.array([8.0, -4.0])
        ridge = np.diag([1e-2, 1e-2])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
            step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ b)
            b = b + np.clip(step, -4, 4)
            if np.abs(step).max() < 1e-8:
                break
        self.scale, self.shift = float(b[0]), float(b[1])


def _coded(names):
    """(doc_id, held_out, text) -> the broadcast terms that the text holds, as gaps between places, and their frequencies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = names.value
        for b in batches:
            own = [places(known, bag_of(t)) for t in blobs(b.column(2))]
            gaps, tf = ([np.diff(t, prepend=0).astype("<i4").tobytes() for t, _ in own], [n.astype("<i4").tobytes() for _, n in own])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(gaps, pa.binary()), pa.array(tf, pa.binary())], ["doc_id", "held_out", "gaps", "tf"])

    return run


def _places_of(gaps: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(gaps, "<i4"), dtype=np.int64)


def _document_counts(n_terms: int):
    """Texts that hold each of the terms, by place, and texts in all as term -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, n = np.zeros(n_terms, np.int64), 0
        for b in batches:
            for x in b.column(0).to_pylist():
                count[_places_of(x)] += 1
            n += b.num_rows
        own = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(own, -1)), pa.array(np.append(count[own], n))], ["term", "n"])

    return run


def _bags_of(b: pa.RecordBatch) -> list[dict[int, int]]:
    return [dict(zip(t, n)) for t, n in zip(b.column(b.schema.get_field_index("terms")).to_pylist(), b.column(b.schema.get_field_index("tf")).to_pylist())]


def _vectors(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = [model.value.vector(x) for x in _bags_of(b)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([t.tolist() for t, _ in v], pa.list_(pa.int32())), pa.array([w.tolist() for _, w in v], pa.list_(pa.float64()))], ["doc_id", "y", "t", "w"])

    return run


def _shares(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array([model.value.vote(x)[0] for x in _bags_of(b)], pa.float64())], ["y", "share"])

    return run


def fit(docs: DataFrame, labels: DataFrame, label: str, sample: int, k: int, common: float, stressed: bool = True) -> tuple[Model, DataFrame]:
    """``docs`` (doc_id, held_out, text) and ``labels`` (doc_id, label), training rows only, one label per id. Returns the
    model and all rows of ``docs`` by the model's terms (doc_id, held_out, gaps, tf), so that each text is read once."""
    spark = docs.sparkSession
    share = lambda x: spark.sparkContext.broadcast(x)
    picked = [labels.where(F.col(label) == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample * (1 if y else 4)) for y in (1, 0)]
    ids = picked[0].unionByName(picked[1])
    rows = docs.join(F.broadcast(ids), "doc_id").select("doc_id", F.col(label).cast("int").alias("y"), "text")
    # Rows that repeat an id count as one, that of the smallest text; the sample stays as large as it was set.
    rows = rows.groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    bags = stash(rows.mapInArrow(_bag, "doc_id long, y int, mark long, terms array<long>, tf array<int>"), "bags")
    side = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(2)) == 0
    examples = bags.where(side)
    # A group of near copies counts as one text, so no passage that was copied often passes for a sign of the label.
    sized = examples.join(examples.groupBy("y", "mark").agg(F.count(F.lit(1)).alias("size")), ["y", "mark"]).withColumn("w", 1 / F.col("size"))
    n = {r["y"]: r["w"] for r in sized.groupBy("y").agg(F.sum("w").alias("w")).collect()}
    on, off = (F.sum(F.when(F.col("y") == y, F.col("w")).otherwise(0.0)).alias(c) for y, c in ((1, "a"), (0, "b")))
    counted = sized.select("y", "w", F.explode("terms").alias("term")).groupBy("term").agg(on, off).toArrow().sort_by("term")
    names, a, b = (counted.column(c).to_numpy() for c in ("term", "a", "b"))
    factor = stresses(a, b, n.get(1, 0.0), n.get(0, 0.0)) if stressed else np.ones(len(names))
    model = Model(names, k)
    coded = stash(docs.select("doc_id", "held_out", "text").mapInArrow(_coded(share(names)), "doc_id long, held_out boolean, gaps binary, tf binary"), "coded")
    df = coded.select("gaps").mapInArrow(_document_counts(len(names)), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    have, at = np.zeros(len(names)), df.column("term").to_numpy()
    have[at[at >= 0]] = df.column("n").to_numpy()[at >= 0]
    every = int(df.column("n").to_numpy()[at < 0].sum())
    rare = np.log((1 + every) / (1 + have))
    model.factor = np.where(factor > 1, factor * rare, np.maximum(0.0, rare + np.log(common)))
    own = examples.mapInArrow(_vectors(share(model)), "doc_id long, y int, t array<int>, w array<double>").toArrow()
    vectors = [(t.values.to_numpy().astype(np.int64), w.values.to_numpy()) for t, w in zip(own.column("t"), own.column("w"))]
    model.index = BlockMaxIndex(vectors, own.column("y").to_pylist(), own.column("doc_id").to_pylist(), len(names))
    total = labels.agg(F.avg(F.col(label).cast("double")).alias("p")).first()["p"]
    model.prior = float(total or 0.0)
    rest = bags.where(~side).mapInArrow(_shares(share(model)), "y int, share double").toArrow()
    if rest.num_rows:
        model.calibrate(rest.column("share").to_numpy(), rest.column("y").to_numpy().astype(float))
    drop_stash(bags)
    return model, coded


def score(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 3, held_fold: int = 1, sample: int = 2000, k: int = 15, common: float = 0.1, id_col: str = "doc_id", text_col: str = "text", stressed: bool = True) -> DataFrame:
    """One row per row of ``docs``: (doc_id, held_out, score, votes, neighbours array<long>, cosines array<double>).

    Labels are read only where the crc32 of the id modulo ``folds`` is not ``held_fold``; rows with null labels or ids
    teach nothing, and of several labels of one id the largest counts. Of those, at most ``sample`` with the label and
    four times as many without are used, half of them as examples and half for calibration. A text without a term of the
    examples, null and empty texts too, has no neighbours and scores by the prior vote. Examples that tie for the last of
    ``k`` places share its vote, so their order never decides. Without any labelled row all score alike. The model, of a
    size that the sample fixes, goes to all tasks. Texts are read once and kept as the terms of the examples that they hold. ``stressed=False`` leaves the weights of plain TF-IDF.
    """
    held = lambda c: F.coalesce(fold(F.col(c), folds) == held_fold, F.lit(False))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("held_out", held("doc_id"))
    taught = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label)).where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held("doc_id")).groupBy("doc_id").agg(F.max(label).alias(label))
    fitted, coded = fit(rows, taught, label, sample, k, common, stressed)
    model = docs.sparkSession.sparkContext.broadcast(fitted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for b in batches:
            votes = [m.vote_at(_places_of(t), np.frombuffer(n, "<i4").astype(float)) for t, n in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            share = [v[0] for v in votes]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([m.score(s) for s in share], pa.float64()), pa.array(share, pa.float64()), pa.array([v[1].tolist() for v in votes], pa.list_(pa.int64())), pa.array([v[2].tolist() for v in votes], pa.list_(pa.float64()))],
                ["doc_id", "held_out", "score", "votes", "neighbours", "cosines"],
            )

    return coded.mapInArrow(run, "doc_id long, held_out boolean, score double, votes double, neighbours array<long>, cosines array<double>")
