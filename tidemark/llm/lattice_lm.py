"""Language-model scores: the marginal probability of a text over all its segmentations into pieces.

The pieces are those of an existing vocabulary; its scores, an order of merit, give the first weights, and rounds of
expectation maximisation over all distinct training words give the final ones. A word's lattice holds every
segmentation, summed by a forward recursion in log space, and one arc more for the word as a whole: that arc weighs
its training count less a discount, and what all discounts leave goes to the segmentations, so the probabilities of
all words still sum to one at most. A text's probability is the product over its words and one end. Each distinct word
is worked on once for the whole corpus.

Words that hold a large share of all tokens are looked up in each task (there can be no more of them than the bound,
whatever the data); only the others travel, to be joined with their counts and probabilities.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import blobs, drop_stash, fold, stash

END = ""  # no word is empty
HEAD_WORDS = 50_000
ROUNDS = 3
MARK = 256  # stands before each word
LONG = 80
LN10 = math.log(10)


def load_pieces(path: str) -> list[tuple[tuple[int, ...], float]]:
    """(symbols, score) of a vocabulary's pieces: bytes, and MARK for the sign of a word's start."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    out = {}
    for i in range(sp.get_piece_size()):
        if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
            continue
        p = sp.id_to_piece(i)
        if sp.is_byte(i):
            s: tuple[int, ...] = (int(p[3:5], 16),)
        else:
            parts = p.split("▁")
            s = tuple(parts[0].encode())
            for x in parts[1:]:
                s += (MARK, *x.encode())
        # Texts are lower-case in A-Z and a start occurs at a word's start only.
        if s and MARK not in s[1:] and not any(65 <= b <= 90 for b in s):
            out[s] = max(out.get(s, -math.inf), sp.get_score(i))
    for b in (*range(256), MARK):
        if not 65 <= b <= 90:
            out.setdefault((b,), -float(sp.get_piece_size()))
    return list(out.items())


def first_weights(pieces: list[tuple[tuple[int, ...], float]]) -> np.ndarray:
    """Log probabilities by rank of score: the n-th gets a share like 1 / (n + 10); the end gets one of 100 pieces."""
    order = np.argsort([-s for _, s in pieces], kind="stable")
    w = np.empty(len(pieces) + 1)
    w[order] = 1 / (np.arange(len(pieces)) + 10.0)
    w[-1] = w[:-1].sum() / 100
    return np.log(w / w.sum())


class Lattice:
    """A dense trie of the pieces; words of one length go through it together."""

    def __init__(self, pieces: list[tuple[int, ...]]) -> None:
        used = sorted({b for p in pieces for b in p})
        self.kind = np.zeros(MARK + 1, np.int16)
        self.kind[used] = np.arange(1, len(used) + 1)
        nodes: list[dict[int, int]] = [{}, {}]  # 0: nowhere, 1: root
        piece = [-1, -1]
        for i, p in enumerate(pieces):
            at = 1
            for b in p:
                k = int(self.kind[b])
                if k not in nodes[at]:
                    nodes[at][k] = len(nodes)
                    nodes.append({})
                    piece.append(-1)
                at = nodes[at][k]
            piece[at] = i
        self.next = np.zeros((len(nodes), len(used) + 1), np.int32)
        for a, kids in enumerate(nodes):
            for k, b in kids.items():
                self.next[a, k] = b
        self.piece = np.array(piece)

    def arcs(self, x: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(from, to, rows, pieces) of all arcs of rows of equally long words, by from."""
        n, length = x.shape
        for i in range(length):
            rows, at = np.arange(n), np.ones(n, np.int32)
            for j in range(i, length):
                at = self.next[at, x[rows, j]]
                live = at > 0
                if not live.all():
                    rows, at = rows[live], at[live]
                if not len(rows):
                    break
                p = self.piece[at]
                own = p >= 0
                if own.any():
                    yield (i, j + 1, rows, p) if own.all() else (i, j + 1, rows[own], p[own])

    def forward(self, x: np.ndarray, logp: np.ndarray, kept: list | None = None) -> np.ndarray:
        alpha = np.full((x.shape[1] + 1, len(x)), -np.inf)
        alpha[0] = 0
        for i, j, rows, p in self.arcs(x):
            w = logp[p]
            alpha[j, rows] = np.logaddexp(alpha[j, rows], alpha[i, rows] + w)
            if kept is not None:
                kept.append((i, j, rows, p, w))
        return alpha

    def expected(self, x: np.ndarray, c: np.ndarray, logp: np.ndarray) -> np.ndarray:
        """Expected uses of each piece, words weighted by ``c``."""
        kept: list = []
        alpha = self.forward(x, logp, kept)
        beta = np.full_like(alpha, -np.inf)
        beta[-1] = 0
        out = np.zeros(len(logp))
        total = alpha[-1]
        for i, j, rows, p, w in reversed(kept):
            b = beta[j, rows] + w
            beta[i, rows] = np.logaddexp(beta[i, rows], b)
            out += np.bincount(p, c[rows] * np.exp(alpha[i, rows] + b - total[rows]), len(logp))
        return out

    def by_length(self, words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places, symbols) of words of one length together; long words one by one."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        for n in np.unique(size).tolist():
            at = np.flatnonzero(size == n)
            step = len(at) if n <= LONG else 1
            for k in range(0, len(at), min(step, 1 << 15)):
                part = at[k : k + min(step, 1 << 15)]
                raw = np.frombuffer(b"".join([words[i] for i in part.tolist()]), np.uint8).reshape(len(part), n)
                yield part, np.concatenate((np.full((len(part), 1), self.kind[MARK]), self.kind[raw]), axis=1)


_lattices: dict[str, Lattice] = {}


def _lattice(path: str) -> Lattice:
    if path not in _lattices:
        _lattices[path] = Lattice([p for p, _ in load_pieces(path)])
    return _lattices[path]


def _grouped(batches: Iterator[pa.RecordBatch], most: int = 60_000) -> Iterator[pa.Table]:
    hold, n = [], 0
    for b in batches:
        hold.append(b)
        n += b.num_rows
        if n >= most:
            yield pa.Table.from_batches(hold).combine_chunks()
            hold, n = [], 0
    if n:
        yield pa.Table.from_batches(hold).combine_chunks()


def _count_words():
    """(text, held) -> partial counts (word, c in training, n in all)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        train, rest = Counter(), Counter()

        def out():
            words = list(train.keys() | rest.keys())
            c = [train.get(w, 0) for w in words]
            n = [a + rest.get(w, 0) for w, a in zip(words, c)]
            train.clear()
            rest.clear()
            for i in range(0, len(words), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array([w.decode("utf-8", "replace") for w in words[i : i + 20_000]]), pa.array(c[i : i + 20_000], pa.int64()), pa.array(n[i : i + 20_000], pa.int64())], ["word", "c", "n"])

        for b in batches:
            for t, h in zip(blobs(b.column(0)), b.column(1).to_pylist()):
                to = rest if h else train
                to.update((t or b"").lower().split())
                to[b""] += 1
                if len(train) + len(rest) > 250_000:
                    yield from out()
        yield from out()

    return run


def _expect(path: str, logp: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lat, out = _lattice(path), np.zeros(len(logp))
        for t in _grouped(batches):
            words = blobs(t.column("word").chunk(0))
            for at, x in lat.by_length(words):
                out += lat.expected(x, np.ones(len(at)), logp)
        own = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(out[own])], ["piece", "e"])

    return run


def _probability(path: str, logp: np.ndarray, tokens: int, kinds: int, discount: float):
    """log10 probabilities: the whole-word arc and, with the discounts' mass, the segmentations."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lat = _lattice(path)
        for t in _grouped(batches):
            words = blobs(t.column("word").chunk(0))
            lp = np.full(len(words), logp[-1])  # the end
            full = np.array([i for i, w in enumerate(words) if w], np.int64)
            for at, x in lat.by_length([words[i] for i in full.tolist()]):
                lp[full[at]] = lat.forward(x, logp)[-1]
            if tokens:
                c = t.column("c").to_numpy().astype(float)
                with np.errstate(divide="ignore"):
                    lp = np.logaddexp(np.log(np.maximum(c - discount, 0) / tokens), lp + math.log(discount * kinds / tokens))
            yield pa.RecordBatch.from_arrays([t.column("word").chunk(0), t.column("c").chunk(0), t.column("n").chunk(0), pa.array(lp / LN10)], ["word", "c", "n", "lp"])

    return run


def _read_off(head) -> object:
    """(doc_id, held, text) -> what the head's words give, and the words to be joined."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        place, c, lp = head.value
        log_c = np.log10(c + 0.5)
        get = place.get
        rid = TaskContext.get().partitionId() << 40
        for b in batches:
            rows = []
            for t in blobs(b.column(2)):
                w = (t or b"").lower().split()
                w.append(b"")
                k = np.fromiter((get(x, -1) for x in w), np.int64, len(w))
                own = k[k >= 0]
                rest = Counter([w[i] for i in np.flatnonzero(k < 0).tolist()])
                rows.append((len(w), int((c[own] > 0).sum()), float(log_c[own].sum()), float(lp[own].sum()), [x.decode("utf-8", "replace") for x in rest], list(rest.values())))
            cols = list(zip(*rows)) if rows else [[]] * 6
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.string()), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(rid, rid + b.num_rows)), b.column(0), b.column(1), *[pa.array(list(x), k) for x, k in zip(cols, kinds)]],
                ["rid", "doc_id", "held_out", "n_tokens", "known", "log_c", "lp", "words", "times"],
            )
            rid += b.num_rows

    return run


def fit(counts: DataFrame, path: str, rounds: int = ROUNDS) -> np.ndarray:
    """Log probabilities of the pieces and the end, from (word, c) of all training tokens; each distinct word weighs one,
    since it's new words that the pieces have to tell."""
    logp = first_weights(load_pieces(path))
    seen = counts.where(F.col("c") > 0)
    for _ in range(rounds):
        rows = seen.where(F.col("word") != END).select("word").mapInArrow(_expect(path, logp), "piece int, e double").groupBy("piece").agg(F.sum("e").alias("e")).collect()
        e = np.full(len(logp), 0.1)  # no more rows than pieces; each keeps a little
        for r in rows:
            e[r["piece"]] += r["e"]
        e[-1] += 1
        logp = np.log(e / e.sum())
    return logp


def score(docs: DataFrame, vocabulary: str, folds: int = 5, held_fold: int = 1, head_words: int = HEAD_WORDS, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), in log10.

    Learns from the rows whose crc32 of the id modulo ``folds`` is not ``held_fold``; null ids count as training.
    A null or empty text is one end. Base: additive smoothing of the counts of whole words. score: a word's lattice,
    of which one arc is the whole word with its discounted count. A word takes time in proportion to its length, about
    26 s for one of 160,000 letters.
    """
    spark = docs.sparkSession
    key = F.col(id_col)
    rows = docs.select(key.cast("long").alias("doc_id"), F.coalesce(fold(key, folds) == held_fold, F.lit(False)).alias("held_out"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    parts = rows.select("text", "held_out").mapInArrow(_count_words(), "word string, c long, n long")
    counts = stash(parts.groupBy("word").agg(F.sum("c").alias("c"), F.sum("n").alias("n")), "counts")
    t = counts.agg(F.sum("c").alias("c"), F.sum("n").alias("n"), *[F.count_if(F.col("c") >= i).alias(f"v{i}") for i in (1, 2, 3)]).first()
    tokens, every, kinds = t["c"] or 0, t["n"] or 0, t["v1"]
    once, twice = t["v1"] - t["v2"], t["v2"] - t["v3"]
    discount = once / (once + 2 * twice) if once and twice else 0.5
    logp = fit(counts, vocabulary, rounds)
    scored = stash(counts.mapInArrow(_probability(vocabulary, logp, tokens, kinds, discount), "word string, c long, n long, lp double"), "scored")
    # No more than head_words words can each hold that share of all tokens.
    least = max(1, math.ceil(every / head_words))
    top = scored.where(F.col("n") >= least).select("word", "c", "lp").collect()
    head = spark.sparkContext.broadcast(({r["word"].encode(): i for i, r in enumerate(top)}, np.array([r["c"] for r in top], float), np.array([r["lp"] for r in top], float)))
    schema = "rid long, doc_id long, held_out boolean, n_tokens long, known long, log_c double, lp double, words array<string>, times array<int>"
    read = stash(rows.mapInArrow(_read_off(head), schema), "read")
    rest = read.select("rid", F.explode(F.arrays_zip("words", "times")).alias("x")).select("rid", F.col("x.words").alias("word"), F.col("x.times").alias("k"))
    met = rest.join(scored.where(F.col("n") < least).select("word", "c", F.col("lp").alias("w")), "word")
    tail = stash(met.groupBy("rid").agg(F.sum(F.when(F.col("c") > 0, F.col("k")).otherwise(0)).alias("known_t"), F.sum(F.col("k") * F.log10(F.col("c") + 0.5)).alias("log_c_t"), F.sum(F.col("k") * F.col("w")).alias("lp_t")), "tail")
    drop_stash(counts, scored)
    size = math.log10(tokens + 0.5 * (kinds + 1))
    plus = lambda a, b: F.col(a) + F.coalesce(F.col(b), F.lit(0).cast("double"))
    return read.drop("words", "times").join(tail, "rid", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("known_t", F.lit(0))).cast("long").alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (plus("log_c", "log_c_t") - F.col("n_tokens") * size).alias("base_score"),
        plus("lp", "lp_t").alias("score"),
    )

