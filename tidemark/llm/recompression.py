"""Substring dedup by recompression: words covered by a window that also starts earlier are found and removed.

Rounds of recompression rewrite each text's words into symbols: the first names runs of equal words, each then names
pairs of a left and a right symbol, where the side of a symbol is a bit of its name. A name is a 64-bit hash of what
it stands for, so all tasks give equal substrings equal names without exchanging tables. For each symbol the words
that decide its making are known; a window that holds all of them holds the same symbol wherever else it occurs.
Every window is anchored at its longest such symbol (in the last resort at a word), so equal windows have equal
anchors, and only windows with an anchor that occurs twice are compared as windows:

1. texts -> anchors (name, first window, number of windows), one row per text;
2. anchor names that occur twice or more -> the windows behind them, hashed;
3. windows that occur twice or more: all but the first are marked;
4. marked texts are cut, and runs of marked windows are held against the first ones' own words.

Of equal texts only the one with the smallest id goes through 2 to 4; every window of the others starts earlier.
Windows meet by a hash. A run whose words differ from those at its supposed first place shows that two windows share
a hash; all windows of such hashes are then grouped by their words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import blobs, drop_stash, stash

ROUNDS = 3
BATCH_WORDS = 200_000
LAST_ID = (1 << 63) - 1

_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _hashes(words: Iterable[bytes], n: int) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh64_intdigest, words), _U, n)


class _Level:
    """Symbols of one round in order: name, first and last word, and the words [lo, hi) that decide their making."""

    def __init__(self, name, a, b, lo, hi, doc) -> None:
        self.name, self.a, self.b, self.lo, self.hi, self.doc = name, a, b, lo, hi, doc


def _runs(s: _Level, first: np.ndarray, last: np.ndarray) -> _Level:
    """Name maximal runs; that a run ends is known from the symbols beside it, so those decide too."""
    n = len(s.name)
    start = np.flatnonzero(np.concatenate(([True], (s.name[1:] != s.name[:-1]) | (s.doc[1:] != s.doc[:-1]))))
    end = np.concatenate((start[1:], [n])) - 1
    size = end - start + 1
    name = np.where(size > 1, _mix(s.name[start] ^ _mix(size.astype(_U) + _U(0x51ED27))), s.name[start])
    doc = s.doc[start]
    left, right = np.maximum(start - 1, 0), np.minimum(end + 1, n - 1)
    lo = np.where((start > 0) & (s.doc[left] == doc), s.lo[left], first[doc] - 1)
    hi = np.where((end < n - 1) & (s.doc[right] == doc), s.hi[right], last[doc] + 1)
    return _Level(name, s.a[start], s.b[end], lo, hi, doc)


def _pairs(s: _Level, turn: int, first: np.ndarray, last: np.ndarray) -> _Level:
    """Name each left symbol with the right symbol after it; a symbol left alone is decided by its neighbour too."""
    n = len(s.name)
    right = (_mix(s.name ^ _U(0x9E3779B97F4A7C15 * (turn + 1) & (1 << 64) - 1)) >> _U(63)).astype(bool)
    near = np.concatenate((s.doc[1:] == s.doc[:-1], [False]))  # has a next symbol in its text
    opens = np.concatenate((~right[:-1] & right[1:], [False])) & near
    closes = np.concatenate(([False], opens[:-1]))
    keep = np.flatnonzero(~closes)
    nxt = np.minimum(keep + 1, n - 1)
    prv = np.maximum(keep - 1, 0)
    pair = opens[keep]
    name = np.where(pair, _mix(s.name[keep] * _U(3) ^ _mix(s.name[nxt] + _U(turn))), s.name[keep])
    doc, r = s.doc[keep], right[keep]
    before = np.concatenate(([False], near[:-1]))[keep]
    lo = np.where(r, np.where(before, s.lo[prv], first[doc] - 1), s.lo[keep])
    hi = np.where(r, s.hi[keep], np.where(near[keep], s.hi[nxt], last[doc] + 1))
    return _Level(name, s.a[keep], np.where(pair, s.b[nxt], s.b[keep]), lo, hi, doc)


def anchors(h: np.ndarray, lengths: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Of texts laid end to end (word hashes, words per text): (text, name, first window, windows) of each anchor.

    All texts have ``window`` words or more. An anchor's windows are consecutive.
    """
    last = np.cumsum(lengths)
    first = last - lengths
    total, at = int(last[-1]), np.arange(int(last[-1]))
    doc = np.repeat(np.arange(len(lengths)), lengths)
    s = _Level(h, at, at + 1, at, at + 1, doc)
    levels = [s, s := _runs(s, first, last)]
    for t in range(ROUNDS):
        levels.append(s := _pairs(s, t, first, last))
    start = at[at + window <= last[doc]]
    chosen = np.zeros(len(start), _U)
    level = np.full(len(start), -1, np.int8)
    open_ = np.arange(len(start))
    for k in range(len(levels) - 1, -1, -1):
        s, w = levels[k], start[open_]
        i0 = np.concatenate(([0], np.cumsum(np.bincount(np.maximum(s.lo + 1, 0), minlength=total + 2))))[w + 1]
        i1 = np.cumsum(np.bincount(s.hi, minlength=total + 2))[w + window] - 1
        there = i0 <= i1
        open_, i0, i1, left = open_[there], i0[there], i1[there], open_[~there]
        if len(open_):
            size = np.minimum(s.b - s.a, 63).astype(_U)
            key = ((_U(64) - size) << _U(56)) | ((s.name >> _U(40)) << _U(32)) | np.arange(len(s.name), dtype=_U)
            power = np.frexp((i1 - i0 + 1).astype(np.float64))[1] - 1
            table = [key]
            for p in range(1, int(power.max()) + 1):
                half = 1 << (p - 1)
                table.append(np.concatenate((np.minimum(table[-1][:-half], table[-1][half:]), table[-1][-half:])))
            table = np.stack(table)
            best = np.minimum(table[power, i0], table[power, i1 - (1 << power) + 1]) & _U(0xFFFFFFFF)
            chosen[open_] = best
            level[open_] = k
        open_ = left
        if not len(open_):
            break
    d = doc[start]
    cut = np.flatnonzero(np.concatenate(([True], (chosen[1:] != chosen[:-1]) | (level[1:] != level[:-1]) | (d[1:] != d[:-1]))))
    count = np.diff(np.concatenate((cut, [len(start)])))
    # An anchor goes by all the words that decide its making, not by its symbol alone: fewer chance meetings.
    lo, hi = np.zeros(len(cut), np.int64), np.zeros(len(cut), np.int64)
    for k, s in enumerate(levels):
        own = level[cut] == k
        i = chosen[cut[own]].astype(np.int64)
        lo[own], hi[own] = s.lo[i], s.hi[i]
    name = _stretch_hashes(h, lo, hi)
    return d[cut], name, start[cut] - first[d[cut]], count


def _stretch_hashes(h: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """A hash of the words [lo, hi) for each pair, by differences of one prefix sum."""
    odd = 0x9E3779B97F4A7C15
    up = np.concatenate((np.ones(1, _U), np.cumprod(np.full(len(h), odd, _U))))
    down = np.concatenate((np.ones(1, _U), np.cumprod(np.full(len(h), pow(odd, -1, 1 << 64), _U))))
    prefix = np.concatenate((np.zeros(1, _U), np.cumsum(_mix(h) * up[:-1])))
    return _mix((prefix[hi] - prefix[lo]) * down[lo] + (hi - lo).astype(_U))


def window_hashes(h: np.ndarray, start: np.ndarray, window: int, bits: int = 64) -> np.ndarray:
    x = np.zeros(len(start), _U)
    for j in range(window):
        x = (x ^ h[start + j]) * _U(0x9E3779B97F4A7C15)
        x ^= x >> _U(29)
    return _mix(x) >> _U(64 - bits)


def _batched(texts: list, most: int) -> Iterator[tuple[int, list[list[bytes]]]]:
    """(index of the first, words of each): consecutive texts of about ``most`` words together."""
    at, group, n = 0, [], 0
    for i, t in enumerate(texts):
        group.append((t or b"").split())
        n += len(group[-1])
        if n >= most:
            yield at, group
            at, group, n = i + 1, [], 0
    if group:
        yield at, group


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), pa.array(values))


_FOUND = "rid long, doc_id long, text_key long, n_words long, sha string, names array<long>, starts array<int>, counts array<int>"


def _scan(window: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        rid = TaskContext.get().partitionId() << 40
        for b in batches:
            texts = blobs(b.column(2))
            for at, group in _batched(texts, BATCH_WORDS):
                n = np.fromiter(map(len, group), np.int64, len(group))
                sha = [sha256(b" ".join(w)).hexdigest() for w in group]
                long_ = np.flatnonzero(n >= window)
                per = np.zeros(len(group), np.int64)
                name, start, count = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)
                if len(long_):
                    h = _hashes(chain.from_iterable(group[i] for i in long_.tolist()), int(n[long_].sum()))
                    d, name, start, count = anchors(h, n[long_], window)
                    per[long_] = np.bincount(d, minlength=len(long_))
                    name, start, count = name.view(np.int64), start.astype(np.int32), count.astype(np.int32)
                m = len(group)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(rid, rid + m)), b.column(0).slice(at, m), b.column(1).slice(at, m), pa.array(n), pa.array(sha), _lists(name, per), _lists(start, per), _lists(count, per)],
                    ["rid", "doc_id", "text_key", "n_words", "sha", "names", "starts", "counts"],
                )
                rid += m

    return run


def _windows(window: int, bits: int) -> Callable:
    """(rid, doc_id, text, spans) -> the same texts with the hash of each window of the spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = blobs(b.column(2))
            first, count = b.column(3), b.column(4)
            for at, group in _batched(texts, BATCH_WORDS):
                m = len(group)
                n = np.fromiter(map(len, group), np.int64, m)
                h = _hashes(chain.from_iterable(group), int(n.sum()))
                base = np.cumsum(n) - n
                f, c = first.slice(at, m), count.slice(at, m)
                per_span = np.diff(np.asarray(f.offsets))
                f, c = np.asarray(f.flatten()).astype(np.int64), np.asarray(c.flatten()).astype(np.int64)
                own = np.repeat(np.arange(m), per_span)
                start = np.repeat(f, c) + np.arange(int(c.sum())) - np.repeat(np.cumsum(c) - c, c)
                whose = np.repeat(own, c)
                hashed = window_hashes(h, start + base[whose], window, bits)
                per = np.bincount(whose, minlength=m)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(at, m), b.column(1).slice(at, m), b.column(2).slice(at, m), _lists(hashed.view(np.int64), per), _lists(start.astype(np.int32), per)],
                    ["rid", "doc_id", "text", "hashes", "starts"],
                )

    return run


def _covered(n: int, starts: np.ndarray, window: int) -> np.ndarray:
    edge = np.bincount(starts, minlength=n + 1) - np.bincount(starts + window, minlength=n + 1)
    return np.cumsum(edge[:-1]) > 0


_MARK = "array<struct<start:int,own_doc:bigint,own_start:int>>"


def _cut(window: int, texts_out: bool) -> Callable:
    """(rid, text, marks) -> words removed, digest of the kept words, if asked for the kept text, and the runs of
    marked windows that have their first places side by side: first place, number of windows, digest of the words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            removed, sha, left, runs = [], [], [], []
            marks = b.column(2)
            ends = np.asarray(marks.offsets).tolist()
            at, doc, place = (np.asarray(x) for x in marks.values.flatten())
            for t, x, y in zip(blobs(b.column(1)), ends, ends[1:]):
                w = (t or b"").split()
                order = np.argsort(at[x:y], kind="stable")
                s, d, o = at[x:y][order], doc[x:y][order], place[x:y][order]
                gone = _covered(len(w), s.astype(np.int64), window)
                kept = [w[i] for i in np.flatnonzero(~gone).tolist()]
                removed.append(int(gone.sum()))
                sha.append(sha256(b" ".join(kept)).hexdigest())
                left.append(_keep_layout(t or b"", gone) if texts_out else None)
                first = np.flatnonzero(np.concatenate((np.ones(min(1, len(s)), bool), (np.diff(s) != 1) | (np.diff(d) != 0) | (np.diff(o) != 1))))
                size = np.diff(np.concatenate((first, [len(s)])))
                runs.append([{"start": i, "own_doc": j, "own_start": k, "n": n, "words": sha256(b" ".join(w[i : i + n + window - 1])).digest()[:16]} for i, j, k, n in zip(s[first].tolist(), d[first].tolist(), o[first].tolist(), size.tolist())])
            kind = pa.list_(pa.struct([("start", pa.int32()), ("own_doc", pa.int64()), ("own_start", pa.int32()), ("n", pa.int32()), ("words", pa.binary())]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(removed, pa.int64()), pa.array(sha), pa.array(left, pa.string()), pa.array(runs, kind)], ["rid", "n_removed", "sha", "left", "runs"])

    return run


def _digests(window: int) -> Callable:
    """(doc_id, text, asked) -> the digest of the words of each run of windows asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc, start, size, words = [], [], [], []
            for i, t, asked in zip(b.column(0).to_pylist(), blobs(b.column(1)), b.column(2).to_pylist()):
                w = (t or b"").split()
                for x in asked:
                    a, n = x["own_start"], x["n"]
                    if a + n + window - 1 <= len(w):
                        doc.append(i)
                        start.append(a)
                        size.append(n)
                        words.append(sha256(b" ".join(w[a : a + n + window - 1])).digest()[:16])
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(start, pa.int32()), pa.array(size, pa.int32()), pa.array(words, pa.binary())], ["own_doc", "own_start", "n", "words"])

    return run


def _spelled(window: int) -> Callable:
    """(rid, doc_id, text, starts) -> the words of each window, joined."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rid, doc, t, starts in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), blobs(b.column(2)), b.column(3).to_pylist()):
                w = (t or b"").split()
                for i in range(0, len(starts), 1024):
                    part = starts[i : i + 1024]
                    yield pa.RecordBatch.from_arrays([pa.array([rid] * len(part), pa.int64()), pa.array([doc] * len(part), pa.int64()), pa.array(part, pa.int32()), pa.array([b" ".join(w[s : s + window]) for s in part], pa.binary())], ["rid", "doc_id", "start", "words"])

    return run


def _keep_layout(t: bytes, gone: np.ndarray) -> str:
    """The text without the words that go; what separates kept words stays, a gap closes with its first separator."""
    import re

    out, after = [], b""
    for i, m in enumerate(re.finditer(rb"([^\x20\x09-\x0D]+)([\x20\x09-\x0D]*)", t)):
        if not gone[i]:
            out += [m[1], m[2]]
    return (b"".join(out)).decode("utf-8", "replace")


def _first(windows: DataFrame, by: str) -> DataFrame:
    """Windows (rid, doc_id, start, ``by``) that start later than another with the same ``by``, with the first place."""
    owner = windows.groupBy(by).agg(F.min(F.struct("doc_id", "start")).alias("o"), F.count(F.lit(1)).alias("k")).where("k > 1").select(by, F.col("o.doc_id").alias("own_doc"), F.col("o.start").alias("own_start"))
    owner = stash(owner, "owners")
    marked = windows.join(owner, by).where((F.col("doc_id") != F.col("own_doc")) | (F.col("start") != F.col("own_start")))
    marked = stash(marked.select("rid", "start", "own_doc", "own_start"), "marked")
    drop_stash(owner)
    return marked


def substring_dedup(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text", texts: bool = False, hash_bits: int = 64) -> DataFrame:
    """One row per row of ``docs``: (doc_id, text_key, n_words, n_removed, kept_sha256[, left]).

    A word goes if a window of ``window`` words that covers it has its word sequence start earlier too: in a text
    with a smaller id, or earlier in the same one. Null and short texts keep all; null ids come last; rows with an
    equal id are one document's, and of their equal starts neither is earlier. With ``texts``, ``left`` is the
    remaining text where words went, null elsewhere. Memory: a task holds one Arrow batch; the windows of a text go
    to one task only as a list of starts. The result doesn't depend on ``hash_bits``, the width of the windows' hashes.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)).alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    found = stash(rows.mapInArrow(_scan(window), _FOUND), "anchors")
    base = stash(found.select("rid", "doc_id", "text_key", "n_words", "sha"), "base")

    # Equal texts: all but those with the smallest id are covered whole; of rows that repeat an id too, one stands for all.
    one = stash(base.where(F.col("n_words") >= window).groupBy("sha").agg(F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "rid")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"), "copies")
    same = stash(base.join(one, "sha").where(F.col("rid") != F.col("first.rid")).select("rid", F.col("first.rid").alias("first"), (F.col("doc_id") > F.col("least")).alias("covered")), "covered")
    repeated = stash(same.where("not covered").select("first").distinct(), "repeated")

    every = found.select("rid", F.explode(F.arrays_zip("names", "starts", "counts")).alias("x")).select("rid", F.col("x.names").alias("name"), "x.starts", "x.counts")
    twice = stash(every.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("name"), "names")
    spans = stash(every.join(twice, "name").select("rid", "starts", "counts"), "spans")
    drop_stash(twice, found)
    per_text = spans.join(same, "rid", "left_anti").groupBy("rid").agg(F.collect_list(F.struct("starts", "counts")).alias("s"))
    wanted = stash(per_text.join(base, "rid").select("rid", "doc_id", "text_key", F.col("s.starts").alias("starts"), F.col("s.counts").alias("counts")), "wanted")
    drop_stash(spans)
    # Rows that repeat an id and its text all meet the one that stands for them.
    many = wanted.join(repeated, F.col("rid") == F.col("first"), "left_semi")
    lone = wanted.join(repeated, F.col("rid") == F.col("first"), "left_anti")
    met = lambda x: x.join(rows, ["doc_id", "text_key"]).select("rid", "doc_id", "text", "starts", "counts")
    hashed = stash(met(lone).unionByName(met(many).dropDuplicates(["rid"])).mapInArrow(_windows(window, hash_bits), "rid long, doc_id long, text string, hashes array<long>, starts array<int>"), "windows")
    drop_stash(wanted, repeated)
    w = hashed.select("rid", "doc_id", F.explode(F.arrays_zip("hashes", "starts")).alias("x")).select("rid", "doc_id", F.col("x.hashes").alias("hash"), F.col("x.starts").alias("start"))
    marked = _first(w, "hash")

    def cut(marks: DataFrame) -> DataFrame:
        lists = marks.groupBy("rid").agg(F.collect_list(F.struct("start", "own_doc", "own_start")).cast(_MARK).alias("marks"))
        done = hashed.select("rid", "text").join(lists, "rid").mapInArrow(_cut(window, texts), "rid long, n_removed long, sha string, left string, runs array<struct<start:int,own_doc:bigint,own_start:int,n:int,words:binary>>")
        return stash(done, "cut")

    gone = cut(marked)
    runs = gone.select("rid", F.explode("runs").alias("r")).select("rid", "r.*")
    asked = runs.select("own_doc", "own_start", "n").distinct().groupBy("own_doc").agg(F.collect_list(F.struct("own_start", "n")).alias("asked"))
    own = hashed.select("doc_id", "text").join(asked, F.col("doc_id") == F.col("own_doc")).select("doc_id", "text", "asked").mapInArrow(_digests(window), "own_doc long, own_start int, n int, words binary")
    false = stash(runs.join(own, ["own_doc", "own_start", "n", "words"], "left_anti").select("rid", "start", "n"), "false")
    if not false.isEmpty():
        at = false.select("rid", F.explode(F.sequence("start", F.col("start") + F.col("n") - 1)).alias("start"))
        shared = w.join(at, ["rid", "start"], "left_semi").select("hash").distinct()
        doubt = stash(w.join(shared, "hash").select("rid", "start"), "doubt")
        spelled = hashed.select("rid", "doc_id", "text").join(doubt.groupBy("rid").agg(F.collect_list("start").alias("starts")), "rid").select("rid", "doc_id", "text", "starts")
        right = _first(stash(spelled.mapInArrow(_spelled(window), "rid long, doc_id long, start int, words binary"), "spelled"), "words")
        gone = cut(marked.join(doubt, ["rid", "start"], "left_anti").unionByName(right))
    drop_stash(hashed, marked)
    cols = ["n_removed", "sha", "left"]
    whole = same.where("covered").join(base, "rid").select("rid", F.col("n_words").alias("n_removed"), F.sha2(F.lit(""), 256).alias("sha"), F.lit("").alias("left"))
    again = same.where("not covered").join(gone.select(F.col("rid").alias("first"), *cols), "first").select("rid", *cols)
    every_gone = gone.select("rid", *cols).unionByName(whole).unionByName(again)
    out = base.alias("b").join(every_gone.alias("g"), "rid", "left").select(
        F.when(F.col("b.doc_id") < LAST_ID, F.col("b.doc_id")).alias("doc_id"), "b.text_key", "b.n_words", F.coalesce("g.n_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("g.sha", "b.sha").alias("kept_sha256"), F.col("g.left").alias("left")
    )
    return out if texts else out.drop("left")


def cut_repeats(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with the repeated words taken out of their texts; rows of which no word is left go.

    All columns stay, whatever their names; ``chars_col`` is counted anew where the text changed.
    """
    r = substring_dedup(docs, window, id_col, text_col, texts=True).where("n_removed > 0").select("doc_id", "text_key", "left", (F.col("n_words") == F.col("n_removed")).alias("none")).dropDuplicates(["doc_id", "text_key"])
    text, own = F.col(f"`{text_col}`"), lambda c: F.col("row").getField(c)
    key = F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))
    j = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), key.alias("key"), F.struct("*").alias("row"))
    j = j.join(r, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("key") == F.col("text_key")), "left").where(F.coalesce(~F.col("none"), F.lit(True)))
    new = {text_col: F.coalesce("left", own(text_col))}
    if chars_col in docs.columns:
        new[chars_col] = F.when(F.col("left").isNotNull(), F.length("left").cast(dict(docs.dtypes)[chars_col])).otherwise(own(chars_col))
    return j.select(*[new.get(c, own(c)).alias(c) for c in docs.columns])
