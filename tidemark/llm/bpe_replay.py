"""Byte-level BPE encoding and decoding by corpus-level merge replay.

A batch's new units are laid end to end as bytes. An inverted index leads from each possible merge to the places where
it can be made; a heap gives the merges in rank order, and each is made at all its places at once, left to right. Only
the two pairs beside a merged token enter the index anew. Units, and the space-led stretches that they make up, are
encoded once and kept, up to a number of entries; when they are full, those in use pass on to the next generation.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import blobs

CACHED = 300_000
# Unicode white space, as the vocabulary's pattern means it.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> rank, from lines of base64 and rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}


class MergeReplay:
    """Encodes units (bytes) of a batch together; the result equals lowest-rank-first merging of each unit alone."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.token = {r: t for t, r in ranks.items()}
        # All merges: each token by its cuts into two tokens.
        self.pair = {a << 32 | b: r for t, r in ranks.items() for i in range(1, len(t)) if (a := ranks.get(t[:i], -1)) >= 0 and (b := ranks.get(t[i:], -1)) >= 0}
        one = [bytes([x]) for x in range(256)]
        self.single = np.array([ranks[x] for x in one], np.int64)
        self.first = np.array([[ranks.get(x + y, -1) for y in one] for x in one], np.int64)

    def merged(self, a: int, b: int) -> int:
        """The rank that two tokens merge to, -1 if they don't."""
        return self.pair.get(a << 32 | b, -1)

    def alone(self, unit: bytes) -> list[int]:
        """One unit, merge by merge; for units in which a merge gives a pair of lower rank than its own."""
        ids = [self.ranks[unit[i : i + 1]] for i in range(len(unit))]
        while len(ids) > 1:
            best = min((r, i) for i in range(len(ids) - 1) if (r := self.merged(ids[i], ids[i + 1])) >= 0 or not (r := 1 << 40))
            if best[0] == 1 << 40:
                break
            ids[best[1] : best[1] + 2] = [best[0]]
        return ids

    def replay(self, units: list[bytes]) -> list[bytes]:
        """The ids of each unit as little-endian unsigned 32-bit integers."""
        ranks, merged = self.ranks, self.pair.get
        out = [ranks[u].to_bytes(4, "little") if u in ranks else b"" for u in units]
        open_ = [i for i, x in enumerate(out) if not x]
        raw = np.frombuffer(b"".join([units[i] for i in open_]), np.uint8)
        n = len(raw)
        stop = np.cumsum(np.fromiter((len(units[i]) for i in open_), np.int64, len(open_)))
        start = np.concatenate(([0], stop[:-1])) if len(open_) else stop
        last = np.zeros(n, bool)
        last[stop[stop > 0] - 1] = True
        tok = self.single[raw].tolist()
        nxt, prv = np.arange(1, n + 1), np.arange(-1, n - 1)
        nxt[last], prv[start[start < stop]] = -1, -1
        nxt, prv = nxt.tolist(), prv.tolist()
        rank = np.where(last[:-1], -1, self.first[raw[:-1], raw[1:]])
        at = np.flatnonzero(rank >= 0)
        at = at[np.argsort(rank[at], kind="stable")]
        own, cut = np.unique(rank[at], return_index=True)
        where = {r: x.tolist() for r, x in zip(own.tolist(), np.split(at, cut[1:]))}
        heap = own.tolist()  # in order, so a heap
        odd: list[int] = []
        while heap:
            r = heapq.heappop(heap)
            places = where.pop(r, None)
            if places is None:
                continue
            places.sort()
            for p in places:
                q = nxt[p]
                if tok[p] < 0 or q < 0 or merged(tok[p] << 32 | tok[q]) != r:
                    continue
                tok[p], tok[q] = r, -1
                after = nxt[p] = nxt[q]
                if after >= 0:
                    prv[after] = p
                    if (s := merged(r << 32 | tok[after], -1)) >= 0:
                        if s < r:
                            odd.append(p)
                        if s in where:
                            where[s].append(p)
                        else:
                            where[s] = [p]
                            heapq.heappush(heap, s)
                before = prv[p]
                if before >= 0 and (s := merged(tok[before] << 32 | r, -1)) >= 0:
                    if s < r:
                        odd.append(p)
                    if s in where:
                        where[s].append(before)
                    else:
                        where[s] = [before]
                        heapq.heappush(heap, s)
        strange = np.zeros(n + 1, np.int64)
        strange[odd] = 1
        strange = np.concatenate(([0], np.cumsum(strange)))
        ids = np.array(tok, np.int64)
        left = np.concatenate(([0], np.cumsum(ids >= 0)))
        ids = ids[ids >= 0].astype("<u4").tobytes()
        again = (strange[stop] > strange[start]).tolist()
        for i, a, z, redo in zip(open_, (4 * left[start]).tolist(), (4 * left[stop]).tolist(), again):
            out[i] = np.array(self.alone(units[i]), "<u4").tobytes() if redo else ids[a:z]
        return out


class Coder:
    """Texts to ids and back, with the vocabulary's split pattern."""

    def __init__(self, path: str, pattern: str) -> None:
        import regex

        self.engine = MergeReplay(load_ranks(path))
        self.units = regex.compile(pattern.replace("[^\\s", f"[^{SPACE}").replace("\\s", f"[{SPACE}]").replace("\\S", f"[^{SPACE}]"))
        self.gaps = re.compile(f"([{SPACE}]{{2,}})")
        self.unit_ids: dict[str, bytes] = {}
        self.known: dict[str, bytes] = {}
        # The generations before, from which what is met again passes on.
        self.old_units: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def stretches(self, text: str) -> list[str]:
        """Cut before each space and around each line feed. No unit crosses these cuts where white space stands alone;
        of a longer run all but the last character are a unit, or all of it at the text's end."""
        if "\x01" in text:
            return [text]
        parts = self.gaps.split(text)
        out: list[str] = []
        lead = ""
        for i, x in enumerate(parts):
            if i % 2:
                last = i + 2 == len(parts) and not parts[i + 1]
                out.append(x if last else x[:-1])
                lead = "" if last else x[-1]
            else:
                out += (lead + x).replace(" ", "\x01 ").replace("\n", "\x01\n\x01").split("\x01")
        return out

    def learn(self, keys: set[str]) -> None:
        found = {k: self.units.findall(k) for k in keys}
        new = []
        for u in {u for us in found.values() for u in us if u not in self.unit_ids}:
            if (x := self.old_units.get(u)) is None:
                new.append(u)
            else:
                self.unit_ids[u] = x
        self.unit_ids.update(zip(new, self.engine.replay([u.encode() for u in new])))
        for k, us in found.items():
            self.known[k] = b"".join([self.unit_ids[u] for u in us])

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        if len(self.known) > CACHED:
            self.known, self.old = {}, self.known
        if len(self.unit_ids) > CACHED:
            self.unit_ids, self.old_units = {}, self.unit_ids
        known = self.known
        split = [self.stretches(t) for t in texts]
        parts = [list(map(known.get, keys)) for keys in split]
        gaps = [i for i, x in enumerate(parts) if None in x]
        missing = set()
        for k in {k for i in gaps for k, x in zip(split[i], parts[i]) if x is None}:
            if (x := self.old.get(k)) is None:
                missing.add(k)
            else:
                known[k] = x
        if missing:
            self.learn(missing)
        for i in gaps:
            parts[i] = map(known.__getitem__, split[i])
        return [b"".join(x) for x in parts]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.engine.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_coders: dict[tuple[str, str], Coder] = {}


def _coder(path: str, pattern: str) -> Coder:
    if (path, pattern) not in _coders:
        _coders[path, pattern] = Coder(path, pattern)
    return _coders[path, pattern]


def encode(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False, chunk: int = 256) -> DataFrame:
    """(doc_id, n_tokens, ids) per row; ids are bytes of little-endian unsigned 32-bit integers. No shuffle.

    With ``digests``, (doc_id, n_tokens, ids_sha256, decoded_sha256) instead: the ids are decoded again in the same
    task. A null text is empty and has no ids.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(vocabulary, pattern)
        for b in batches:
            texts = blobs(b.column(1))
            for at in range(0, len(texts), chunk):
                ids = coder.encode([(t or b"").decode("utf-8", "replace") for t in texts[at : at + chunk]])
                cols = [b.column(0).slice(at, len(ids)), pa.array([len(x) // 4 for x in ids], pa.int64())]
                if digests:
                    cols += [pa.array([sha256(x).hexdigest() for x in ids]), pa.array([sha256(coder.decode(x)).hexdigest() for x in ids])]
                    yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
                else:
                    yield pa.RecordBatch.from_arrays([*cols, pa.array(ids, pa.binary())], ["doc_id", "n_tokens", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digests else "ids binary"))


def decode(coded: DataFrame, vocabulary: str, pattern: str, ids_col: str = "ids", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, text) of rows of ids as ``encode`` gives them; bytes that are no UTF-8 become replacement characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(vocabulary, pattern)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if x is None else coder.decode(x).decode("utf-8", "replace") for x in b.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return coded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, "doc_id long, text string")
