"""Packing: all token ids in one line, cut into fixed windows.

Pass one encodes each text once and stashes its ids with the partition and the place within it; the partitions' token
totals, one row each, give every partition its offset by a prefix sum. Pass two adds offsets and cuts at multiples of
the sequence length; a text that crosses a boundary gives a record for each part.
"""

from __future__ import annotations

import gc
import struct
import unicodedata
from collections.abc import Iterator
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.llm.common import blobs, stash

LENGTH = 4096
# ASCII signs that, behind a word, make a unit of their own.
TAIL = b".,!?%$&*#|;:\"()<>/-"
CACHED_WORDS = 400_000
#: Longer words go to the tokenizer: merging a row of symbols costs the square of its length.
LONG_WORD = 400


class LetterMerges:
    """Byte-pair merges of many letter-only words at once; ``of`` gives None where the vocabulary is of another kind.

    Words of one length are rows of symbols; in each turn every row makes its leftmost merge of lowest rank.
    """

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]) -> None:
        # The printable stand-ins of bytes in byte-level vocabularies.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        stand = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in set(plain))}
        self.inner = np.array([vocab[stand[b]] for b in range(256)], np.int64)
        self.last = np.array([vocab[stand[b] + "</w>"] for b in range(256)], np.int64)
        keys = np.array([vocab[x] << 20 | vocab[y] for x, y in merges], np.int64)
        self.made = np.array([vocab[x + y] for x, y in merges], np.int64)
        bits = 19
        self.shift, slots = np.uint64(64 - bits), np.full((1 << bits) + 64, -1, np.int64)
        for rank, h in enumerate(self._slot(keys).tolist()):
            while slots[h] >= 0:
                h += 1
            slots[h] = rank
        self.slots, self.keys = slots, np.concatenate((keys, [-1]))
        taken = slots >= 0
        ends = np.flatnonzero(~taken)
        self.probes = int(np.diff(ends).max())

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    @staticmethod
    def of(model: str) -> LetterMerges | None:
        import json

        m = json.loads(model)["model"]
        merges = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in m["merges"]]
        return LetterMerges(m["vocab"], merges) if m["type"] == "BPE" and m.get("end_of_word_suffix") == "</w>" else None

    def ranks(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair; a rank beyond all where there is none."""
        key = x << 20 | y
        at = self._slot(key)
        out = np.full(key.shape, len(self.made), np.int64)
        left = np.arange(len(key))
        for i in range(self.probes + 1):
            r = self.slots[at[left] + i]
            hit = (r >= 0) & (self.keys[r] == key[left])
            out[left[hit]] = r[hit]
            left = left[(r >= 0) & ~hit]
            if not len(left):
                break
        return out

    def ids(self, words: list[bytes]) -> list[list[int]]:
        out: list[list[int]] = [[]] * len(words)
        size = np.fromiter(map(len, words), np.int64, len(words))
        none = len(self.made)
        for n in np.unique(size).tolist():
            row = np.flatnonzero(size == n)
            raw = np.frombuffer(b"".join([words[i] for i in row.tolist()]), np.uint8).reshape(len(row), n)
            sym = self.inner[raw]
            sym[:, -1] = self.last[raw[:, -1]]
            rank = self.ranks(sym[:, :-1].ravel(), sym[:, 1:].ravel()).reshape(len(row), n - 1)
            while len(row):
                width = rank.shape[1]
                best = rank.argmin(axis=1) if width else None
                done = rank[np.arange(len(row)), best] == none if width else np.ones(len(row), bool)
                if done.any():
                    for i, x in zip(row[done].tolist(), sym[done].tolist()):
                        out[i] = x
                    row, sym, rank = row[~done], sym[~done], rank[~done]
                    if not len(row):
                        break
                    best = best[~done]
                k = np.arange(len(row))
                made = self.made[rank[k, best]]
                j = np.arange(width)
                sym = np.take_along_axis(sym, j + (j > best[:, None]), axis=1)
                sym[k, best] = made
                j = j[:-1]
                rank = np.take_along_axis(rank, j + (j >= best[:, None]), axis=1)
                if width > 1:
                    has = best > 0
                    rank[k[has], best[has] - 1] = self.ranks(sym[k[has], best[has] - 1], made[has])
                    has = best < width - 1
                    rank[k[has], best[has]] = self.ranks(made[has], sym[k[has], best[has] + 1])
        return out


class WordEncoder:
    """Ids of whole texts from the ids of their words: the tokenizer's units never cross ASCII white space.

    Words are encoded once and kept, up to a number of words; ids are unsigned 16-bit where the vocabulary allows. A
    word of letters, with signs behind it or not, is merged here, many words at a time; any other, and any of more than
    LONG_WORD bytes, goes through the tokenizer.
    """

    def __init__(self, tokenizer: str, ordinary: bool = False) -> None:
        from tokenizers import Tokenizer

        self.model, self.whole = Tokenizer.from_file(tokenizer), Tokenizer.from_file(tokenizer)
        # Words are ordinary text here; a text that holds an added token is the tokenizer's as a whole.
        self.model.encode_special_tokens = True
        self.added = [] if ordinary else [x.content.encode() for x in self.whole.get_added_tokens_decoder().values()]
        self.kind = np.uint16 if self.model.get_vocab_size(with_added_tokens=True) <= 1 << 16 else np.uint32
        self.letters = LetterMerges.of(self.model.to_str())
        self.known: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def by_model(self, words: list[bytes]) -> list[bytes]:
        found = self.model.encode_batch_fast([x.decode("utf-8", "replace") for x in words], add_special_tokens=False)
        return [np.array(e.ids, self.kind).tobytes() for e in found]

    def learn(self, words: set[bytes]) -> None:
        """Encode words that are not known yet."""
        known, old = self.known, self.old
        plain: list[bytes] = []
        cut: list[tuple[bytes, bytes, bytes]] = []
        ask: set[bytes] = set()
        other: list[bytes] = []
        for w in words:
            if (x := old.get(w)) is not None:
                known[w] = x
            elif len(w) > LONG_WORD:
                other.append(w)
            elif w.isalpha() and w.islower():
                plain.append(w)
            else:
                stem = w.lower().rstrip(TAIL)
                tail = w[len(stem) :]
                if not stem.isalpha():
                    if stem.isascii():
                        other.append(w)
                        continue
                    s = stem.decode("utf-8", "replace")
                    if not s.isalpha() or "\u0130" in s or "\u03a3" in s or not unicodedata.is_normalized("NFC", low := s.lower()):
                        other.append(w)
                        continue
                    stem = low.encode()
                    if stem == w:
                        plain.append(w)
                        continue
                ask.add(stem)
                if tail:
                    ask.add(tail)
                cut.append((w, stem, tail))
        if other:
            known.update(zip(other, self.by_model(other)))
        for x in ask:
            if x not in known and x not in words:
                if (y := old.get(x)) is not None:
                    known[x] = y
                elif x[0] in TAIL:
                    known[x] = self.by_model([x])[0]
                else:
                    plain.append(x)
        if plain:
            kind, pack = self.kind, struct.pack
            code = "H" if kind is np.uint16 else "I"
            if self.letters is None:
                known.update(zip(plain, self.by_model(plain)))
            else:
                known.update([(x, pack(f"<{len(i)}{code}", *i)) for x, i in zip(plain, self.letters.ids(plain))])
        for w, stem, tail in cut:
            known[w] = known[stem] + known[tail] if tail else known[stem]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text as bytes. Known words are kept in two generations: when the young one is full it
        becomes the old one, and what is met again returns, so frequent words stay."""
        if self.added and (held := [i for i, t in enumerate(texts) if any(x in t for x in self.added)]):
            rest = iter(self.encode([t for t in texts if not any(x in t for x in self.added)]))
            own = {i: np.array(self.whole.encode(texts[i].decode("utf-8", "replace"), add_special_tokens=False).ids, self.kind).tobytes() for i in held}
            return [own[i] if i in own else next(rest) for i in range(len(texts))]
        if len(self.known) > CACHED_WORDS:
            self.known, self.old = {}, self.known
        split = [t.split() for t in texts]
        flat = list(chain.from_iterable(split))
        got = list(map(self.known.get, flat))
        gaps = [i for i, x in enumerate(got) if x is None]
        if gaps:
            self.learn({flat[i] for i in gaps})
            known = self.known
            for i in gaps:
                got[i] = known[flat[i]]
        ends = list(accumulate(map(len, split), initial=0))
        return [b"".join(got[a:b]) for a, b in zip(ends, ends[1:])]


_encoders: dict[tuple[str, bool], WordEncoder] = {}


def _encode(tokenizer: str, end_id: int, ordinary: bool, chunk: int = 512):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        coder = _encoders.setdefault((tokenizer, ordinary), None) or WordEncoder(tokenizer, ordinary)
        _encoders[tokenizer, ordinary] = coder
        end = np.array([end_id], coder.kind).tobytes()
        size, part, before = len(end), TaskContext.get().partitionId(), 0
        gc.disable()  # millions of small tuples and no cycles
        try:
            for b in batches:
                texts = blobs(b.column(1))
                for at in range(0, len(texts), chunk):
                    ids = [x + end for x in coder.encode([t or b"" for t in texts[at : at + chunk]])]
                    n = np.fromiter(map(len, ids), np.int64, len(ids)) // size
                    place = before + np.cumsum(n) - n
                    before += int(n.sum())
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), part, np.int32)), pa.array(place), b.column(0).slice(at, len(ids)), pa.array(n), pa.array(ids, pa.binary())], ["part", "place", "doc_id", "n", "ids"])
        finally:
            gc.enable()

    return run


def _cut(length: int, wide: bool, crc: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        kind = np.uint32 if wide else np.uint16
        for b in batches:
            doc, place, n = b.column(0), b.column(1).to_numpy(), b.column(2).to_numpy()
            pieces = (place + n - 1) // length - place // length + 1
            own = np.repeat(np.arange(len(n)), pieces)
            seq = place[own] // length + np.arange(len(own)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            lo = np.maximum(seq * length, place[own])
            hi = np.minimum((seq + 1) * length, (place + n)[own])
            ids = b.column(3).to_pylist()
            start, size = lo - place[own], hi - lo
            data = [np.frombuffer(ids[i], kind)[s : s + z].astype("<u4").tobytes() for i, s, z in zip(own.tolist(), start.tolist(), size.tolist())]
            cols = [doc.take(pa.array(own)), pa.array(start), pa.array(size), pa.array([zlib.crc32(x) for x in data], pa.int64()), pa.array(n[own]), pa.array(seq), pa.array(lo - seq * length)]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            yield pa.RecordBatch.from_arrays(cols + ([] if crc else [pa.array(data, pa.binary())]), names + ([] if crc else ["ids"]))

    return run


def pack(docs: DataFrame, tokenizer: str, end_id: int, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", ids: bool = False, ordinary: bool = False) -> DataFrame:
    """One row per piece: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids as uint32 bytes]).

    Every text gives its ids and then ``end_id``; a null or empty text gives ``end_id`` alone. All sequences hold
    ``length`` ids but the last. Added tokens that a text spells out are those tokens, as the tokenizer reads them, unless
    ``ordinary`` says that they are text like any other. A text of any length is one row. The order is the order in which pass one wrote the texts, so it's fixed once stashed.
    Beyond one row per partition nothing comes together.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    coded = stash(rows.mapInArrow(_encode(tokenizer, end_id, ordinary), "part int, place long, doc_id long, n long, ids binary"), "ids")
    totals = coded.groupBy("part").agg(F.sum("n").alias("n"))
    # One row per partition of pass one: as many as tasks, whatever the size of the data.
    offset = totals.select("part", (F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("n")).alias("before"))
    from tokenizers import Tokenizer

    wide = Tokenizer.from_file(tokenizer).get_vocab_size(with_added_tokens=True) > 1 << 16
    placed = coded.join(F.broadcast(offset), "part").select("doc_id", (F.col("place") + F.col("before")).alias("place"), "n", "ids")
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + (", ids binary" if ids else "")
    return placed.mapInArrow(_cut(length, wide, not ids), schema)
