"""SimHash near-dedup: deletion-variant signatures, equality join, exact verification, components.

A fingerprint is cut into so few segments that, of two fingerprints within the allowed distance, at least one
segment differs by one bit at most. Each segment is indexed once per bit with that bit left out, so the pair meets
under one equal key; every meeting is verified by the full distance. Equal fingerprints are one node from the start,
so groups of copies never become pairs, and within one key only a spanning forest of verified links leaves the task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.llm.common import blobs, drop_stash, stash
from tidemark.llm.graph import connected_components

BITS = 64


def shingle_hashes(text: bytes | None, shingle: int) -> np.ndarray:
    """XXH64 (seed 42) of each word shingle of a lower-cased text in order; of all words where they are fewer."""
    import xxhash

    w = (text or b"").lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    whole = b" ".join(w)
    if len(w) <= shingle:
        return np.array([digest(whole, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(w) - shingle + 1
    return np.fromiter([digest(whole[a:b], 42) for a, b in zip(starts[:n].tolist(), ends[shingle - 1 :].tolist())], np.uint64, n)


def print_of(h: np.ndarray) -> int:
    """The 64-bit SimHash of shingles' hashes, as a signed integer; zero where there are none."""
    if not len(h):
        return 0
    count = np.zeros(BITS, np.int64)
    for i in range(0, len(h), 1 << 14):
        count += np.unpackbits(h[i : i + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(count * 2 > len(h), bitorder="little").view(np.int64)
    return int(bits[0])


def fingerprint(text: bytes | None, shingle: int) -> int:
    """The 64-bit SimHash of one text; repeated shingles count each time."""
    return print_of(shingle_hashes(text, shingle))


def fingerprints(docs: DataFrame, shingle: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(t, shingle) for t in blobs(b.column(1))), np.int64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def segments(distance: int) -> list[tuple[int, int]]:
    """(first bit, width) of the fewest segments of which one differs by one bit at most."""
    n = distance // 2 + 1
    cut = [BITS * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cut, cut[1:])]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _first_key(x: np.ndarray, cuts: list[tuple[int, int]]) -> np.ndarray:
    """The lowest wildcard position under which two fingerprints that differ by ``x`` meet."""
    at = np.full(len(x), -1, np.int64)
    for a, width in cuts[::-1]:
        s = (x >> np.uint64(a)) & np.uint64((1 << width) - 1)
        n = np.bitwise_count(s)
        place = np.bitwise_count((s & (~s + np.uint64(1))) - np.uint64(1)).astype(np.int64)
        at = np.where(n == 0, a, np.where(n == 1, a + place, at))
    return at


class _Forest:
    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)
        return i != j


def _forest(f: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links that connect what is connected among ``f``: balls around pivots first, then the rest against all."""
    n, out, trees = len(f), [], _Forest(len(f))
    left = np.arange(n)
    for _ in range(8):
        if not len(left):
            break
        near = np.bitwise_count(f[left] ^ f[left[0]]) <= distance
        for j in left[near].tolist():
            if trees.join(int(left[0]), j):
                out.append((int(left[0]), j))
        left = left[~near]
    root = np.fromiter((trees.root(i) for i in range(n)), np.int64, n)
    most = np.bincount(root).argmax()
    outside = np.flatnonzero(root != most)
    for i in outside.tolist():  # each row outside of the largest tree against all rows, once for each tree it meets
        near = np.flatnonzero(np.bitwise_count(f ^ f[i]) <= distance)
        for j in near[np.unique(root[near], return_index=True)[1]].tolist():
            if j != i and trees.join(i, j):
                out.append((i, j))
    return out


SMALL_RUN = 24


def _meet(distance: int):
    cuts = segments(distance)

    def link(key: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """key sorted; whole runs only."""
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        size = np.diff(np.concatenate((first, [len(key)])))
        us, vs = [], []
        long_run = np.repeat(size > SMALL_RUN, size)
        for d in range(1, min(SMALL_RUN, int(size.max(initial=0)))):
            i = np.flatnonzero((key[d:] == key[:-d]) & ~long_run[d:])
            if not len(i):
                break
            x = f[i] ^ f[i + d]
            near = np.bitwise_count(x) <= distance
            i, x = i[near], x[near]
            own = _first_key(x, cuts) == key[i] >> 32
            us.append(f[i[own]])
            vs.append(f[i[own] + d])
        for a, n in zip(first[size > SMALL_RUN].tolist(), size[size > SMALL_RUN].tolist()):
            e = np.array(_forest(f[a : a + n], distance), np.int64).reshape(-1, 2)
            us.append(f[a + e[:, 0]])
            vs.append(f[a + e[:, 1]])
        return (np.concatenate(us), np.concatenate(vs)) if us else (f[:0], f[:0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by key; a run that the batch's end may cut waits for the next batch."""
        hold: list[tuple[np.ndarray, np.ndarray]] = []

        def flush(parts):
            u, v = link(np.concatenate([k for k, _ in parts]), np.concatenate([f for _, f in parts]))
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

        for b in batches:
            key, f = b.column(0).to_numpy(), b.column(1).to_numpy().view(np.uint64)
            if not len(key):
                continue
            cut = int(np.searchsorted(key, key[-1]))
            if cut:
                yield flush([*hold, (key[:cut], f[:cut])])
                hold = []
            hold.append((key[cut:], f[cut:]))
        if hold:
            yield flush(hold)

    return run


def links(nodes: DataFrame, distance: int) -> DataFrame:
    """``nodes``: distinct (fp). Returns (u, v): verified links that connect all fingerprints within ``distance``."""
    marks = [(p, _signed(((1 << w) - 1 << a) & ~(1 << p)), a) for a, w in segments(distance) for p in range(a, a + w)]
    table = F.array(*[F.struct(F.lit(p).cast("long").alias("p"), F.lit(m).cast("long").alias("m"), F.lit(a).alias("a")) for p, m, a in marks])
    # Spark shifts by a column only in SQL; three or so segments make a short CASE
    part = F.lit(None).cast("long")
    for a, _ in segments(distance):
        part = F.when(F.col("k.a") == a, F.shiftrightunsigned(F.col("fp").bitwiseAND(F.col("k.m")), a)).otherwise(part)
    keyed = nodes.select("fp", F.explode(table).alias("k")).select(F.shiftleft(F.col("k.p"), 32).bitwiseOR(part).alias("key"), "fp")
    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(_meet(distance), "u long, v long")


def _reached(nodes: DataFrame, distance: int) -> DataFrame:
    """``nodes``: (fp, rep), each fp once. Returns (fp, component_id): the smallest rep that links reach."""
    labels = stash(connected_components(links(nodes.select("fp"), distance)), "labels")
    member = nodes.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "rep", F.coalesce("label", "fp").alias("label"))
    head = member.groupBy("label").agg(F.min("rep").alias("component_id"))
    return stash(member.join(stash(head, "heads"), "label").select("fp", "component_id"), "named")


def simhash_components(docs: DataFrame, shingle: int = 5, distance: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: (doc_id, fp, component_id).

    component_id is the smallest doc_id among all texts that links reach; null ids take part but are never chosen
    unless no other is there. Null and blank texts have fingerprint zero, which links like any other. Repeated rows
    give repeated results. Memory: a task holds the distinct fingerprints of one key.
    """
    fps = stash(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    nodes = stash(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "nodes")
    return fps.join(_reached(nodes, distance), "fp").select("doc_id", "fp", "component_id")


def _digest(text: Column) -> Column:
    """128 bits of a text, by which equal texts are known."""
    return F.unhex(F.md5(text.cast("binary")))


BANDS = 32

#: Odd multipliers, from a fixed seed: each orders the shingles' hashes anew, and the least product is one MinHash.
_FACTORS = np.random.default_rng(42).integers(0, 1 << 63, BANDS * 12, np.uint64) * np.uint64(2) + np.uint64(1)
_MISSED = 1e-5


def band_rows(similarity: float) -> int:
    """The most MinHashes a band can have so that two sets at the similarity miss each other in all bands once in 10^5."""
    if not 0.3 <= similarity <= 1:
        raise ValueError("similarity must lie between 0.3 and 1")
    return 12 if similarity > 0.9 else min(12, int(np.log(1 - _MISSED ** (1 / BANDS)) / np.log(similarity)))


def least_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """``n`` MinHashes of a set of hashes; all ones where it is empty."""
    out = np.full(n, ~np.uint64(0))
    for i in range(0, len(h), 64):
        np.minimum(out, (h[i : i + 64, None] * _FACTORS[:n]).min(axis=0), out=out)
    return out


def _sketch(shingle: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            least = np.zeros((b.num_rows, BANDS * rows), np.uint64)
            size = np.zeros(b.num_rows, np.int32)
            fp = np.zeros(b.num_rows, np.int64)
            for i, t in enumerate(blobs(b.column(2))):
                h = np.unique(shingle_hashes(t, shingle))
                least[i], size[i], fp[i] = least_hashes(h, BANDS * rows), len(h), print_of(h)
            short = (least >> np.uint64(20)).astype(np.uint16)
            # Keys go by the shortened values, so that texts with an equal band there always meet under its key.
            keys = (short.reshape(-1, BANDS, rows).astype(np.uint64) + np.uint64(1)) * _FACTORS[:rows]
            keys = (keys.sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)) * _FACTORS[rows]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(size), pa.array(fp), pa.array([x.tobytes() for x in short], pa.binary()), pa.array(list(keys.view(np.int64)), pa.list_(pa.int64()))],
                ["doc_id", "text_key", "size", "fp", "least", "keys"],
            )

    return run


INLINE = 1024


def _sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The shingles' hashes of each text in order; null where there are more than INLINE."""
        for b in batches:
            sets = (np.unique(shingle_hashes(t, shingle)) for t in blobs(b.column(1)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([h.tobytes() if len(h) <= INLINE else None for h in sets], pa.binary())], ["text_key", "shingles"])

    return run


def _across(similarity: float, rows: int):
    """Rows come sorted by key. All pairs of one key with different labels whose sizes and MinHashes allow the similarity,
    each under the first band that both have; where both bring their shingles, only pairs that reach it."""
    n = BANDS * rows
    least_equal = n * similarity - 6 * np.sqrt(n * similarity * (1 - similarity))

    def pairs(band: int, text: np.ndarray, label: np.ndarray, size: np.ndarray, least: np.ndarray, sets: list) -> Iterator[pa.RecordBatch]:
        def reaches(i: int, j: int) -> bool:
            if sets[i] is None or sets[j] is None:
                return True
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            return both >= similarity * (len(sets[i]) + len(sets[j]) - both)

        for i in range(len(text) - 1):
            j = np.flatnonzero((label[i + 1 :] != label[i]) & (np.minimum(size[i + 1 :], size[i]) >= similarity * np.maximum(size[i + 1 :], size[i]))) + i + 1
            for at in range(0, len(j), 1 << 12):
                k = j[at : at + (1 << 12)]
                same = least[k] == least[i]
                own = same.reshape(-1, BANDS, rows).all(axis=2).argmax(axis=1) == band
                k = [x for x in k[own & (same.sum(axis=1) >= least_equal)].tolist() if reaches(i, x)]
                if k:
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(text[k], text[i])), pa.array(np.maximum(text[k], text[i]))], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold: list[pa.RecordBatch] = []

        def flush(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(parts)
            key, band, text, label, size = (t.column(c).to_numpy() for c in range(5))
            least = np.frombuffer(b"".join(t.column(5).to_pylist()), np.uint16).reshape(-1, n)
            sets = [None if x is None else np.frombuffer(x, np.uint64) for x in t.column(6).to_pylist()]
            first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
            for a, z in zip(first[:-1], first[1:]):
                yield from pairs(int(band[a]), text[a:z], label[a:z], size[a:z], least[a:z], sets[a:z])

        for b in batches:
            if not b.num_rows:
                continue
            key = b.column(0).to_numpy()
            if hold and hold[0].column(0)[0].as_py() != key[0]:
                yield from flush(hold)
                hold = []
            cut = int(np.searchsorted(key, key[-1]))
            if cut:
                yield from flush([*hold, b.slice(0, cut)])
                hold = []
            hold.append(b.slice(cut))
        if hold:
            yield from flush(hold)

    return run


def _jaccard(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for s, t in zip(blobs(b.column(2)), blobs(b.column(3))):
                x, y = np.unique(shingle_hashes(s, shingle)), np.unique(shingle_hashes(t, shingle))
                both = len(np.intersect1d(x, y, assume_unique=True))
                out.append(both / (len(x) + len(y) - both) if len(x) + len(y) else 1.0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.float64())], ["u", "v", "similarity"])

    return run


def near_duplicates(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, distance: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: (doc_id, digest of the text, component_id).

    Texts link if the SimHash prints of their sets of word shingles differ in at most ``distance`` bits, found by deletion
    variants as in ``simhash_components``, and also if the sets reach the Jaccard ``similarity``, which differs in more bits
    than an index of prints can bear. For these, texts that prints leave apart meet under 32 keys, each made of a band of
    MinHashes of the shingles; two texts at the similarity miss each other in all bands at most once in 10^5. First all texts of a key are compared, exactly, with the one that meets most others; then all pairs of a key that
    these links leave apart, if their MinHashes allow the similarity (but once in 10^8 wrongly refused). No pair
    of a key is left out for another reason, so components are those of all pairs. Equal texts are one from the start.
    Blank texts link with blank texts only. Null ids are never chosen unless no other is there.
    Memory: a task holds the MinHashes, and up to 1024 shingles each, of the texts of one key.
    """
    rows_in_band = band_rows(similarity)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), _digest(text).alias("digest"), text.alias("text"))
    # Each distinct text has a number of its own, fixed once stashed.
    ids = stash(rows.groupBy("digest").agg(F.min("doc_id").alias("rep")).withColumn("text_key", F.monotonically_increasing_id()), "texts")
    first_of = lambda part: rows.join(part, (rows["digest"] == part["digest"]) & rows["doc_id"].eqNullSafe(part["rep"]))
    sketch = stash(first_of(ids).select("doc_id", "text_key", "text").mapInArrow(_sketch(shingle, rows_in_band), "doc_id long, text_key long, size int, fp long, least binary, keys array<long>"), "sketches")
    nodes = stash(sketch.where("size > 0").groupBy("fp").agg(F.min("text_key").alias("rep")), "nodes")
    # Texts with their group by prints, under its smallest text_key; texts without a shingle have no print.
    alike = stash(sketch.where("size > 0").select("text_key", "fp").distinct().join(_reached(nodes, distance), "fp").select("text_key", F.col("component_id").alias("mate")), "alike")
    same = alike.where("mate < text_key").select(F.col("mate").alias("u"), F.col("text_key").alias("v"))
    met = sketch.join(alike, "text_key", "left").select("text_key", F.coalesce("mate", "text_key").alias("mate"), F.posexplode("keys").alias("band", "key")).distinct()
    within = W.partitionBy("key")
    met = met.select("*", F.count(F.lit(1)).over(within).alias("n"), F.min("mate").over(within).alias("a"), F.max("mate").over(within).alias("b"))
    met = stash(met.where("a < b").drop("a", "b"), "met")
    # Of many variants the original meets most others; a variant taken instead would be far from the rest.
    score = met.groupBy("text_key").agg(F.sum("n").alias("score"))
    head = met.join(score, "text_key").groupBy("key").agg(F.max(F.struct("score", "text_key", "mate")).alias("head")).select("key", F.col("head.text_key").alias("head"), F.col("head.mate").alias("head_mate"))
    stars = met.join(head, "key").where(F.col("head_mate") != F.col("mate")).select(F.least("head", "text_key").alias("u"), F.greatest("head", "text_key").alias("v"))

    def bodies(wanted: DataFrame, name: str) -> DataFrame:
        part = stash(wanted.distinct().join(ids, "text_key"), f"{name}_part")  # one copy of each text that takes part
        return first_of(part).select("text_key", "text")

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        pairs = stash(pairs.distinct(), f"{name}_candidates")
        body = stash(bodies(pairs.select(F.explode(F.array("u", "v")).alias("text_key")), name), f"{name}_bodies")
        side = lambda c: body.select(F.col("text_key").alias(c), F.col("text").alias(f"{c}_text"))
        scored = pairs.join(side("u"), "u").join(side("v"), "v").select("u", "v", "u_text", "v_text").mapInArrow(_jaccard(shingle), "u long, v long, similarity double")
        return stash(scored.where(F.col("similarity") >= similarity).select("u", "v"), f"{name}_links")

    near = verified(stars, "star")
    tree = stash(connected_components(near.unionByName(same)), "trees")
    apart = met.join(tree.select(F.col("node").alias("text_key"), "label"), "text_key", "left").select("key", "band", "text_key", F.coalesce("label", "text_key").alias("label"))
    mixed = apart.groupBy("key").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a < b").select("key")
    open_ = stash(apart.join(mixed, "key"), "open")
    sets = stash(bodies(open_.select("text_key"), "open").mapInArrow(_sets(shingle), "text_key long, shingles binary").dropDuplicates(["text_key"]), "sets")
    full = open_.join(sketch.select("text_key", "size", "least"), "text_key").join(sets, "text_key").select("key", "band", "text_key", "label", "size", "least", "shingles")
    rest = verified(full.repartition("key").sortWithinPartitions("key").mapInArrow(_across(similarity, rows_in_band), "u long, v long"), "rest")
    labels = stash(connected_components(near.unionByName(rest).unionByName(same)), "labels")
    member = stash(ids.join(labels.select(F.col("node").alias("text_key"), "label"), "text_key", "left").select("text_key", "rep", F.coalesce("label", "text_key").alias("label")), "members")
    first = stash(member.groupBy("label").agg(F.min("rep").alias("component_id")), "firsts")
    named = stash(member.join(first, "label").join(ids.select("text_key", "digest"), "text_key").select("digest", "component_id"), "named")
    drop_stash(sketch, nodes, alike, met, open_, sets, near, rest, tree, labels, member, first)
    return rows.select("doc_id", "digest").join(named, "digest")


def keep_first(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, distance: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the near copies: of each group the row with the smallest id stays, with its own columns, whatever
    their names. Rows that repeat an id and its text stay together."""
    kept = near_duplicates(docs, shingle, similarity, distance, id_col=id_col, text_col=text_col).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id", "digest").distinct()
    kept = stash(kept, "kept")
    key = _digest(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), key.alias("key"), F.struct("*").alias("row"))
    return rows.join(kept, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("key") == F.col("digest")), "left_semi").select("row.*")
