"""Embedding near-dedup: subspace pigeonhole join.

Unit vectors with a cosine of c or more lie within a squared distance of 2 - 2c. Rotated and cut into blocks of
dimensions, at least one block of such a pair keeps to its share of that budget, a radius. Each block is joined by
range: pivots, a bounded sample of the vectors, part the block into cells of nearest pivots, and a vector enters every
cell that a point within half the radius of it can lie in. The midpoint of a pair within the radius lies within half
of it from both, so the pair meets in the midpoint's cell. Who meets is compared by the block's distance, and who
passes by the exact cosine in double precision. A pair counts once: in the first block whose share it keeps, in the
first cell there that both have. Equal vectors are one from the start.

Pairs never leave a task: each vector of a cell gives the number of its links and one vector of its group that links
reach. A cell with many vectors is cut into tiles, and every two tiles are a group of their own, so no task holds more
than two tiles at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import drop_stash, stash
from tidemark.llm.graph import connected_components

TILE = 4096
PIVOTS = 2048
WIDE = 16
#: For candidates, radii are widened by this share; the exact comparison decides.
SLACK = 1e-4


def rotation(dim: int) -> np.ndarray:
    """A fixed random rotation, so that no block holds more of the vectors' spread than another."""
    q, r = np.linalg.qr(np.random.default_rng(7).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def blocks(dim: int, wide: int = WIDE) -> list[tuple[int, int]]:
    n = max(1, dim // wide)
    cut = [dim * i // n for i in range(n + 1)]
    return list(zip(cut, cut[1:]))


def radii(dim: int, budget: float) -> np.ndarray:
    """The radius of each block: its share of the squared budget goes by its number of dimensions."""
    return np.array([np.sqrt(budget * (b - a) / dim + 1e-12) * (1 + SLACK) for a, b in blocks(dim)])


def sound(v: Column, label: Column) -> Column:
    """Has a label, components, all finite and not all zero."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.coalesce(label.isNotNull() & (F.size(v) > 0) & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = np.asarray(column.flatten(), dtype=np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _turned(unit: np.ndarray) -> np.ndarray:
    """The rotated rows, summed in one order whatever rows stand beside them, so all tasks decide alike."""
    r = rotation(unit.shape[1])
    out = np.zeros_like(unit)
    for j in range(unit.shape[1]):
        out += unit[:, j : j + 1] * r[j]
    return out


def entered(z: np.ndarray, pivots: np.ndarray, radius: float) -> np.ndarray:
    """Which cells a point within half the ``radius`` of each row can lie in: (rows, pivots) boolean.

    A point's cell is that of its nearest pivot. Seen from the row's own pivot h, a step of s toward pivot j changes
    the difference of the squared distances to both by 2 s |p_h - p_j| at most.
    """
    d = (z**2).sum(axis=1)[:, None] + (pivots**2).sum(axis=1) - 2 * z @ pivots.T
    own = d.argmin(axis=1)
    h = pivots[own]
    apart = np.sqrt(np.maximum((h**2).sum(axis=1)[:, None] + (pivots**2).sum(axis=1) - 2 * h @ pivots.T, 0))
    return d - d[np.arange(len(z)), own][:, None] <= radius * apart + 1e-12


def _lay(budget: float, pivots: dict[int, np.ndarray]):
    """(id, label, v) -> per block the cells that a vector enters."""

    def one(ids: pa.Array, label: pa.Array, x: np.ndarray) -> Iterator[pa.RecordBatch]:
        dim = x.shape[1]
        turned, own = _unit(x) @ rotation(dim), pivots.get(dim)
        for k, ((a, b), radius) in enumerate(zip(blocks(dim), radii(dim, budget))):
            if own is None:  # a length so rare that the sample has none: one cell
                size, cells = np.ones(len(x), np.int64), np.zeros(len(x), np.int32)
            else:
                hit = entered(turned[:, a:b], own[:, a:b], radius)
                size, cells = hit.sum(axis=1), np.nonzero(hit)[1].astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(size))).astype(np.int32)), pa.array(cells))
            yield pa.RecordBatch.from_arrays([label, pa.array(np.full(len(x), dim * 1000 + k, np.int64)), ids, lists], ["label", "block", "id", "cells"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = np.diff(np.asarray(b.column(2).offsets))
            for d in np.unique(size).tolist():
                own = np.flatnonzero(size == d)
                for i in range(0, len(own), 1024):
                    at = pa.array(own[i : i + 1024])
                    yield from one(b.column(0).take(at), b.column(1).take(at), _matrix(b.column(2).take(at)))

    return run


def _joined(trees: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The root of each row's tree after the links p-q: the smallest row that links reach."""
    while len(p):
        a, b = trees[p], trees[q]
        apart = a != b
        p, q, a, b = p[apart], q[apart], a[apart], b[apart]
        up = np.arange(len(trees))
        up[np.maximum(a, b)] = np.minimum(a, b)
        while (up[up] != up).any():
            up = up[up]
        trees = up[trees]
    return trees


def linked(ids: np.ndarray, copies: np.ndarray, side: np.ndarray, x: np.ndarray, lower: np.ndarray, block: int, cosine: float) -> tuple[np.ndarray, np.ndarray, int]:
    """Of one group's rows: (links of each, the row at the root of its tree, pairs compared).

    Rows of side 0 are compared with those of side 1, rows of side 2 with each other. ``lower`` holds, as bits, which
    earlier cells of the block a row has entered.
    """
    dim, k = block // 1000, block % 1000
    cut, unit, reach = blocks(dim), _unit(x), radii(dim, 2 - 2 * cosine) ** 2
    a, b = cut[k]
    s = unit @ rotation(dim)[:, a:b]
    sq = (s**2).sum(axis=1)
    alone = bool(len(side)) and side[0] == 2
    left, right = (np.arange(len(ids)),) * 2 if alone else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
    turned: np.ndarray | None = None
    links, trees, compared = np.zeros(len(ids), np.int64), np.arange(len(ids)), 0
    for i in range(0, len(left), 512):
        rows = left[i : i + 512]
        near = sq[rows, None] + sq[right] - 2 * s[rows] @ s[right].T <= reach[k] * (1 + SLACK) + 1e-12
        if alone:
            near &= rows[:, None] < right
        compared += near.size
        p, q = np.nonzero(near)
        p, q = rows[p], right[q]
        for j in range(0, len(p), 1 << 16):
            u, v = p[j : j + (1 << 16)], q[j : j + (1 << 16)]
            keep = np.einsum("ij,ij->i", unit[u], unit[v]) >= cosine
            keep[keep] = ~(lower[u[keep]] & lower[v[keep]]).any(axis=1)
            u, v = u[keep], v[keep]
            if not len(u):
                continue
            if turned is None:
                turned = _turned(unit)
            gap = np.stack([((turned[u, e:f] - turned[v, e:f]) ** 2).sum(axis=1) for e, f in cut], axis=1) <= reach
            own = gap.argmax(axis=1) == k
            u, v = u[own], v[own]
            links += np.bincount(u, copies[v], len(ids)).astype(np.int64) + np.bincount(v, copies[u], len(ids)).astype(np.int64)
            trees = _joined(trees, u, v)
    return links, trees, compared


def _compare(cosine: float):
    """Rows of one group after another, sorted: (id, links, mate) of each vector that has links."""

    def group(t: pa.Table) -> pa.RecordBatch | None:
        if t.num_rows < 2:
            return None
        ids, cell = t.column("id").to_numpy(), t.column("cell")[0].as_py()
        lists = t.column("cells").combine_chunks()
        whose = np.repeat(np.arange(len(ids)), np.diff(np.asarray(lists.offsets)))
        flat = np.asarray(lists.flatten())
        earlier = flat < cell
        kinds, at = np.unique(flat[earlier], return_inverse=True)
        bits = np.zeros((len(ids), max(1, len(kinds))), bool)
        bits[whose[earlier], at] = True
        n, trees, _ = linked(ids, t.column("copies").to_numpy(), t.column("side").to_numpy(), _matrix(t.column("v").combine_chunks()), np.packbits(bits, axis=1), t.column("block")[0].as_py(), cosine)
        own = np.flatnonzero(n)
        return pa.RecordBatch.from_arrays([pa.array(ids[own]), pa.array(n[own]), pa.array(ids[trees[own]])], ["id", "links", "mate"]) if len(own) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold: list[pa.RecordBatch] = []
        last = None
        for b in batches:
            if not b.num_rows:
                continue
            k = np.stack([b.column(b.schema.get_field_index(c)).to_numpy() for c in ("label", "block", "cell", "tile")], axis=1)
            cut = np.flatnonzero(np.concatenate(([last is None or (k[0] != last).any()], (k[1:] != k[:-1]).any(axis=1)))).tolist()
            ends = [*cut[1:], b.num_rows]
            if hold and (not cut or cut[0] > 0):
                hold.append(b.slice(0, cut[0] if cut else b.num_rows))
            for a, e in zip(cut, ends):
                if hold and (out := group(pa.Table.from_batches(hold))):
                    yield out
                hold = [b.slice(a, e - a)]
            last = k[-1]
        if hold and (out := group(pa.Table.from_batches(hold))):
            yield out

    return run


def pick_pivots(vectors: DataFrame, most: int) -> dict[int, np.ndarray]:
    """Rotated unit vectors by length: at most ``most`` rows, those of the least hash, of any label."""
    rows = vectors.select("v").orderBy(F.xxhash64("id"), "id").limit(most).collect()
    by: dict[int, list] = {}
    for r in rows:
        by.setdefault(len(r["v"]), []).append(r["v"])
    return {d: _unit(np.array(x, np.float64)) @ rotation(d) for d, x in by.items()}


def links(vectors: DataFrame, cosine: float, pivots: int = PIVOTS) -> DataFrame:
    """``vectors``: distinct (id long, label long, copies long, v array), sound. Returns (id, links, mate), some rows per
    vector that has links: their links sum to its number of linked rows of other vectors, and mates connect what links
    connect."""
    by_dim = pick_pivots(vectors, pivots)
    laid = stash(vectors.select("id", "label", "v").mapInArrow(_lay(2 - 2 * cosine, by_dim), "label long, block long, id long, cells array<int>"), "cells")
    cells = laid.select("id", "label", "block", F.explode("cells").alias("cell"), "cells")
    key = ["label", "block", "cell"]
    # Cells with more than a tile: as many tiles as they need; who has fewer needs no row here.
    full = stash(cells.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where(f"n > {TILE}").select(*key, F.ceil(F.col("n") / TILE).cast("int").alias("tiles")), "full")
    tiled = cells.join(full, key, "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    # A vector of tile t meets every tile j, in group (smaller, larger); its side there tells which it is.
    own = F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int")
    both = tiled.select("id", *key, "cells", own.alias("t"), "tiles", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("j"))
    both = both.select("id", *key, "cells", (F.least("t", "j") * F.col("tiles") + F.greatest("t", "j")).alias("tile"), F.when(F.col("t") < F.col("j"), 0).when(F.col("t") > F.col("j"), 1).otherwise(2).alias("side"))
    rows = both.join(vectors.select("id", "copies", "v"), "id").select(*key, "tile", "side", "id", "copies", "cells", "v")
    met = rows.repartition(*key, "tile").sortWithinPartitions(*key, "tile")
    return stash(met.mapInArrow(_compare(cosine), "id long, links long, mate long"), "links")


def embedding_components(rows: DataFrame, cosine: float = 0.98, pivots: int = PIVOTS, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per row of ``rows``: (vec_id, n_links, component_id, kept).

    n_links counts the other rows that link directly, equal vectors included; component_id is the smallest id that
    links reach, kept tells whether that is the row's own. Rows without a label or without a sound vector link with
    nothing, as do vectors of different lengths. Repeated ids count as rows of their own; a null id is never chosen
    unless no other is there. ``pivots`` bounds the sample that lays out the cells, which changes the work and not the
    result. Links between different vectors of one dense place are all compared, since each counts.
    """
    kind = dict(rows.dtypes)[vector_col]
    v = F.col(vector_col) if kind in ("array<float>", "array<double>") else F.transform(F.col(vector_col), lambda x: x.cast("double"))
    base = rows.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"), F.col(label_col).cast("long").alias("label"))
    base = base.withColumn("sound", sound(F.col("v"), F.col("label")))
    able = base.where("sound").select("vec_id", "label", "v")
    # Equal vectors are one: their smallest id, their number and, fixed once stashed, a number of its own.
    one = stash(able.groupBy("label", "v").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies")).withColumn("id", F.monotonically_increasing_id()), "distinct")
    met = links(one, cosine, pivots)
    n = met.groupBy("id").agg(F.sum("links").alias("links"))
    labels = stash(connected_components(met.select(F.col("id").alias("u"), F.col("mate").alias("v"))), "labels").select(F.col("node").alias("id"), F.col("label").alias("root"))
    member = stash(one.select("id", "rep", "copies").join(labels, "id", "left").join(n, "id", "left").select("id", "rep", "copies", "links", F.coalesce("root", "id").alias("root")), "members")
    head = stash(member.groupBy("root").agg(F.min("rep").alias("component_id")), "heads")
    named = member.join(head, "root").select("id", (F.coalesce("links", F.lit(0).cast("long")) + F.col("copies") - 1).alias("n_links"), "component_id")
    done = stash(one.select("id", "label", "v").join(named, "id").select("label", "v", "n_links", "component_id"), "named")
    drop_stash(met, member, head, one)
    linked_rows = able.join(done, ["label", "v"]).select("vec_id", "n_links", "component_id")
    alone = base.where(~F.col("sound")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked_rows.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
