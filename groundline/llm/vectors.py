"""Near-duplicate vectors by collision counting on one-dimensional projections.

Vectors of a label are projected onto many random directions. Each projection is sorted; around
every query's value lies a window, found by binary search, and a pair collides where the other
vector falls into it. Pairs with at least ``needed`` collisions are verified by cosine in double
precision. Window and count follow from the similarity and the wanted recall: a pair at the
threshold misses the count with probability 1 - ``RECALL`` at most.

A large label is not counted all with all. A run cuts each of a few further projections into
randomly shifted cells, and only vectors of the same cells are compared; ``cuts`` gives as many
projections as bring an even bucket down to ``LEAF`` vectors, and ``runs`` as many runs as keep
the recall of ``CUT_RECALL``. So copies and comparisons of a vector grow with about the fourth
root of the label's size. A pair that shares buckets in several runs counts in the first of them.
Buckets that are larger all the same, of vectors that are truly alike, are compared in blocks.

Equal vectors of a label are compared once. Defined cases: vectors that are null, empty, zero or
hold null or non-finite components, and vectors without a label, link with nothing; finite
components of any size do, being scaled by a power of two first. Vectors of different lengths
never link. Ids may be null or equal: repeated rows are rows like any other, each returned and
counted; a class of rows without any id has the component id null. An empty table gives an empty
one. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from math import ceil, comb, erf, exp, lgamma, log, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch
from .links import FOUND, blocks_of, dealt, found_batch, groups, least_roots, results

PROJECTIONS, WIDTH, RECALL = 24, 2.0, 0.99999
#: Vectors that are counted all with all; width of a cell in deviations of a pair at the threshold; recall of all runs.
LEAF, CELL, CUT_RECALL = 2048, 4.0, 0.9999
#: Rows of the counted matrix that are worked on at a time.
ROWS = 256


def needed(projections: int = PROJECTIONS, width: float = WIDTH, recall: float = RECALL) -> int:
    """The largest count that a pair at the threshold reaches with this probability."""
    p = erf(width / sqrt(2))
    tail = 0.0
    for k in range(projections, -1, -1):
        tail += comb(projections, k) * p**k * (1 - p) ** (projections - k)
        if tail >= recall:
            return k
    return 0


@lru_cache(maxsize=8)
def directions(dim: int, projections: int = PROJECTIONS) -> np.ndarray:
    d = np.random.default_rng(20_240_229).normal(size=(dim, projections))
    return d / np.linalg.norm(d, axis=0)


def cuts(count: int, similarity: float, leaf: int) -> int:
    """Projections to cut, from how rarely two random vectors share a cell."""
    c = CELL * sqrt(1 - similarity)
    apart = erf(c / sqrt(2)) - sqrt(2 / pi) / c * (1 - exp(-c * c / 2))
    return max(0, ceil(log(leaf / count) / log(apart))) if count > leaf else 0


def runs(cut: int, dim: int) -> int:
    """A pair at the threshold is parted by a cell's border with the chance of its mean distance over the cell."""
    mean = sqrt(dim / pi) * exp(lgamma(dim / 2) - lgamma((dim + 1) / 2))
    return ceil(log(1 - CUT_RECALL) / log(1 - (1 - mean / CELL) ** cut)) if cut else 1


def cells(unit: np.ndarray, cut: int, similarity: float) -> np.ndarray:
    """(vector, run) -> the bucket, as a hash of the cells."""
    count, dim = unit.shape
    out = np.zeros((count, runs(cut, dim)), np.uint64)
    width = CELL * sqrt(2 - 2 * similarity) / sqrt(dim)
    for run in range(out.shape[1] if cut else 0):
        rng = np.random.default_rng((dim, run))
        way = rng.normal(size=(dim, cut))
        at = np.floor(unit @ (way / np.linalg.norm(way, axis=0)) / width + rng.random(cut)).astype(np.int64).astype(np.uint64)
        for k in range(cut):
            out[:, run] = (out[:, run] ^ at[:, k]) * np.uint64(0x9E3779B97F4A7C15)
            out[:, run] ^= out[:, run] >> np.uint64(29)
    return out.view(np.int64)


def linked_pairs(x: np.ndarray, y: np.ndarray | None, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of linked pairs between x and y, or within x (each once) if y is None; 65,535 rows at most."""
    same = y is None
    y = x if y is None else y
    nx, ny = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
    way = directions(x.shape[1])
    half = WIDTH * sqrt(2 - 2 * similarity) / sqrt(x.shape[1]) + 1e-12
    px, py = (x / nx[:, None]) @ way, (y / ny[:, None]) @ way
    place, low, wide = np.empty((way.shape[1], len(y)), np.uint16), np.empty(px.shape, np.uint16), np.empty(px.shape, np.uint16)
    for m in range(way.shape[1]):
        order = np.argsort(py[:, m], kind="stable")
        place[m, order] = np.arange(len(y))
        line = py[order, m]
        low[:, m] = np.searchsorted(line, px[:, m] - half)
        wide[:, m] = np.searchsorted(line, px[:, m] + half, side="right") - low[:, m]
    least, found = needed(), []
    for top in range(0, len(x), ROWS):
        first = top if same else 0
        hits = np.zeros((min(ROWS, len(x) - top), len(y) - first), np.int8)
        for m in range(way.shape[1]):  # a place before the window wraps to a large number
            hits += place[m, first:] - low[top : top + ROWS, m, None] < wide[top : top + ROWS, m, None]
        i, j = np.nonzero(hits >= least)
        i, j = i + top, j + first
        if same:
            i, j = i[i < j], j[i < j]
        for at in range(0, len(i), 1 << 16):
            a, b = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
            good = np.einsum("nd,nd->n", x[a], y[b]) / (nx[a] * ny[b]) >= similarity
            found.append((a[good], b[good]))
    return np.concatenate([f[0] for f in found] or [np.empty(0, np.int64)]), np.concatenate([f[1] for f in found] or [np.empty(0, np.int64)])


def packed(a: np.ndarray) -> bytes:
    """In single precision where that loses nothing."""
    single = a.astype("<f4")
    return single.tobytes() if np.array_equal(single.astype("<f8"), a) else a.tobytes()


def unpacked(vecs: list[bytes], dim: int) -> np.ndarray:
    return np.stack([np.frombuffer(v, "<f4" if len(v) == 4 * dim else "<f8") for v in vecs]).astype(np.float64)


def keyed(rows: DataFrame) -> DataFrame:
    """vec_id, label, key (null where nothing can link), dim, vec (scaled by a power of two, little-endian)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, dims, vecs = [], [], []
            labels, lists = b.column(1).to_pylist(), b.column(2)
            for n, label in enumerate(labels):
                v = lists[n].values
                ok = label is not None and v is not None and len(v) > 0 and v.null_count == 0
                if ok:
                    a = v.to_numpy(zero_copy_only=False).astype("<f8")
                    ok = bool(np.isfinite(a).all()) and bool(a.any())
                if ok:
                    a = a + 0.0  # one zero, not two
                    raw = a.tobytes()
                    keys.append(hashlib.blake2b(raw, digest_size=16, key=hashlib.sha256(label.encode()).digest()).digest())
                    dims.append(len(a))
                    vecs.append(packed(np.ldexp(a, -int(np.frexp(np.abs(a).max())[1]))))
                else:
                    keys.append(None)
                    dims.append(0)
                    vecs.append(None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(keys, pa.binary()), pa.array(dims, pa.int32()), pa.array(vecs, pa.binary())], ["vec_id", "label", "key", "dim", "vec"])

    return rows.mapInArrow(run, "vec_id long, label string, key binary, dim int, vec binary")


def near_duplicates(spark: SparkSession, vectors: DataFrame, similarity: float = 0.93, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, n_links, component_id of every row."""
    scratch = Scratch(spark, "vectors")
    rows = vectors.selectExpr(f"cast(`{vec_id}` as long) vec_id", f"cast(`{label}` as string) label", f"cast(`{embedding}` as array<double>) embedding")
    every = scratch.save(keyed(rows), "keyed")
    some = every.where("key is not null")
    reps = some.groupBy("key").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.any_value("label").alias("label"), F.any_value("dim").alias("dim"), F.any_value("vec").alias("vec"))
    reps = scratch.save(reps, "reps")
    sizes = scratch.save(reps.groupBy("label", "dim").agg(F.count("*").alias("size")), "sizes")
    places = scratch.save(placed(reps.join(sizes, ["label", "dim"]), similarity), "places")
    where = places.select("label", "dim", "key", "buckets", F.posexplode("buckets").alias("run", "bucket"))
    together = scratch.save(where.groupBy("label", "dim", "run", "bucket").agg(F.count("*").alias("size")).where("size > 1"), "together")
    live = where.join(together, ["label", "dim", "run", "bucket"]).join(reps.select("key", "copies", "vec"), "key")
    names = ["label", "dim", "run", "bucket"]
    pairs = dealt(live.select(*names, "key", "copies", "vec", "buckets", "size"), names, "key", blocks_of(F.col("size"), LEAF, 1, LEAF)).drop("size")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, [*names, "lo", "hi"]):
            keys, copies, own = t["key"].to_pylist(), t["copies"].to_numpy(), t["own"].to_numpy()
            x = unpacked(t["vec"].to_pylist(), t["dim"][0].as_py())
            lo, hi, nth = t["lo"][0].as_py(), t["hi"][0].as_py(), t["run"][0].as_py()
            if lo == hi:
                i, j = linked_pairs(x, None, similarity)
            else:
                a, b = np.flatnonzero(own == lo), np.flatnonzero(own == hi)
                if not len(a) or not len(b):
                    continue
                i, j = linked_pairs(x[a], x[b], similarity)
                i, j = a[i], b[j]
            earlier = t["buckets"].combine_chunks().flatten().to_numpy().reshape(len(keys), -1)[:, :nth]
            new = np.ones(len(i), bool)
            for at in range(0, len(i) if nth else 0, 1 << 16):
                a, b = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
                new[at : at + len(a)] = ~(earlier[a] == earlier[b]).any(1)
            i, j = i[new], j[new]
            links = np.bincount(i, copies[j], len(keys)) + np.bincount(j, copies[i], len(keys))
            yield found_batch(keys, links, least_roots(keys, i, j))

    found = scratch.save(pairs.mapInArrow(run, FOUND), "found")
    return results(scratch, every, reps, found, "vec_id").withColumnRenamed("class_id", "component_id")


def placed(reps: DataFrame, similarity: float) -> DataFrame:
    """label, dim, key and the bucket in each run, for vectors with the ``size`` of their label."""
    leaf = LEAF

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims, sizes, vecs = b.column(3).to_numpy(), b.column(4).to_pylist(), b.column(2).to_pylist()
            buckets: list[np.ndarray | None] = [None] * len(vecs)
            kinds = np.array([(d, cuts(n, similarity, leaf)) for d, n in zip(dims.tolist(), sizes, strict=True)], np.int64).reshape(-1, 2)
            for dim, cut in np.unique(kinds, axis=0).tolist():
                rows = np.flatnonzero((kinds == (dim, cut)).all(1))
                x = unpacked([vecs[k] for k in rows], dim)
                for k, row in zip(rows.tolist(), cells(x / np.linalg.norm(x, axis=1)[:, None], cut, similarity), strict=True):
                    buckets[k] = row
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(3), b.column(1), pa.array(buckets, pa.list_(pa.int64()))], ["label", "dim", "key", "buckets"])

    return reps.select("label", "key", "vec", "dim", "size").mapInArrow(run, "label string, dim int, key binary, buckets array<long>")
