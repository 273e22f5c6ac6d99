"""Centroid clustering on whole numbers, each vector assigned by annulus search.

Vectors become integers, floor(scale * x). Centroids start as the vectors whose ids come first in
order of a hash. A round assigns every vector to its nearest centroid and moves each centroid to
the floor of its vectors' mean; sums are exact, so the result does not depend on how rows lie in
partitions. What goes through the driver is one row of sums a centroid, never a vector.

Annulus search: centroids are sorted by norm. The one whose norm is nearest to a vector's bounds
its distance from above; since | |x| - |c| | <= |x - c|, only centroids whose norms lie in the
annulus of that width around |x| can be as near, and binary search finds them. These alone are
compared, in exact arithmetic; the annulus is wide enough for rounding, so that ties on its border
are compared too and the smaller number wins.

Defined cases: vectors that are null, of another length, or with null or non-finite components are
left out. Components beyond 2**27 in size after scaling are held at that bound, so that squared
distances fit a long. Fewer vectors than centroids give as many centroids as vectors; rows of
equal ids start centroids in the order of their components, rows without an id after all others.
Repeated rows count each. An empty table gives an empty one. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch

#: Largest component after scaling, and the largest whose products are exact in double precision.
BOUND, EXACT = 1 << 27, 1 << 22
#: Vectors compared at a time.
BLOCK = 8192


class Annulus:
    """Centroids in order of their norms."""

    def __init__(self, centers: np.ndarray):
        self.exact = bool((np.abs(centers) < EXACT).all()) if centers.size else True
        norms = np.sqrt((centers.astype(np.float64) ** 2).sum(1))
        self.number = np.argsort(norms, kind="stable")
        self.norms, self.centers = norms[self.number], centers[self.number]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest centroid of each row, and the squared distance; exact."""
        kind = np.float64 if self.exact and (np.abs(x) < EXACT).all() else np.int64
        x, centers = x.astype(kind), self.centers.astype(kind)
        xx, cc = (x * x).sum(1), (centers * centers).sum(1)
        norm = np.sqrt(xx.astype(np.float64))
        right = np.clip(np.searchsorted(self.norms, norm), 1, max(1, len(self.norms) - 1)) if len(self.norms) > 1 else np.zeros(len(x), np.int64)
        left = np.maximum(right - 1, 0)
        first = np.where(np.abs(self.norms[left] - norm) <= np.abs(self.norms[right] - norm), left, right)
        best = xx + cc[first] - 2 * (x * centers[first]).sum(1)
        which = self.number[first]
        reach = np.sqrt(best.astype(np.float64))
        reach += 1e-9 * (reach + norm) + 1e-6
        low, high = np.searchsorted(self.norms, norm - reach), np.searchsorted(self.norms, norm + reach, side="right")
        for p, number in enumerate(self.number.tolist()):
            rows = np.flatnonzero((low <= p) & (p < high) & (first != p))
            if not len(rows):
                continue
            own = x if len(rows) == len(x) else x[rows]
            far = xx[rows] + cc[p] - 2 * (own @ centers[p])
            nearer = (far < best[rows]) | ((far == best[rows]) & (number < which[rows]))
            rows = rows[nearer]
            best[rows], which[rows] = far[nearer], number
        return which, best.astype(np.int64)


def whole_vectors(vectors: DataFrame, dim: int, scale: float, vec_id: str, embedding: str) -> DataFrame:
    """vec_id, v: the components as little-endian 32-bit integers, of those vectors that are kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            right = pc.fill_null(pc.equal(pc.list_value_length(b.column(1)), dim), False)
            ids, lists = b.column(0).filter(right), b.column(1).filter(right)
            x = pc.fill_null(lists.flatten(), float("nan")).to_numpy(zero_copy_only=False).reshape(-1, dim)
            good = np.isfinite(x).all(1)
            with np.errstate(over="ignore"):
                v = np.clip(np.floor(x[good] * scale), -BOUND, BOUND).astype("<i4")
            yield pa.RecordBatch.from_arrays([ids.filter(pa.array(good)), pa.array([row.tobytes() for row in v], pa.binary())], ["vec_id", "v"])

    return vectors.selectExpr(f"cast(`{vec_id}` as long) vec_id", f"cast(`{embedding}` as array<double>) e").mapInArrow(run, "vec_id long, v binary")


def blocks(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    for b in batches:
        for at in range(0, b.num_rows, BLOCK):
            part = b.slice(at, BLOCK)
            yield part.column(0), np.frombuffer(b"".join(part.column(1).to_pylist()), "<i4").reshape(-1, dim).astype(np.int64)


def assigned(vectors: DataFrame, centers: np.ndarray) -> DataFrame:
    """vec_id, cluster, distance (squared)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Annulus(centers)
        for ids, x in blocks(batches, centers.shape[1]):
            which, far = own.nearest(x)
            yield pa.RecordBatch.from_arrays([ids, pa.array(which.astype(np.int32)), pa.array(far)], ["vec_id", "cluster", "distance"])

    return vectors.mapInArrow(run, "vec_id long, cluster int, distance long")


def moved(vectors: DataFrame, centers: np.ndarray) -> np.ndarray:
    """The centroids after a round. A task returns a row of sums for each centroid it met."""
    k, dim = centers.shape
    names = [f"s{i}" for i in range(dim)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, sums, counts = Annulus(centers), np.zeros((k, dim), np.int64), np.zeros(k, np.int64)
        for _, x in blocks(batches, dim):
            which, _ = own.nearest(x)
            counts += np.bincount(which, minlength=k)
            np.add.at(sums, which, x)
        met = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(counts[met]), *(pa.array(sums[met, i]) for i in range(dim))], ["cluster", "n", *names])

    parts = vectors.mapInArrow(run, "cluster int, n long, " + ", ".join(f"{s} long" for s in names))
    out = centers.copy()
    for row in parts.groupBy("cluster").agg(*[F.sum(c).alias(c) for c in ("n", *names)]).collect():  # a row a centroid
        out[row["cluster"]] = [row[s] // row["n"] for s in names]
    return out


def first_centers(vectors: DataFrame, k: int, seed: int, dim: int) -> np.ndarray:
    """The vectors whose ids have the least hashes."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.withColumn("h", h).orderBy(F.col("h").asc_nulls_last(), "v").limit(k).select("v").collect()
    return np.array([np.frombuffer(r["v"], "<i4") for r in rows], np.int64).reshape(-1, dim)


def cluster(
    spark: SparkSession, vectors: DataFrame, k: int = 40, rounds: int = 5, dim: int = 64, scale: float = 256.0, seed: int = 2, vec_id: str = "vec_id", embedding: str = "embedding"
) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every kept vector, and the centroids."""
    scratch = Scratch(spark, "centroids")
    own = scratch.save(whole_vectors(vectors, dim, scale, vec_id, embedding), "whole")
    centers = first_centers(own, k, seed, dim)
    for _ in range(rounds if len(centers) else 0):
        centers = moved(own, centers)
    placed = scratch.save(assigned(own, centers), "assigned")
    total = {r["cluster"]: int(r["far"]) for r in placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("far")).collect()}  # a row a centroid
    top = (1 << 63) - 1
    inertia = min(sum(total.values()), top)
    rows = [(c, min(far, top), inertia, hashlib.sha256(",".join(map(str, centers[c].tolist())).encode()).hexdigest()) for c, far in total.items()]
    stats = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return placed.join(F.broadcast(stats), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"), centers  # k rows at most
