"""N-gram Jaccard join by chosen paths.

A text is the set of its five-word shingles (one shingle of all its words if it has fewer).
Equal sets are joined by digest first. A set is embedded as the minima of ``COORDINATES`` hash
functions, so that two sets share a coordinate's token with probability of their Jaccard
similarity. Each run starts from one coordinate and splits all sets by their token there. A
bucket of few sets is compared by brute force. A larger one is split again, by three
coordinates chosen by its path, unless its sets are alike on average: then it too is compared
by brute force, in pairs of blocks, as is what is left after ``DEEPEST`` splits. ``runs_for`` gives
the number of runs for the wanted recall by the first coordinate; a split by three branches
loses less than a hundredth of a run's pairs besides.

Brute force compares minima, not sets, and yields a forest of candidates: sets that share a
passage only come into one tree no more for being in one bucket. Within each tree all pairs are
verified on the whole shingle sets, in pairs of blocks, by sparse-to-dense matrix products.

Defined cases: texts that are null or without a word have no set and link with nothing. Rows of
equal texts are linked copies, also where their ids are equal or null: sets are found by their
digests, never by ids. A class of rows without any id has the class id null. Each row is
returned. An empty table gives an empty one. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import ceil, log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytecoder import slices
from .common import Scratch, give_back, partitions
from .links import FOUND, blocks_of, connected_components, dealt, found_batch, groups, least_roots, results

WORDS, SIMILARITY, RECALL = 5, 0.8, 0.9999
COORDINATES, BRANCHES, LEAF, DEEPEST, ALIKE = 64, 3, 1024, 8, 0.5
_MIX = np.uint64(0x9E3779B97F4A7C15)
_ODD = np.random.default_rng(64).integers(0, 2**63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def runs_for(recall: float = RECALL, similarity: float = SIMILARITY) -> int:
    """A run's first coordinate keeps a pair together with the probability of its similarity."""
    return ceil(log(1 - recall) / log(1 - similarity))


def agreement(similarity: float = SIMILARITY, coordinates: int = COORDINATES) -> int:
    """Shared coordinates that a pair at the threshold falls short of by four deviations only."""
    return int(coordinates * similarity - 4 * (coordinates * similarity * (1 - similarity)) ** 0.5)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(texts: pa.Array, size: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts' shingles, and where each text's start (and the end)."""
    lists = pc.utf8_split_whitespace(pc.utf8_trim_whitespace(texts))
    flat, offsets = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    coded = flat.dictionary_encode()
    names = coded.dictionary.to_pylist()
    word = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in names), np.uint64, len(names))
    w = word[coded.indices.to_numpy()] if len(names) else np.empty(0, np.uint64)
    offsets = offsets - offsets[0]
    count = np.diff(offsets)
    blank = np.array([n for n in np.flatnonzero(count == 1) if not flat[int(offsets[n])].as_py()], np.int64)
    some = np.minimum(count, size)
    out = np.maximum(count - size + 1, np.minimum(count, 1))
    out[blank] = 0
    starts = np.cumsum(out) - out
    at = np.repeat(offsets[:-1] - starts, out) + np.arange(out.sum())
    length = np.repeat(some, out)
    h = np.zeros(len(at), np.uint64)
    for k in range(size):
        on = length > k
        h[on] = mixed(h[on] * _MIX + w[at[on] + k])
    return h, np.append(starts, out.sum())


def sketches(h: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Upper halves of the minima under each hash function; rows of texts that have shingles."""
    first = offsets[:-1][np.diff(offsets) > 0]
    out = np.empty((len(first), COORDINATES), np.int32)
    if len(first):
        for k in range(COORDINATES):
            out[:, k] = (np.minimum.reduceat(h * _ODD[k], first) >> np.uint64(32)).astype(np.uint32).view(np.int32)
    return out


def digest(own: np.ndarray) -> bytes:
    return hashlib.blake2b(own.tobytes(), digest_size=16).digest()


def signatures(rows: DataFrame) -> DataFrame:
    """doc_id, hash, key (digest of the shingle set, null if empty), size, sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in slices(batches):
            h, at = shingles(texts)
            sketch = iter(sketches(h, at))
            keys, sizes, rows_ = [], [], []
            for a, b in zip(at[:-1], at[1:], strict=True):
                own = np.unique(h[a:b])
                keys.append(digest(own) if len(own) else None)
                sizes.append(len(own))
                rows_.append(next(sketch) if len(own) else None)
            yield pa.RecordBatch.from_arrays([*ids.flatten(), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(rows_, pa.list_(pa.int32()))], ["doc_id", "hash", "key", "size", "sketch"])
        give_back()

    return rows.selectExpr("struct(doc_id, hash) id", "text").mapInArrow(run, "doc_id long, hash long, key binary, size long, sketch array<int>")


def sets_of(rows: DataFrame) -> DataFrame:
    """key and shingle set (sorted 64-bit hashes) of texts that have one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in slices(batches):
            h, at = shingles(texts)
            own = [np.unique(h[a:b]) for a, b in zip(at[:-1], at[1:], strict=True) if b > a]
            yield pa.RecordBatch.from_arrays([pa.array([digest(x) for x in own], pa.binary()), pa.array([x.tobytes() for x in own], pa.binary())], ["key", "set"])
        give_back()

    return rows.select("doc_id", "text").mapInArrow(run, "key binary, set binary")


def child_paths(path: Column) -> Column:
    """The path's children: coordinates chosen by the path, each with the set's token there."""

    def child(k: Column) -> Column:
        at = F.pmod(F.xxhash64(path, k), F.lit(COORDINATES)).cast("int")
        return F.struct(k.alias("branch"), F.xxhash64(path, k, F.get("sketch", at)).alias("child"))

    return F.transform(F.sequence(F.lit(1), F.lit(BRANCHES)), child)


def bucket_counts(nodes: DataFrame) -> DataFrame:
    """Buckets of two sets at least; those of equal members have equal n, x and s."""
    h = F.xxhash64("key")
    return nodes.groupBy("path").agg(F.count("*").alias("n"), F.bit_xor(h).alias("x"), F.bit_xor(F.xxhash64(h)).alias("s")).where("n > 1")


def candidate_forest(scratch: Scratch, reps: DataFrame) -> DataFrame:
    """Edges (a, b) between keys: a forest over each bucket's agreeing pairs."""
    start = F.transform(F.sequence(F.lit(0), F.lit(runs_for() - 1)), lambda r: F.xxhash64(F.lit("run"), r, F.get("sketch", r)))
    nodes = scratch.save(reps.select(F.explode(start).alias("path"), "key"), "nodes-0")
    every, compared = [nodes], []
    for depth in range(DEEPEST + 1):
        counts = scratch.save(bucket_counts(nodes), f"counts-{depth}")
        compared.append(counts.where(F.col("n") <= LEAF))
        large = scratch.save(nodes.join(counts.where(F.col("n") > LEAF).select("path", "n"), "path"), f"large-{depth}")
        if large.isEmpty():
            break
        below = large.join(reps.select("key", "sketch"), "key").select("path", "n", "key", F.inline(child_paths(F.col("path"))))
        below = scratch.save(below, f"below-{depth}")
        split = below.groupBy("path", "n", "branch", "child").agg(F.count("*").alias("c"))
        verdict = scratch.save(split.groupBy("path", "n").agg(F.sum(F.col("c") * F.col("c")).alias("q")), f"split-{depth}")
        alike = F.lit(True) if depth == DEEPEST else F.col("q") >= ALIKE * BRANCHES * F.col("n") * F.col("n")
        compared.append(counts.join(verdict.where(alike).select("path"), "path"))
        nodes = below.join(verdict.where(~alike).select("path"), "path").select(F.col("child").alias("path"), "key")
        nodes = scratch.save(nodes, f"nodes-{depth + 1}")
        every.append(nodes)
    few = compared[0]
    for more in compared[1:]:
        few = few.unionByName(more)
    once = scratch.save(few.groupBy("n", "x", "s").agg(F.min("path").alias("path")).select("path", "n"), "once")
    buckets = every[0]
    for more in every[1:]:
        buckets = buckets.union(more)
    buckets = buckets.join(once, "path")
    buckets = buckets.join(reps.select("key", "sketch"), "key").select("path", "n", "key", "sketch")
    buckets = dealt(buckets, ["path"], "key", F.ceil(F.col("n") / LEAF).cast("int")).drop("n")
    least = agreement()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, ["path", "lo", "hi"]):
            keys, own = t["key"].to_pylist(), t["own"].to_numpy()
            x = t["sketch"].combine_chunks().flatten().to_numpy().reshape(len(keys), COORDINATES)
            lo, hi = t["lo"][0].as_py(), t["hi"][0].as_py()
            a, b = np.flatnonzero(own == lo), np.flatnonzero(own == hi)
            hits = np.zeros((len(a), len(b)), np.int8)
            for k in range(COORDINATES):
                hits += x[a, None, k] == x[None, b, k]
            i, j = np.nonzero(np.triu(hits >= least, 1) if lo == hi else hits >= least)
            if len(i):
                root = least_roots(keys, a[i], b[j])
                some = np.flatnonzero(root != np.arange(len(root)))
                yield pa.RecordBatch.from_arrays([pa.array([keys[n] for n in some], pa.binary()), pa.array([keys[root[n]] for n in some], pa.binary())], ["a", "b"])
        give_back()

    return buckets.mapInArrow(run, "a binary, b binary")


def similar_pairs(a: list[np.ndarray], b: list[np.ndarray] | None, similarity: float = SIMILARITY) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of pairs whose Jaccard similarity is high enough; within a, each once, if b is None."""
    every = a if b is None else a + b
    sizes = np.fromiter(map(len, every), np.int64, len(every))
    row = np.repeat(np.arange(len(every)), sizes)
    values, code, df = np.unique(np.concatenate(every), return_inverse=True, return_counts=True)
    new = np.cumsum(df > 1) - 1
    keep = df[code] > 1
    row, col = row[keep], new[code[keep]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    width = int(col[-1]) + 1 if len(col) else 0
    n = len(a)
    shared = np.zeros((n, n if b is None else len(b)), np.float32)
    for at in range(0, width, 4096):
        lo, hi = np.searchsorted(col, (at, at + 4096))
        m = np.zeros((len(every), min(4096, width - at)), np.float32)
        m[row[lo:hi], col[lo:hi] - at] = 1
        shared += m @ m.T if b is None else m[:n] @ m[n:].T
    total = sizes[:n, None] + (sizes[None, :] if b is None else sizes[None, n:])
    exact = shared.astype(np.float64)
    good = exact >= similarity * (total - exact) - 1e-9
    return np.nonzero(np.triu(good, 1) if b is None else good)


def hashed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.selectExpr(f"cast(`{doc_id}` as long) doc_id", f"`{text}` text", f"xxhash64(`{text}`) hash")


def same_row(a: DataFrame, b: DataFrame) -> Column:
    return (a["hash"] == b["hash"]) & a["doc_id"].eqNullSafe(b["doc_id"])


def linked(scratch: Scratch, rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Signatures of all ``rows`` (doc_id, text, hash); one row a set: key, first (the row that
    stands for it: none, doc_id, hash), copies; and what the pairs of blocks found."""
    every = scratch.save(signatures(rows), "signatures")
    some = every.where("key is not null")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "hash"))
    reps = some.groupBy("key").agg(first.alias("first"), F.count("*").alias("copies"), F.any_value("size").alias("size"), F.any_value("sketch").alias("sketch"))
    reps = scratch.save(reps.withColumn("least", F.col("first.doc_id")), "reps")
    trees = connected_components(scratch, scratch.save(candidate_forest(scratch, reps), "candidates"), "trees")
    members = scratch.save(reps.select("key", "first", "copies", "size").join(trees, "key").withColumnRenamed("root", "tree"), "members")
    trees = scratch.save(members.groupBy("tree").agg(F.count("*").alias("count"), F.sum("size").alias("total")), "sizes")
    wanted = members.select("first.doc_id", "first.hash").distinct()
    sets = scratch.save(sets_of(rows.join(wanted, same_row(rows, wanted), "left_semi")), "sets")
    full = sets.groupBy("key").agg(F.any_value("set").alias("set")).join(members.select("key", "copies", "tree"), "key").join(trees, "tree")
    by_count, by_bytes = blocks_of(F.col("count"), 64, 16, 512), F.ceil(F.col("total") / (1 << 21)).cast("int")
    pairs = dealt(full.select("tree", "key", "copies", "set", "count", "total"), ["tree"], "key", F.greatest(by_count, by_bytes)).drop("count", "total")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, ["tree", "lo", "hi"]):
            keys, copies, own = t["key"].to_pylist(), t["copies"].to_numpy(), t["own"].to_numpy()
            sets_ = [np.frombuffer(x, "<u8") for x in t["set"].to_pylist()]
            lo, hi = t["lo"][0].as_py(), t["hi"][0].as_py()
            if lo == hi:
                i, j = similar_pairs(sets_, None)
            else:
                a, b = np.flatnonzero(own == lo), np.flatnonzero(own == hi)
                if not len(a) or not len(b):
                    continue
                i, j = similar_pairs([sets_[k] for k in a], [sets_[k] for k in b])
                i, j = a[i], b[j]
            links = np.bincount(i, copies[j], len(keys)) + np.bincount(j, copies[i], len(keys))
            yield found_batch(keys, links, least_roots(keys, i, j))
        give_back()

    return every, reps, scratch.save(pairs.mapInArrow(run, FOUND), "found")


def join(spark: SparkSession, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_links, class_id (least doc_id of the component) of every row."""
    scratch = Scratch(spark, "jaccard")
    every, reps, found = linked(scratch, hashed(docs, doc_id, text))
    return results(scratch, every, reps, found, "doc_id")


def one_of_each(spark: SparkSession, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of ``docs`` of each class, one with the least id, and all rows without a word.

    Rows are known by id and text: an id with two texts is two documents, and of rows without
    an id one of each class stays too. Of equal rows one stays.
    """
    scratch = Scratch(spark, "classes")
    every, reps, found = linked(scratch, hashed(docs, doc_id, text))
    roots = connected_components(scratch, found.select(F.col("key").alias("a"), F.col("root").alias("b")), "classes")
    tops = reps.join(roots, "key", "left").groupBy(F.coalesce("root", "key").alias("root")).agg(F.min("first").alias("first"))
    tops = tops.select("first.doc_id", "first.hash", F.lit(True).alias("once"))
    stay = scratch.save(tops.unionByName(every.where("key is null").select("doc_id", "hash", F.lit(False).alias("once")).distinct()), "stay")
    own = docs.select(*[F.col(f"`{c}`") for c in docs.columns], F.col(f"`{doc_id}`").cast("long").alias("__id"), F.xxhash64(f"`{text}`").alias("__hash"))
    stay = stay.toDF("__stay_id", "__stay_hash", "__once")
    kept = own.join(stay, (F.col("__hash") == F.col("__stay_hash")) & F.col("__id").eqNullSafe(F.col("__stay_id")))
    again = every.where("key is not null").groupBy("doc_id", "hash").agg(F.count("*").alias("n")).where("n > 1").select("doc_id", "hash")
    again = scratch.save(again, "again").toDF("__again_id", "__again_hash")
    kept = kept.join(again, (F.col("__hash") == F.col("__again_hash")) & F.col("__id").eqNullSafe(F.col("__again_id")), "left")
    more = F.col("__once") & F.col("__again_hash").isNotNull()
    names = [F.col(f"`{c}`") for c in docs.columns]
    return kept.where(~more).select(*names).unionByName(kept.where(more).dropDuplicates(["__id", "__hash"]).select(*names))
