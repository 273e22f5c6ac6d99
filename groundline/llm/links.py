"""Shared by the similarity joins: blocks of pairs, local forests, connected components, results.

Rows to be compared all with all are dealt into blocks; a task gets one pair of blocks and
returns, for each row, how many links it found and the root of the row's tree in a spanning
forest of these links. So what is shuffled grows with rows times blocks, never with links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .common import Scratch, partitions


def blocks_of(count: Column, small: int, few: int, large: int) -> Column:
    """How many blocks: of ``small`` rows while there are ``few`` at most, then of ``large`` rows."""
    return F.greatest(F.lit(1), F.least(F.ceil(count / small), F.greatest(F.lit(few), F.ceil(count / large)))).cast("int")


def dealt(rows: DataFrame, group: list[str], key: str, blocks: Column) -> DataFrame:
    """A row for every pair of blocks that its own block is in; sorted, one pair in one task."""
    spark = rows.sparkSession
    a = rows.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64(key), F.col("blocks")).cast("int"))
    a = a.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    a = a.withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other")).drop("other", "blocks")
    cols = [*group, "lo", "hi"]
    return a.repartition(partitions(spark), *cols).sortWithinPartitions(*cols)


def groups(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.Table]:
    """Runs of equal ``names`` in sorted batches."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        change = np.zeros(n, bool)
        for name in names:
            codes = batch.column(name).dictionary_encode().indices.to_numpy(zero_copy_only=False)
            change[1:] |= codes[1:] != codes[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), n]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            key = tuple(batch.column(name)[a].as_py() for name in names)
            if key != last and held:
                yield pa.Table.from_batches(held)
                held = []
            last = key
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def local_roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n nodes the least node of its component under the edges (i, j)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new]
        if np.array_equal(new, root):
            return root
        root = new


def binary(column: pa.ChunkedArray) -> list[bytes]:
    return column.to_pylist()


FOUND = "key binary, links long, root binary"


def least_roots(keys: list[bytes], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each key the place of the least key of its component."""
    order = np.array(sorted(range(len(keys)), key=keys.__getitem__), np.int64)
    place = np.empty(len(keys), np.int64)
    place[order] = np.arange(len(keys))
    return order[local_roots(len(keys), place[i], place[j])[place]]


def found_batch(keys: list[bytes], links: np.ndarray, root: np.ndarray) -> pa.RecordBatch:
    """Rows that have a link or a root other than themselves."""
    some = np.flatnonzero((links > 0) | (root != np.arange(len(root))))
    return pa.RecordBatch.from_arrays([pa.array([keys[k] for k in some], pa.binary()), pa.array(links[some].astype(np.int64)), pa.array([keys[k] for k in root[some]], pa.binary())], ["key", "links", "root"])


def connected_components(scratch: Scratch, edges: DataFrame, name: str) -> DataFrame:
    """(key, root) of every node in an edge (a, b); the root is the component's least key.

    Alternating stars: every node first links its larger neighbours to its least one, then its
    smaller ones; edges never grow in number, and a round shortens paths by about half. Each
    round is a table in the shared folder, and what tells whether it changed anything is
    observed while it is written. Least neighbours are written before they are joined, so that a
    node of many edges can be split among tasks.
    """
    state = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    state, mark = _observed(scratch, state, f"{name}-0")
    turn = 0
    while mark[0]:
        turn += 1
        both = state.union(state.select("b", "a"))
        least = scratch.save(both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")), f"{name}-m{turn}")
        large = both.join(least, both["a"] == least["u"]).where("b > a").select(F.col("b").alias("a"), F.least("u", "m").alias("b"))
        large = scratch.save(large, f"{name}-l{turn}")
        least = scratch.save(large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")), f"{name}-n{turn}")
        small = large.join(least, large["a"] == least["u"]).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        last = mark
        state, mark = _observed(scratch, small.union(least.select("u", "m")).distinct(), f"{name}-{turn}")
        scratch.drop(f"{name}-m{turn}", f"{name}-l{turn}", f"{name}-n{turn}", f"{name}-{turn - 1}")
        if mark == last:
            break
    roots = state.select(F.col("b").alias("key"), F.col("b").alias("root")).distinct()
    return state.select(F.col("a").alias("key"), F.col("b").alias("root")).union(roots)


def _observed(scratch: Scratch, edges: DataFrame, name: str) -> tuple[DataFrame, tuple]:
    """The written table, and a fingerprint of its rows in any order."""
    seen = Observation()
    h = F.xxhash64("a", "b")
    table = scratch.save(edges.observe(seen, F.count("*").alias("n"), F.bit_xor(h).alias("x"), F.sum(F.xxhash64(h).cast("decimal(38,0)")).alias("s")), name)
    return table, (seen.get["n"], seen.get["x"], seen.get["s"])


def results(scratch: Scratch, members: DataFrame, reps: DataFrame, found: DataFrame, row_id: str) -> DataFrame:
    """(row_id, n_links, class_id) of every row of ``members`` (row_id, key; null key: no links).

    ``reps`` has key, least (the least id of its rows) and copies; ``found`` what the pairs of
    blocks returned. Links of a row: the other rows of its key, and all rows of linked keys.
    """
    sums = found.groupBy("key").agg(F.sum("links").alias("links"))
    roots = connected_components(scratch, found.select(F.col("key").alias("a"), F.col("root").alias("b")), "classes")
    joined = reps.select("key", "least", "copies").join(sums, "key", "left").join(roots, "key", "left")
    joined = scratch.save(joined.select("key", "least", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "key").alias("root")), "linked")
    tops = scratch.save(joined.groupBy("root").agg(F.min("least").alias("class_id")), "tops")
    classes = scratch.save(joined.join(tops, "root").select("key", "n_links", "class_id"), "results")
    with_key = members.where("key is not null").select(row_id, "key").join(classes, "key").select(row_id, "n_links", "class_id")
    alone = members.where("key is null").select(row_id, F.lit(0).cast("long").alias("n_links"), F.col(row_id).alias("class_id"))
    return with_key.unionByName(alone)
