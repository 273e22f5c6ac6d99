"""Spelling groups, token stores and centroid clusters against brute force, and their edge rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from groundline.llm import centroids, queries, spelling, token_files
from groundline.llm.common import Scratch

tokenizers = pytest.importorskip("public_tokenizers")
CLASH = ["word", "n", "root", "frame", "size", "nth", "cluster", "v", "h"]


def clashing(df):
    return df.withColumns({c: F.lit("clash") for c in CLASH})


# Spelling groups


def brute_groups(rows, least=7):
    counts: Counter[str] = Counter()
    for key, text in rows:
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for run in re.findall("[a-zÀ-ÿ]+", lowered):
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= least and c >= 2}
    letters = sorted({c for w in n for c in w})

    def near(w):
        out = {w[:i] + w[i + 1 :] for i in range(len(w))}
        out |= {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in letters}
        out |= {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in letters}
        return (out - {w}) & n.keys()

    form, found = {}, {}
    for w in n:
        own = near(w)
        best = min(own, key=lambda o: (-n[o], o), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
        found[w] = len(own)
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], found[w], n[form[w]] if form[w] else None))
    return sorted(out, key=str)


def variants(rng, n=120):
    """Words of few letters, runs of equal ones among them, and their one-edit neighbours, in counts from one to hundreds."""
    letters, out = "abé", []
    for _ in range(n):
        w = "".join(rng.choice(letters) for _ in range(rng.randint(7, 10)))
        for v in (w, w[:3] + "b" + w[3:], w[:-1], w + "a", "a" + w, w[:4] + "z" + w[5:], w.upper()):
            out += [v] * rng.choice((1, 2, 2, 3, 30, 400))
    rng.shuffle(out)
    return [(i if i % 9 else None, " ".join(out[at : at + 40]) + rng.choice((".", "\n", "1x", ""))) for i, at in enumerate(range(0, len(out), 40))]


@pytest.mark.parametrize("hot", [20_000, 5])
def test_spelling_groups_equal_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(spelling, "HOT", hot)  # with five, nearly all nodes go by key
    rows = [*variants(random.Random(hot)), (5, None), (6, ""), (7, "short words only 123")]
    docs = spark.createDataFrame([*rows, *rows[:3]], "doc_id long, text string")
    got = sorted((tuple(r) for r in spelling.group(spark, clashing(docs)).collect()), key=str)
    want = brute_groups([*rows, *rows[:3]])
    assert got == want
    assert any(r[1] and r[2] != r[1] for r in got), "no chain of forms"


def test_spelling_of_long_runs_and_empty_tables(spark):
    long = "ab" * 30_000
    docs = spark.createDataFrame([(1, f"{long} {long}"), (2, f"{long}x {long}x")], "doc_id long, text string")
    assert sorted((len(r.word), r.n, r.n_near) for r in spelling.group(spark, docs).collect()) == [(60_000, 2, 1), (60_001, 2, 1)]
    assert spelling.group(spark, docs.limit(0)).count() == 0


# Token stores


def store(spark, docs):
    root = f"{Scratch(spark, 'store-test').root}/store"
    token_files.write(spark, docs, root, queries.tokenizer_file("byte_bpe_50k.json"), queries.tokenizer_file("byte_bpe_50k.tiktoken"), queries.split_pattern())
    return root


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer_file("byte_bpe_50k.json"))


def test_token_store_keeps_the_librarys_ids_in_order(spark, library):
    rng = random.Random(7)
    texts = [" ".join(f"word{rng.randrange(300)}" for _ in range(rng.randint(1, 60))) for _ in range(300)]
    rows = [*((rng.randrange(10**12), t) for t in texts), (4, None), (None, "no id"), (5, ""), (5, ""), (5, "again"), (6, "<|endoftext|> été 中文 🙂"), (7, "long " * 200_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    root = store(spark, clashing(docs))
    got = token_files.read(spark, root).collect()
    assert sorted(str((r.doc_id, bytes(r.ids))) for r in got) == sorted(str((k, np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes())) for k, t in rows)
    in_order = sorted(got, key=lambda r: r.start)
    keys = [-1 if r.doc_id is None else r.doc_id for r in in_order]
    assert keys == sorted(keys)
    assert [r.start for r in in_order] == np.cumsum([0, *(r.n_tokens for r in in_order)])[:-1].tolist()
    some = token_files.read(spark, root, [5, rows[0][0], 99]).collect()
    assert sorted((r.doc_id, r.start, bytes(r.ids)) for r in some) == sorted((r.doc_id, r.start, bytes(r.ids)) for r in got if r.doc_id in (5, rows[0][0]))


def test_token_store_is_what_its_manifest_names(spark):
    docs = spark.range(50).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    root = store(spark, docs)
    folder = Path(root.removeprefix("file://"))
    (folder / "shard-000000-stray").write_bytes(b"left by a task that failed")
    assert token_files.read(spark, root).count() == 50
    dictionary = next(folder.glob("dictionary-*"))
    assert hashlib.sha256(dictionary.read_bytes()).hexdigest() == dictionary.name.removeprefix("dictionary-")
    dictionary.write_bytes(b"another")
    token_files._dictionary.cache_clear()
    with pytest.raises(Exception, match="dictionary"):
        list((reader := token_files.ShardReader({"path": root})).read(reader.partitions()[0]))


def test_dictionary_makes_short_documents_smaller(spark):
    rng = random.Random(1)
    samples = [np.array([rng.randrange(200) + 1000 for _ in range(40)] * 2, "<u2").tobytes() for _ in range(500)]
    d = token_files.trained(samples)
    own = samples[3]
    assert token_files.decompressor(d).decompress(token_files.compressor(d).compress(own)) == own
    assert len(token_files.compressor(d).compress(own)) < len(token_files.compressor(b"").compress(own))
    assert token_files.trained([]) == b"" and token_files.trained([b"too little to train"]) == b"too little to train"


def test_token_store_of_no_documents(spark):
    assert token_files.read(spark, store(spark, spark.createDataFrame([], "doc_id long, text string"))).count() == 0


def test_query_crc_is_that_of_all_ids(spark, library, tmp_path):
    spark.createDataFrame([(3, "a text"), (1, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    ids = np.array([*library.encode("a text", add_special_tokens=False).ids, 2], "<u4")
    got = sorted(tuple(r) for r in queries.op12_token_files(spark, str(tmp_path)).collect())
    assert got == [(1, 0, 1, zlib.crc32(np.array([2], "<u4").tobytes())), (3, 1, len(ids), zlib.crc32(ids.tobytes()))]


# Centroid clusters


def brute_clusters(rows, k, rounds):
    kept = []
    for key, e in rows:
        if e is not None and len(e) == 64 and all(x is not None and np.isfinite(x) for x in e):
            kept.append((key, [int(max(-(2**27), min(2**27, np.floor(256 * x)))) for x in e]))
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), np.array(r[1], "<i4").tobytes()))[:k]
    centers = [list(v) for _, v in first]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centers))
    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        for n in range(len(centers)):
            if members := [v for (_, v), c in zip(kept, own, strict=True) if c == n]:
                centers[n] = [sum(x) // len(members) for x in zip(*members, strict=True)]
    return sorted(((key, nearest(v)[1], nearest(v)[0]) for key, v in kept), key=str), centers


@pytest.mark.parametrize("scale", [0.1, 40_000.0])
def test_clusters_equal_brute_force(spark, scale):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=64) * scale * (1 + i % 4)).tolist()) for i in range(150)]
    rows += [rows[3], rows[3], (None, rows[4][1]), (900, None), (901, []), (902, [1.0] * 63), (903, [float("nan")] * 64), (904, [1.0] * 63 + [None]), (905, [float("inf")] * 64), (906, [0.0] * 64), (907, [1e300] + [0.0] * 63)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    found, centers = centroids.cluster(spark, clashing(df), k=12)
    want, want_centers = brute_clusters(rows, 12, 5)
    got = found.collect()
    assert sorted(((r.vec_id, r.cluster, r.distance) for r in got), key=str) == want
    assert centers.tolist() == want_centers
    for r in got:
        assert r.cluster_inertia == sum(d for _, c, d in want if c == r.cluster) and r.inertia == sum(d for _, _, d in want)
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, want_centers[r.cluster])).encode()).hexdigest()


def test_annulus_leaves_out_far_norms_and_keeps_ties():
    centers = np.array([[0, 5], [5, 0], [100, 0], [0, -5], [0, 0]], np.int64)
    own = centroids.Annulus(centers)
    which, far = own.nearest(np.array([[5, 5], [90, 1], [0, 0], [3, -3]], np.int64))
    assert which.tolist() == [0, 2, 4, 1] and far.tolist() == [25, 101, 0, 13]
    rng = np.random.default_rng(5)
    for size in (3, 1 << 24):  # in double precision, and beyond what it holds exactly
        centers, x = rng.integers(-size, size, (17, 6)), rng.integers(-size, size, (300, 6))
        every = ((x[:, None, :].astype(object) - centers[None].astype(object)) ** 2).sum(2)
        which, far = centroids.Annulus(centers).nearest(x)
        assert which.tolist() == [min(range(17), key=lambda n: (row[n], n)) for row in every] and far.tolist() == [min(row) for row in every]


def test_clusters_of_few_or_no_vectors(spark):
    df = spark.createDataFrame([(1, [0.5] * 64), (2, [0.25] * 64)], "vec_id long, embedding array<double>")
    found, centers = centroids.cluster(spark, df)
    assert len(centers) == 2 and found.count() == 2
    found, centers = centroids.cluster(spark, df.limit(0))
    assert len(centers) == 0 and found.count() == 0
