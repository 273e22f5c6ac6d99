"""Cross-entropy difference of two matched word bigram models.

The background model is counted over all documents, the target model over those labelled as
of high quality. Both share one vocabulary (all words), one set of explicit bigrams (all that
occur) and one smoothing: absolute discounting, the discounted mass going to add-one unigrams.
A document's score is its mean loss per token under the target model less that under the
background model; the lower, the more it resembles the target.

The models grow with the input and lie in no one place: texts are dealt into chunks of some
megabytes; each chunk sends its different bigrams, then its words, as hashes of 64 bits, to
buckets, which sum them over all chunks and send back the sums that the chunk needs to score its
texts. The corpus's totals are sums of the buckets' own, partial ones first; one row goes to all
chunks. All is one query, so the texts are dealt out once and read again for each of the steps.

Texts of one id are dealt to as many as ``SALTS`` chunks, and a label to all of these, so that an
id that is repeated very often fills no chunk alone.

Defined cases: a text that is null or has no word has no tokens and null losses. Without any
target document both models are the background. Repeated rows count as often as they occur and
are each returned. Rows with a null id count for the background only. Labels of one document
agree if any says 1; labels without an id or of no document count for nothing. An empty table
gives no scores. Very long texts are scored whole. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


DISCOUNT = 0.5
#: Bytes of text in a chunk, on average.
CHUNK = 8 << 20
#: Chunks that the different texts of one id are dealt to.
SALTS = 8
#: Stands for the word before a text's first one.
START = np.uint64(0x9E3779B97F4A7C15)
#: Kinds of rows: a document, a label, what a chunk asks for, and the sums sent back to it.
DOCUMENT, LABEL, ASKED, PAIR_SUMS, WORD_SUMS, TOTALS = range(6)
ROWS = "kind int, chunk long, bucket long, parts array<binary>, sums array<long>"


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All lower-cased words, and each text's first one (and the end)."""
    lists = pc.utf8_split_whitespace(pc.utf8_trim_whitespace(pc.utf8_lower(texts)))
    flat, offsets = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)  # an empty text gives one empty word
    return flat.filter(pa.array(full)), np.append(0, np.cumsum(full))[offsets]


def packed(a: np.ndarray) -> bytes:
    """Whole numbers from 0 in the narrowest type, compressed; its letter first."""
    kind = np.min_scalar_type(int(a.max(initial=0)))
    return kind.char.encode() + zlib.compress(a.astype(kind).tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data[1:]), chr(data[0]))


def packed_keys(keys: np.ndarray, buckets: int) -> bytes:
    """Sorted keys of one bucket: the low bytes of their steps that are in use, place by place."""
    steps = np.diff(keys // np.uint64(buckets), prepend=np.uint64(0)).astype("<u8")
    width = max(1, -(-int(steps.max()).bit_length() // 8))
    return steps.view("u1").reshape(-1, 8)[:, :width].T.tobytes() + bytes([width])


def unpacked_keys(data: bytes, buckets: int, bucket: int) -> np.ndarray:
    low = np.frombuffer(data[:-1], "u1").reshape(data[-1], -1)
    steps = np.zeros((low.shape[1], 8), "u1")
    steps[:, : data[-1]] = low.T
    return np.cumsum(steps.view("<u8").ravel(), dtype=np.uint64) * np.uint64(buckets) + np.uint64(bucket)


def rows_of(rows: list[tuple[int, int, int, list[bytes]]], sums: list[int] | None = None) -> pa.Table:
    """Rows of ``ROWS``; where ``sums`` are given, those of the last one."""
    types = (pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.binary()))
    cols = list(zip(*rows, strict=True)) or [()] * 4
    last = pa.array([None] * (len(rows) - 1) + [sums] if rows else [], pa.list_(pa.int64()))
    return pa.table([*(pa.array(c, t) for c, t in zip(cols, types, strict=True)), last], ["kind", "chunk", "bucket", "parts", "sums"])


def by_bucket(keys: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """Places of the keys of each bucket that has some; equal sorted keys give equal places."""
    bucket = (keys % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    found, starts = np.unique(bucket[order], return_index=True)
    yield from zip(found.tolist(), np.split(order, starts[1:]), strict=True) if len(found) else ()


class Chunk:
    """Texts as places in the sorted hashes of the chunk's own words and bigrams, whatever the rows' order."""

    def __init__(self, texts: pa.Array):
        flat, self.offsets = words_of(texts)
        coded = flat.dictionary_encode()
        own = pd.util.hash_array(coded.dictionary.to_numpy(zero_copy_only=False), categorize=False).astype(np.uint64)
        word = own[coded.indices.to_numpy(zero_copy_only=False)]
        before = np.empty_like(word)
        before[1:] = word[:-1]
        before[self.offsets[:-1][np.diff(self.offsets) > 0]] = START
        pair = before * np.uint64(0x9E3779B97F4A7C15) + word
        pair = (pair ^ (pair >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        self.pairs, at, self.of = np.unique(pair ^ (pair >> np.uint64(32)), return_index=True, return_inverse=True)
        self.words = np.unique(np.append(own, START))
        self.before_at, self.word_at = np.searchsorted(self.words, before[at]), np.searchsorted(self.words, word[at])


def chunk_of(table: pa.Table) -> tuple[pa.Array, Chunk, np.ndarray, np.ndarray]:
    """A chunk's document ids, its words and bigrams, and the bigrams' counts in all and in target documents."""
    kind = table["kind"]
    docs, labelled = table.filter(pc.equal(kind, DOCUMENT)), table.filter(pc.equal(kind, LABEL))["doc_id"].combine_chunks()
    ids, c = docs["doc_id"].combine_chunks(), Chunk(pc.fill_null(docs["text"], "").combine_chunks())
    target = pc.and_(pc.is_valid(ids), pc.is_in(ids, value_set=labelled)).to_numpy(zero_copy_only=False)
    good = np.repeat(target.astype(np.float64), np.diff(c.offsets))
    return ids, c, np.bincount(c.of, minlength=len(c.pairs)), np.bincount(c.of, good, len(c.pairs)).astype(np.int64)


def filled(table: pa.Table, kind: int, keys: np.ndarray, buckets: int, width: int) -> np.ndarray:
    """What was sent back for the keys, in their order."""
    sent = table.filter(pc.equal(table["kind"], kind))
    sent = dict(zip(sent["bucket"].to_pylist(), sent["parts"].to_pylist(), strict=True))
    full = np.zeros((width, len(keys)))
    for bucket, at in by_bucket(keys, buckets):
        for k, data in enumerate(sent[bucket]):
            full[k, at] = unpacked(data)
    return full


def asked(table: pa.Table, buckets: int) -> pa.Table:
    """A chunk's bigrams with their counts."""
    _, c, n, t = chunk_of(table)
    chunk = table["chunk"][0].as_py()
    return rows_of([(ASKED, chunk, bucket, [packed_keys(c.pairs[at], buckets), packed(n[at]), packed(t[at])]) for bucket, at in by_bucket(c.pairs, buckets)])


def in_bucket(table: pa.Table, buckets: int) -> tuple[list[tuple], list[list[np.ndarray]], np.ndarray, np.ndarray, list[np.ndarray]]:
    """A bucket's rows, their parts, its different keys, the first place of each, and the places of each row's keys."""
    rows = [(r["kind"], r["chunk"], r["bucket"], r["parts"]) for r in table.sort_by("chunk").to_pylist()]
    parts = [[unpacked_keys(r[3][0], buckets, r[2]), *map(unpacked, r[3][1:])] for r in rows]
    keys, first, of = np.unique(np.concatenate([p[0] for p in parts]), return_index=True, return_inverse=True)
    return rows, parts, keys, first, np.split(of, np.cumsum([len(p[0]) for p in parts])[:-1])


def sums_of(parts: list[list[np.ndarray]], places: list[np.ndarray], different: int) -> np.ndarray:
    sums = np.zeros((len(parts[0]) - 1, different), np.int64)
    for p, at in zip(parts, places, strict=True):
        for k, x in enumerate(p[1:]):
            sums[k, at] += x.astype(np.int64)  # a chunk has each key once
    return sums


def summed_pairs(table: pa.Table, buckets: int) -> pa.Table:
    """Two sums for each bigram of a chunk, and whether the chunk is the first one that has it."""
    rows, parts, keys, first, places = in_bucket(table, buckets)
    n, t = sums_of(parts, places, len(keys))
    own = np.zeros(sum(map(len, places)), np.int64)
    own[first] = 1
    owns = np.split(own, np.cumsum([len(at) for at in places])[:-1])
    return rows_of([(PAIR_SUMS, r[1], r[2], [packed(x) for x in (n[at], t[at], mine)]) for r, at, mine in zip(rows, places, owns, strict=True)])


def asked_words(table: pa.Table, sent: pa.Table, buckets: int) -> pa.Table:
    """A chunk's words: counts as words, as histories, and of the different bigrams that follow, each counted by one chunk."""
    _, c, n, t = chunk_of(table)
    if not len(c.pairs):
        return rows_of([])
    all_n, all_t, own = filled(sent, PAIR_SUMS, c.pairs, buckets, 3)
    columns = (c.word_at, n), (c.word_at, t), (c.before_at, n), (c.before_at, t), (c.before_at, own * (all_n > 0)), (c.before_at, own * (all_t > 0))
    sums = [np.bincount(at, x, len(c.words)).astype(np.int64) for at, x in columns]
    chunk = table["chunk"][0].as_py()
    return rows_of([(ASKED, chunk, bucket, [packed_keys(c.words[at], buckets), *(packed(x[at]) for x in sums)]) for bucket, at in by_bucket(c.words, buckets)])


def summed_words(table: pa.Table, buckets: int) -> pa.Table:
    """Six sums for each word of a chunk, and the bucket's different words and tokens."""
    rows, parts, keys, _, places = in_bucket(table, buckets)
    sums = sums_of(parts, places, len(keys))
    out = [(WORD_SUMS, r[1], r[2], [packed(x[at]) for x in sums]) for r, at in zip(rows, places, strict=True)]
    return rows_of([*out, (TOTALS, -1, rows[0][2], [])], [int(x.sum()) for x in (sums[0] > 0, sums[0], sums[1])])


def scored(table: pa.Table, sent: pa.Table, buckets: int) -> pa.Table:
    """The losses of a chunk's documents by the sums that were sent back."""
    ids, c, _, _ = chunk_of(table)
    n, losses = np.diff(c.offsets), [np.zeros(len(ids))] * 2
    if len(c.pairs):
        different, *tokens = sent.filter(pc.equal(sent["kind"], TOTALS))["sums"][0].as_py()
        pairs, words = filled(sent, PAIR_SUMS, c.pairs, buckets, 2), filled(sent, WORD_SUMS, c.words, buckets, 6)
        losses = []
        for which in (1 if tokens[1] else 0, 0):
            unigram = (words[which] + 1) / (tokens[which] + different + 2)
            total = np.maximum(words[2 + which], 1)
            rest = np.maximum(1e-9, 1 - (words[2 + which] - DISCOUNT * words[4 + which]) / total)
            loss = -np.log(np.maximum(pairs[which] - DISCOUNT, 0) / total[c.before_at] + rest[c.before_at] * unigram[c.word_at])
            sums = np.zeros(len(n))
            sums[n > 0] = np.add.reduceat(loss[c.of], c.offsets[:-1][n > 0])
            losses.append(sums / np.maximum(n, 1))
    cols = [pa.array(x, pa.float64(), mask=n == 0) for x in (*losses, losses[0] - losses[1])]
    return pa.table([ids, pa.array(n), *cols], ["doc_id", "n_tokens", "target_loss", "background_loss", "score"])


def dealt_out(texts: DataFrame, labels: DataFrame, chunks: int) -> DataFrame:
    """Documents, and the target's labels, by chunk; every text of an id meets its label."""
    chunk = f"pmod(if(doc_id is null, xxhash64(text), xxhash64(doc_id, salt)), {chunks}) chunk"
    good = labels.where("quality = 1").selectExpr("cast(doc_id as long) doc_id").where("doc_id is not null")
    good = good.selectExpr("doc_id", "cast(null as string) text", f"explode(sequence(0L, {SALTS - 1}L)) salt")
    texts = texts.selectExpr("doc_id", "text", f"pmod(xxhash64(text), {SALTS}) salt")
    return texts.selectExpr(f"{DOCUMENT} kind", chunk, "doc_id", "text").unionByName(good.selectExpr(f"{LABEL} kind", chunk, "doc_id", "text"))


def score(spark: SparkSession, docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss, score."""
    octets = docs.agg(F.sum(F.octet_length(f"`{text}`"))).first()[0] or 0
    chunks = buckets = max(1, -(-octets // CHUNK))
    dealt = dealt_out(docs.selectExpr(f"cast(`{doc_id}` as long) doc_id", f"`{text}` text"), labels, chunks).groupBy("chunk")
    pairs = dealt.applyInArrow(lambda t: asked(t, buckets), ROWS).groupBy("bucket").applyInArrow(lambda t: summed_pairs(t, buckets), ROWS)
    words = dealt.cogroup(pairs.groupBy("chunk")).applyInArrow(lambda t, sent: asked_words(t, sent, buckets), ROWS).groupBy("bucket").applyInArrow(lambda t: summed_words(t, buckets), ROWS)
    every = words.where(f"kind = {TOTALS}").groupBy("kind").agg(F.array(*[F.sum(F.get("sums", F.lit(k))) for k in range(3)]).alias("sums"))  # one row
    every = every.selectExpr("*", f"explode(sequence(0L, {chunks - 1}L, 1024L)) first")
    every = every.selectExpr("kind", f"explode(sequence(first, least(first + 1023, {chunks - 1}L))) chunk", "-1L bucket", "cast(null as array<binary>) parts", "sums")
    again = pairs.withColumn("parts", F.slice("parts", 1, 2))  # scores need no note of who counts a bigram
    sent = again.unionByName(words.where(f"kind = {WORD_SUMS}")).unionByName(every).groupBy("chunk")
    return dealt.cogroup(sent).applyInArrow(lambda t, sent: scored(t, sent, buckets), "doc_id long, n_tokens long, target_loss double, background_loss double, score double")
