"""Token ids on disk: one zstandard frame a document, all frames with one trained dictionary.

A store is a folder with

* ``dictionary-<sha256>``: the dictionary, trained on serialized id arrays. Training sees
  ``SAMPLE`` documents at most, drawn at random, of ``SAMPLE_CHARS`` characters at most; it
  decides sizes only, never what is stored.
* ``shard-<n>-<attempt>``: the frames of consecutive documents, then their index (doc ids, which
  of them are null, frame offsets, token counts), then a footer with the index's place, the
  dictionary's SHA-256 and the bytes an id takes.
* ``manifest``: a JSON line for the store and one for each shard, with its first and last id and
  the number of tokens before it. It is written last: a shard of a task that failed or ran twice
  is not in it, and so not part of the store.

Documents lie in ascending order of their ids. A document is read by itself: manifest, footer and
index lead to its frame. Frames are made before anything is shuffled; the range partitioning that
puts them in order moves compressed frames only. Equal ids are told apart by a row number, so that
a repeated id is dealt over shards as well. Folders are opened with ``pyarrow.fs``, by their URI.

Defined cases: null counts as the empty text: the end token only. Null ids come first. Repeated
rows are rows like any other. Without documents to train on, frames have no dictionary. An empty
table gives a store without shards. Very long texts are one frame each. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .bytecoder import slices
from .common import Scratch, partitions
from .packing import library_encoder

#: Documents that a dictionary is trained on, their length, and the size of the dictionary.
SAMPLE, SAMPLE_CHARS, DICTIONARY = 1024, 50_000, 64 << 10
#: Compressed bytes of a shard, about; decoded bytes of a batch that is read.
SHARD, BATCH = 64 << 20, 4 << 20
LEVEL = 3
FOOTER = struct.Struct("<QQ32sB7s")
MARK = b"tokids1"
#: Fixed value: what a trained dictionary begins with.
TRAINED = b"\x37\xa4\x30\xec"
FRAMES = "doc_id long, n_tokens long, size long, frame binary"


def trained(samples: Sequence[bytes], size: int = DICTIONARY) -> bytes:
    """A dictionary, or raw content where there is too little to train on."""
    if sum(map(len, samples)) < 8:
        return b""
    try:
        return zstandard.train_dictionary(size, list(samples), level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def _content(dictionary: bytes) -> zstandard.ZstdCompressionDict:
    kind = zstandard.DICT_TYPE_FULLDICT if dictionary.startswith(TRAINED) else zstandard.DICT_TYPE_RAWCONTENT
    return zstandard.ZstdCompressionDict(dictionary, dict_type=kind)


@lru_cache(maxsize=2)
def compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    if not dictionary:
        return zstandard.ZstdCompressor(level=LEVEL)
    content = _content(dictionary)
    content.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=content)


@lru_cache(maxsize=2)
def decompressor(dictionary: bytes) -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor(dict_data=_content(dictionary)) if dictionary else zstandard.ZstdDecompressor()


def id_arrays(docs: DataFrame, path: str, ranks_path: str, pattern: str, end: int, width: int, dictionary: bytes | None) -> DataFrame:
    """FRAMES of every document; the plain arrays where there is no dictionary yet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = library_encoder(path, ranks_path, pattern)
        shrink = (lambda a: a) if dictionary is None else compressor(dictionary).compress
        for keys, texts in slices(batches):
            counts, frames = [], []
            for ids in own.encode(texts):
                a = np.append(np.frombuffer(ids, "<u4"), np.uint32(end))
                counts.append(len(a))
                frames.append(shrink(a.astype(f"<u{width}").tobytes()))
            yield pa.RecordBatch.from_arrays([keys, pa.array(counts, pa.int64()), pa.array(map(len, frames), pa.int64()), pa.array(frames, pa.large_binary()).cast(pa.binary())], ["doc_id", "n_tokens", "size", "frame"])

    return docs.select("doc_id", "text").mapInArrow(run, FRAMES)


def _opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


@dataclass
class Shard(WriterCommitMessage):
    number: int
    file: str
    docs: int
    tokens: int
    low: int | None
    high: int | None


class ShardWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str]):
        self.root, self.dictionary, self.width = options["path"], options["dictionary"], int(options["width"])

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Shard:
        """One shard, under a name of its own, so that an attempt never meets another's file."""
        from pyspark import TaskContext

        store, root = _opened(self.root)
        number = TaskContext.get().partitionId()
        file = f"shard-{number:06d}-{uuid.uuid4().hex}"
        ids: list[pa.Array] = []
        sizes: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        out = None
        for b in iterator:
            if not b.num_rows:
                continue
            out = out or store.open_output_stream(f"{root}/{file}")
            frames = b.column(b.schema.get_field_index("frame")).to_pylist()
            for frame in frames:
                out.write(frame)
            ids.append(b.column(b.schema.get_field_index("doc_id")))
            counts.append(b.column(b.schema.get_field_index("n_tokens")).to_numpy())
            sizes.append(np.array([len(f) for f in frames], np.int64))
        if out is None:
            return Shard(number, "", 0, 0, None, None)
        every = pa.concat_arrays(ids)
        n_tokens, ends = np.concatenate(counts).astype("<i8"), np.cumsum(np.concatenate(sizes)).astype("<i8")
        for part in (every.fill_null(0).to_numpy().astype("<i8"), every.is_null().to_numpy(zero_copy_only=False).astype("u1"), ends, n_tokens):
            out.write(part.tobytes())
        out.write(FOOTER.pack(len(every), int(ends[-1]), bytes.fromhex(self.dictionary), self.width, MARK))
        out.close()
        known = every.drop_null()
        return Shard(number, file, len(every), int(n_tokens.sum()), known[0].as_py() if len(known) else None, known[-1].as_py() if len(known) else None)

    def commit(self, messages: list[Shard | None]) -> None:
        store, root = _opened(self.root)
        lines, before = [{"dictionary": self.dictionary, "width": self.width}], 0
        for m in sorted((m for m in messages if m and m.docs), key=lambda m: m.number):
            lines.append({"file": m.file, "docs": m.docs, "tokens": m.tokens, "before": before, "low": m.low, "high": m.high})
            before += m.tokens
        with store.open_output_stream(f"{root}/manifest") as out:
            out.write("\n".join(map(json.dumps, lines)).encode())

    def abort(self, messages: list[Shard | None]) -> None:
        store, root = _opened(self.root)
        for m in messages:
            if m and m.file:
                store.delete_file(f"{root}/{m.file}")


@dataclass
class Piece(InputPartition):
    file: str
    before: int

    def __init__(self, file: str, before: int):
        super().__init__(file)
        self.file, self.before = file, before


class ShardReader(DataSourceReader):
    """``doc_ids`` (a JSON list) reads these documents alone: shards without them are not opened."""

    def __init__(self, options: dict[str, str]):
        self.root = options["path"]
        self.wanted = json.loads(options["doc_ids"]) if "doc_ids" in options else None

    def partitions(self) -> list[InputPartition]:
        store, root = _opened(self.root)
        with store.open_input_stream(f"{root}/manifest") as f:
            shards = [json.loads(x) for x in f.read().decode().split("\n")][1:]
        if self.wanted is not None:
            own = sorted(self.wanted)
            shards = [s for s in shards if s["low"] is not None and np.searchsorted(own, s["low"]) < np.searchsorted(own, s["high"], side="right")]
        return [Piece(s["file"], s["before"]) for s in shards]

    def read(self, partition: Piece | None) -> Iterator[pa.RecordBatch]:
        if not isinstance(partition, Piece):  # a store without shards
            return
        store, root = _opened(self.root)
        with store.open_input_file(f"{root}/{partition.file}") as f:
            yield from self._read(f, partition.before, lambda sha: _dictionary(self.root, sha))

    def _read(self, f: pa.NativeFile, before: int, dictionary) -> Iterator[pa.RecordBatch]:
        f.seek(f.size() - FOOTER.size)
        n, at, sha, width, mark = FOOTER.unpack(f.read(FOOTER.size))
        if mark != MARK:
            raise ValueError("not a shard of token ids")
        plain = decompressor(dictionary(sha.hex()))
        f.seek(at)
        ids, null, ends, counts = (np.frombuffer(f.read(n * k), kind) for k, kind in ((8, "<i8"), (1, "u1"), (8, "<i8"), (8, "<i8")))
        starts, firsts = before + np.cumsum(counts) - counts, np.append(0, ends[:-1])
        rows = np.arange(n) if self.wanted is None else np.flatnonzero(np.isin(ids, self.wanted) & (null == 0))
        group = (np.cumsum(4 * counts[rows]) // BATCH) if len(rows) else rows
        for part in np.split(rows, np.flatnonzero(np.diff(group)) + 1) if len(rows) else []:
            low, together = int(firsts[part[0]]), part[-1] - part[0] + 1 == len(part)
            raw = b""
            if together:
                f.seek(low)
                raw = f.read(int(ends[part[-1]]) - low)
            out = []
            for k in part.tolist():
                if together:
                    frame = raw[int(firsts[k]) - low : int(ends[k]) - low]
                else:
                    f.seek(int(firsts[k]))
                    frame = f.read(int(ends[k] - firsts[k]))
                out.append(np.frombuffer(plain.decompress(frame), f"<u{width}").astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids[part], mask=null[part] == 1), pa.array(starts[part]), pa.array(counts[part]), pa.array(out, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])


@lru_cache(maxsize=2)
def _dictionary(root: str, sha: str) -> bytes:
    store, path = _opened(root)
    with store.open_input_stream(f"{path}/dictionary-{sha}") as f:
        found = f.read()
    if hashlib.sha256(found).hexdigest() != sha:
        raise ValueError("the dictionary is not the one that the shard was written with")
    return found


class TokenShards(DataSource):
    """``spark.read.format("token_shards")``: doc_id, start, n_tokens, ids (little-endian unsigned 32-bit)."""

    @classmethod
    def name(cls) -> str:
        return "token_shards"

    def schema(self) -> str:
        return "doc_id long, start long, n_tokens long, ids binary"

    def reader(self, schema) -> ShardReader:
        return ShardReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> ShardWriter:
        return ShardWriter(dict(self.options))


def write(spark: SparkSession, docs: DataFrame, root: str, path: str, ranks_path: str, pattern: str, end: int = 2, doc_id: str = "doc_id", text: str = "text") -> None:
    """Encodes all documents into a new store at ``root``, a URI."""
    from tokenizers import Tokenizer

    spark.dataSource.register(TokenShards)
    scratch = Scratch(spark, "token-files")
    own = docs.selectExpr(f"cast(`{doc_id}` as long) doc_id", f"`{text}` text")
    width = 2 if max(Tokenizer.from_file(path).get_vocab_size(), end + 1) <= 1 << 16 else 4
    share = min(1.0, 2 * SAMPLE / max(1, own.count()))
    few = own.sample(share, seed=SAMPLE).where(F.length("text") <= SAMPLE_CHARS).limit(SAMPLE)  # about twice as many are drawn, whatever the table's size
    dictionary = trained([r["frame"] for r in id_arrays(few, path, ranks_path, pattern, end, width, None).select("frame").collect()])  # SAMPLE short documents at most
    sha = hashlib.sha256(dictionary).hexdigest()
    store, folder = _opened(root)
    store.create_dir(folder, recursive=True)
    with store.open_output_stream(f"{folder}/dictionary-{sha}") as out:
        out.write(dictionary)
    frames = scratch.save(id_arrays(own, path, ranks_path, pattern, end, width, dictionary).withColumn("nth", F.monotonically_increasing_id()), "frames")
    size = frames.agg(F.sum("size")).first()[0] or 0
    ordered = frames.repartitionByRange(max(min(partitions(spark), -(-size // (1 << 20))), -(-size // SHARD), 1), F.col("doc_id").asc_nulls_first(), "nth")
    ordered = ordered.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "nth").select("doc_id", "n_tokens", "frame")
    ordered.write.format("token_shards").mode("append").option("path", root).option("dictionary", sha).option("width", width).save()
    scratch.drop("frames")


def read(spark: SparkSession, root: str, doc_ids: Sequence[int] | None = None) -> DataFrame:
    """doc_id, start, n_tokens, ids of all documents of a store, or of those asked for."""
    spark.dataSource.register(TokenShards)
    reader = spark.read.format("token_shards").option("path", root)
    return (reader if doc_ids is None else reader.option("doc_ids", json.dumps(list(doc_ids)))).load()


def round_trip(spark: SparkSession, docs: DataFrame, path: str, ranks_path: str, pattern: str, end: int = 2) -> DataFrame:
    """Writes a store in the shared folder and reads it back."""
    root = f"{Scratch(spark, 'token-store').root}/store"
    write(spark, docs, root, path, ranks_path, pattern, end)
    return read(spark, root)
