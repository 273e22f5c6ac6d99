"""Band files of scenes as a data source: pixels are read by ranges of rows and written as streams.

A scene is a folder with ``meta.json``, ``yard.json`` and a file a band: ``width``, ``height`` and
``data``, the values in rows from the top. No row of a table and no task's memory holds a band.
Reading is planned from the folder's listing: a file is cut into stripes of rows by its size. A
stripe begins where ``<band>.rows`` says (byte offsets of every ``EVERY``-th row, left by the
writer), or else after the values before it were counted off. Folders are opened with ``pyarrow.fs``.

``scene_id`` may be given as an option, or is taken from the filters that Spark pushes down where
``spark.sql.python.filterPushdown.enabled`` is set; other scenes' folders are then not opened.

A write goes to names of its own; the files get their final names when all tasks have succeeded,
so a lost task leaves nothing that a reader sees.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterable, Iterator
from contextlib import ExitStack
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage

from ..functions.unknown import known
from .errors import Malformed
from .scenes import META_NAMES, JsonScenes, SceneSource

#: Bytes of a stripe, about; values of a batch; rows between two offsets of the index.
STRIPE, BATCH, EVERY, CHUNK = 32 << 20, 1 << 17, 64, 1 << 20
HEAD = 4096
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


@dataclass
class Header:
    width: int
    height: int
    start: int  # of the first value, in bytes


def header(f: pa.NativeFile) -> Header:
    """Width, height and where the values begin; the sizes may stand before or after them."""
    f.seek(0)
    head = f.read(HEAD)
    data = re.search(rb'"data"\s*:\s*\[', head)
    if not data:
        raise ValueError("no array of values")
    f.seek(max(0, f.size() - HEAD))
    around = head[: data.start()] + b" " + f.read(HEAD)
    sizes = [re.search(rb'"%s"\s*:\s*(\d+)' % n, around) for n in (b"width", b"height")]
    if not all(sizes):
        raise ValueError("no width or height")
    return Header(int(sizes[0][1]), int(sizes[1][1]), data.end())


def numbers(piece: bytes) -> np.ndarray:
    """Values of a list without brackets; null and NaN are unknown."""
    return np.array([float("nan") if (t := x.strip()) in (b"null", b"NaN") else float(t) for x in piece.split(b",")])


def values(f: pa.NativeFile, at: int, skip: int, count: int | None) -> Iterator[np.ndarray]:
    """``count`` values (all, if None) after the first ``skip`` from byte ``at`` on, as they come."""
    f.seek(at)
    held, ended = b"", False
    while not ended and (count is None or count > 0):
        chunk = f.read(CHUNK)
        held += chunk
        ended = not chunk or b"]" in chunk
        if ended:
            piece, held = held.split(b"]", 1)[0], b""
        else:
            piece, _, held = held.rpartition(b",")
        if not piece.strip():
            continue
        there = piece.count(b",") + 1
        if there <= skip:
            skip -= there
            continue
        own = numbers(piece)[skip:]
        skip = 0
        if count is not None:
            own = own[:count]
            count -= len(own)
        yield own


def rebatched(parts: Iterator[np.ndarray], size: int) -> Iterator[np.ndarray]:
    held: list[np.ndarray] = []
    for part in parts:
        held.append(part)
        if sum(map(len, held)) >= size:
            every = np.concatenate(held)
            whole = len(every) // size * size
            yield from np.split(every[:whole], whole // size)
            held = [every[whole:]]
    if held and len(rest := np.concatenate(held)):
        yield rest


@dataclass
class Stripe(InputPartition):
    scene: str
    part: int
    parts: int

    def __init__(self, scene: str, part: int, parts: int):
        super().__init__((scene, part))
        self.scene, self.part, self.parts = scene, part, parts


@dataclass
class Folders(InputPartition):
    """Scenes whose files are counted in one task."""

    scenes: list[str]

    def __init__(self, scenes: list[str]):
        super().__init__(tuple(scenes))
        self.scenes = scenes


class BandReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = options["path"].rstrip("/")
        self.bands = options["bands"].split(",")
        self.check = options.get("check", "false") == "true"
        self.stripe = int(options.get("stripe", STRIPE))
        self.only = {options["scene_id"]} if "scene_id" in options else None

    def partitions(self) -> list[InputPartition]:
        store, root = fs.FileSystem.from_uri(self.root)
        if self.only is None:
            scenes = sorted(i.base_name for i in store.get_file_info(fs.FileSelector(root)) if i.type == fs.FileType.Directory)
        else:
            scenes = sorted(self.only)
        if self.check:
            return [Folders(scenes[at : at + 64]) for at in range(0, len(scenes), 64)]
        out: list[InputPartition] = []
        for at in range(0, len(scenes), 1000):
            some = scenes[at : at + 1000]
            for scene, found in zip(some, store.get_file_info([f"{root}/{s}/{self.bands[0]}.json" for s in some]), strict=True):
                parts = max(1, -(-(found.size or 0) // self.stripe)) if found.type == fs.FileType.File else 0
                out += [Stripe(scene, k, parts) for k in range(parts)]
        return out

    def read(self, partition: InputPartition | None) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(self.root)
        if isinstance(partition, Stripe):
            yield from self._pixels(store, f"{root}/{partition.scene}", partition)
        elif isinstance(partition, Folders):
            for scene in partition.scenes:
                yield from self._checked(store, f"{root}/{scene}", scene)

    def _pixels(self, store: fs.FileSystem, folder: str, own: Stripe) -> Iterator[pa.RecordBatch]:
        with ExitStack() as held:
            files = [held.enter_context(store.open_input_file(f"{folder}/{b}.json")) for b in self.bands]
            heads = [header(f) for f in files]
            width, height = heads[0].width, heads[0].height
            if any((h.width, h.height) != (width, height) for h in heads):
                raise Malformed(folder, "bands of different sizes")
            low, high = height * own.part // own.parts, height * (own.part + 1) // own.parts
            size = max(1, BATCH // max(1, width)) * width
            streams = []
            for band, f, head in zip(self.bands, files, heads, strict=True):
                at, first = self._indexed(store, f"{folder}/{band}.rows", low, head.start)
                streams.append(rebatched(values(f, at, (low - first) * width, (high - low) * width), size))
            place = low * width
            for parts in zip(*streams, strict=False):
                n = min(map(len, parts))
                at = np.arange(place, place + n)
                place += n
                yield pa.RecordBatch.from_arrays([pa.array([own.scene] * n, pa.string()), pa.array((at // width).astype(np.int32)), pa.array((at % width).astype(np.int32)), *(pa.array(p[:n], mask=np.isnan(p[:n])) for p in parts)], ["scene_id", "row", "col", *self.bands])
            if place != high * width:
                raise Malformed(folder, "the number of values is not width x height")

    def _indexed(self, store: fs.FileSystem, path: str, row: int, start: int) -> tuple[int, int]:
        """(byte, row) to begin at."""
        if not row or store.get_file_info(path).type != fs.FileType.File:
            return start, 0
        with store.open_input_stream(path) as f:
            offsets = np.frombuffer(f.read(), "<i8")
        k = min(row // EVERY, len(offsets) - 1)
        return int(offsets[k]), k * EVERY

    def _checked(self, store: fs.FileSystem, folder: str, scene: str) -> Iterator[pa.RecordBatch]:
        for band in self.bands:
            width = height = found = None
            detail = None
            try:
                with store.open_input_file(f"{folder}/{band}.json") as f:
                    head = header(f)
                    width, height = head.width, head.height
                    found = sum(map(len, values(f, head.start, 0, None)))
                if found != width * height:
                    detail = f"{width * height} values are expected, {found} were found"
            except FileNotFoundError:
                detail = "no such file"
            except ValueError as e:
                detail = str(e)
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((scene, pa.string()), (band, pa.string()), (width, pa.int64()), (height, pa.int64()), (found, pa.int64()), (detail, pa.string()))], ["scene_id", "band", "width", "height", "found", "detail"])


class PushedBandReader(BandReader):
    """Takes filters on ``scene_id`` from Spark, which asks only where the setting for it is on."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for one in filters:
            wanted = {one.value} if isinstance(one, EqualTo) else set(one.value) if isinstance(one, In) else None
            if wanted is None or one.attribute != ("scene_id",):
                yield one
            else:
                self.only = wanted if self.only is None else self.only & wanted


@dataclass
class Moves(WriterCommitMessage):
    names: list[tuple[str, str]]  # from, to


class _StagedWriter(DataSourceArrowWriter):
    """Files are written under names of their own and renamed when all tasks are done."""

    def __init__(self, options: dict[str, str]):
        self.root = options["path"].rstrip("/")
        self.options = options

    def commit(self, messages: list[Moves | None]) -> None:
        store, _ = fs.FileSystem.from_uri(self.root)
        for m in messages:
            for old, new in m.names if m else []:
                store.move(old, new)

    def abort(self, messages: list[Moves | None]) -> None:
        store, _ = fs.FileSystem.from_uri(self.root)
        for m in messages:
            for old, _ in m.names if m else []:
                store.delete_file(old)


class BandWriter(_StagedWriter):
    """Rows (scene_id, row, col, width, height, bands ...), in order within a scene, to a file a band; missing pixels are null."""

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Moves:
        store, root = fs.FileSystem.from_uri(self.root)
        bands, moves, open_scene = self.options["bands"].split(","), [], None
        for b in iterator:
            cols = {n: b.column(k) for k, n in enumerate(b.schema.names)}
            ids = cols["scene_id"].to_pylist()
            cuts = [0, *(k for k in range(1, len(ids)) if ids[k] != ids[k - 1]), len(ids)]
            for low, high in zip(cuts[:-1], cuts[1:], strict=True) if ids else []:
                if open_scene is None or open_scene.scene != ids[low]:
                    if open_scene:
                        moves += open_scene.close()
                    open_scene = _SceneFiles(store, f"{root}/{ids[low]}", ids[low], bands, cols["width"][low].as_py(), cols["height"][low].as_py())
                at = cols["row"].slice(low, high - low).to_numpy().astype(np.int64) * open_scene.width + cols["col"].slice(low, high - low).to_numpy()
                open_scene.add(at, [cols[n].slice(low, high - low).to_pylist() for n in bands])
        if open_scene:
            moves += open_scene.close()
        return Moves(moves)


class _SceneFiles:
    def __init__(self, store: fs.FileSystem, folder: str, scene: str, bands: list[str], width: int, height: int):
        store.create_dir(folder, recursive=True)
        self.scene, self.width, self.height, self.store, self.next = scene, width, height, store, 0
        self.names = [(f"{folder}/.{b}-{uuid.uuid4().hex}", f"{folder}/{b}") for b in bands]
        self.files = [store.open_output_stream(old) for old, _ in self.names]
        self.offsets: list[list[int]] = [[] for _ in bands]
        for f in self.files:
            f.write(json.dumps({"width": width, "height": height})[:-1].encode() + b', "data": [')

    def _put(self, k: int, first: int, texts: list[str]) -> None:
        """Values from place ``first`` on; offsets are noted where an indexed row begins."""
        every = self.width * EVERY
        f, done = self.files[k], 0
        while done < len(texts):
            place = first + done
            to = min(len(texts), done + every - place % every)
            if place:
                f.write(b",")
            if place % every == 0:
                self.offsets[k].append(f.tell())
            f.write(",".join(texts[done:to]).encode())
            done = to

    def _gap(self, to: int) -> None:
        while self.next < to:
            n = min(BATCH, to - self.next)
            for k in range(len(self.files)):
                self._put(k, self.next, ["null"] * n)
            self.next += n

    def add(self, at: np.ndarray, columns: list[list[float | None]]) -> None:
        cuts = [0, *(np.flatnonzero(np.diff(at) != 1) + 1).tolist(), len(at)]
        for low, high in zip(cuts[:-1], cuts[1:], strict=True):
            self._gap(int(at[low]))
            for k, column in enumerate(columns):
                self._put(k, self.next, ["null" if v is None or v != v else repr(v) for v in column[low:high]])
            self.next += high - low

    def close(self) -> list[tuple[str, str]]:
        self._gap(self.width * self.height)
        out = []
        for f, offsets, (old, new) in zip(self.files, self.offsets, self.names, strict=True):
            f.write(b"]}")
            f.close()
            with self.store.open_output_stream(f"{old}.rows") as index:
                index.write(np.array(offsets, "<i8").tobytes())
            out += [(f"{old}.rows", f"{new}.rows"), (old, f"{new}.json")]
        return out


class BandFiles(DataSource):
    """``format("scene_bands")`` with ``bands`` (names, by comma); ``check`` counts values instead, a row a file."""

    @classmethod
    def name(cls) -> str:
        return "scene_bands"

    def schema(self) -> str:
        if self.options.get("check", "false") == "true":
            return "scene_id string, band string, width long, height long, found long, detail string"
        return "scene_id string, row int, col int, " + ", ".join(f"`{b}` double" for b in self.options["bands"].split(","))

    def reader(self, schema) -> BandReader:
        kind = PushedBandReader if self.options.get("pushdown", "false") == "true" else BandReader
        return kind(dict(self.options))

    def writer(self, schema, overwrite: bool) -> BandWriter:
        return BandWriter(dict(self.options))


class DocumentWriter(_StagedWriter):
    """Rows (scene_id, name, body): one small file each."""

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Moves:
        store, root = fs.FileSystem.from_uri(self.root)
        moves = []
        for b in iterator:
            for row in b.to_pylist():
                folder = f"{root}/{row['scene_id']}"
                store.create_dir(folder, recursive=True)
                old = f"{folder}/.{row['name']}-{uuid.uuid4().hex}"
                with store.open_output_stream(old) as out:
                    out.write((row["body"] or "").encode())
                moves.append((old, f"{folder}/{row['name']}.json"))
        return Moves(moves)


class DocumentFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "scene_documents"

    def writer(self, schema, overwrite: bool) -> DocumentWriter:
        return DocumentWriter(dict(self.options))


class BandScenes(JsonScenes):
    """``JsonScenes`` whose pixels come from the data source; ``load`` opens one scene's folder only."""

    def _of_bands(self, check: bool, *names: str) -> DataFrame:
        self.spark.dataSource.register(BandFiles)
        reader = self.spark.read.format("scene_bands").option("path", self.root).option("bands", ",".join(names)).option("check", str(check).lower())
        reader = reader.option("pushdown", self.spark.conf.get(PUSHDOWN, "false"))
        return (reader if self.slug == "*" else reader.option("scene_id", self.slug)).load()

    def bands(self, *names: str) -> DataFrame:
        a = self._of_bands(False, *names)
        return a.select("scene_id", "row", "col", *[known(F.col(n)).alias(n) for n in names])

    def sizes(self, bands: tuple[str, ...] = ("nir", "red", "thermal", "qa")) -> DataFrame:
        """scene_id, band, width, height, found, detail (NULL if all is well): a row a file, none raised."""
        return self._of_bands(True, *bands)


def write_documents(rows: DataFrame, root: str) -> None:
    rows.sparkSession.dataSource.register(DocumentFiles)
    rows.select("scene_id", "name", "body").write.format("scene_documents").mode("append").option("path", root).save()


def write_bands(pixels: DataFrame, root: str, *bands: str) -> None:
    """``pixels``: scene_id, row, col, width, height and the bands. A file is one task's stream, as its values stand in one array."""
    pixels.sparkSession.dataSource.register(BandFiles)
    rows = pixels.select("scene_id", "row", "col", F.col("width").cast("int").alias("width"), F.col("height").cast("int").alias("height"), *[F.col(b).cast("double").alias(b) for b in bands])
    rows.repartition("scene_id").sortWithinPartitions("scene_id", "row", "col").write.format("scene_bands").mode("append").option("path", root).option("bands", ",".join(bands)).save()


def write_band_scenes(source: SceneSource, root: str, threshold_key: str = "ndviCoverThreshold") -> None:
    """A source's scenes as folders that ``JsonScenes`` and ``BandScenes`` read."""
    scenes = source.scenes()
    there = lambda name: F.col(name) if name in scenes.columns else F.lit(None).cast("string")
    plain = [there(new).alias(old or threshold_key) for old, new in META_NAMES if new in scenes.columns]
    grid = F.struct(F.col("fine_grid.origin_x").alias("originX"), F.col("fine_grid.origin_y").alias("originY"), F.col("fine_grid.pixel_w").alias("finePixelM"), F.col("thermal_grid.pixel_w").alias("thermalPixelM"), F.col("fine_grid.size").alias("fineSize"), F.col("thermal_grid.size").alias("thermalSize"))
    mtl = F.struct(F.col("gain").alias("radianceMult"), F.col("offset").alias("radianceAdd"), F.col("k1").alias("k1"), F.col("k2").alias("k2"), there("spacecraft").alias("spacecraft"), there("thermal_date").alias("acquisitionDate"), there("overpass").alias("localOverpassTime"), there("thermal_scene").alias("sceneId"))
    meta = scenes.select("scene_id", F.lit("meta").alias("name"), F.to_json(F.struct(F.col("scene_id").alias("slug"), *plain, grid.alias("grid"), mtl.alias("mtl"))).alias("body"))
    yard = source.yards().select("scene_id", F.lit("yard").alias("name"), F.to_json(F.struct(F.struct(F.col("outer").alias("coordinatesProjected")).alias("properties"))).alias("body"))
    write_documents(meta.unionByName(yard), root)
    sized = lambda grid: scenes.select("scene_id", F.col(f"{grid}.size").alias("width"), F.col(f"{grid}.size").alias("height"))
    write_bands(source.fine().join(sized("fine_grid"), "scene_id"), root, "nir", "red")
    write_bands(source.thermal().withColumnRenamed("dn", "thermal").join(sized("thermal_grid"), "scene_id"), root, "thermal", "qa")


def register(spark: SparkSession) -> None:
    spark.dataSource.register(BandFiles)
    spark.dataSource.register(DocumentFiles)
