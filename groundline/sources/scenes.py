"""Scenes on disk: one folder a scene with meta.json, yard.json and one JSON file a band.

Files are read by Spark from any store, with explicit schemas. A scene's id is its folder's
name. Unknown numbers become NULL here, so that nothing later has to think of NaN.
"""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.unknown import known
from .errors import Malformed

BAND = "width int, height int, data array<double>"
META = (
    "slug string, name string, city string, state string, synthetic boolean, provenance string, yardAreaM2 double, parcelAreaM2 double,"
    " {threshold} double, thresholdRationale string, opticalSceneId string, opticalDate string,"
    " grid struct<epsg:int,originX:double,originY:double,finePixelM:double,thermalPixelM:double,fineSize:int,thermalSize:int>,"
    " mtl struct<radianceMult:double,radianceAdd:double,k1:double,k2:double,spacecraft:string,acquisitionDate:string,localOverpassTime:string,sceneId:string>"
)
#: Names in a scene's metadata and here; that of the threshold is a source's own.
META_NAMES = (
    ("name", "name"), ("city", "city"), ("state", "state"), ("synthetic", "synthetic"), ("provenance", "provenance"), ("yardAreaM2", "yard_area"), (None, "cover_threshold"),
    ("thresholdRationale", "threshold_rationale"), ("opticalSceneId", "optical_scene"), ("opticalDate", "optical_date"),
)
YARD = "properties struct<name:string,epsgProjected:int,coordinatesProjected:array<array<double>>>"


class SceneSource(Protocol):
    """What the plans need of a source: scene metadata, yards, and the two pixel tables."""

    def scenes(self) -> DataFrame: ...
    def yards(self) -> DataFrame: ...
    def fine(self) -> DataFrame: ...
    def thermal(self) -> DataFrame: ...


class JsonScenes:
    """``threshold_key`` is the name that the metadata give to the index's threshold of cover."""

    def __init__(self, spark: SparkSession, root: str, slug: str = "*", threshold_key: str = "ndviCoverThreshold"):
        self.spark, self.root, self.slug, self.threshold_key = spark, root.rstrip("/"), slug, threshold_key

    def _read(self, name: str, schema: str) -> DataFrame:
        raw = self.spark.read.schema(schema).option("multiLine", True).json(f"{self.root}/{self.slug}/{name}.json")
        return raw.withColumn("scene_id", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1))

    def scenes(self) -> DataFrame:
        """One row a scene."""
        a = self._read("meta", META.replace("{threshold}", f"`{self.threshold_key}`"))
        return a.select(
            "scene_id",
            *[F.col(old or self.threshold_key).alias(new) for old, new in META_NAMES],
            F.struct(F.col("grid.originX").alias("origin_x"), F.col("grid.originY").alias("origin_y"), F.col("grid.finePixelM").alias("pixel_w"), F.col("grid.finePixelM").alias("pixel_h"), F.col("grid.fineSize").alias("size"), F.col("grid.epsg").alias("epsg")).alias("fine_grid"),
            F.struct(F.col("grid.originX").alias("origin_x"), F.col("grid.originY").alias("origin_y"), F.col("grid.thermalPixelM").alias("pixel_w"), F.col("grid.thermalPixelM").alias("pixel_h"), F.col("grid.thermalSize").alias("size"), F.col("grid.epsg").alias("epsg")).alias("thermal_grid"),
            F.col("mtl.radianceMult").alias("gain"),
            F.col("mtl.radianceAdd").alias("offset"),
            F.col("mtl.k1").alias("k1"),
            F.col("mtl.k2").alias("k2"),
            F.col("mtl.spacecraft").alias("spacecraft"),
            F.col("mtl.acquisitionDate").alias("thermal_date"),
            F.col("mtl.localOverpassTime").alias("overpass"),
            F.col("mtl.sceneId").alias("thermal_scene"),
        )

    def load(self, slug: str) -> JsonScenes:
        """The source narrowed to one scene; an unknown one is refused at once."""
        one = type(self)(self.spark, self.root, slug, self.threshold_key)
        if self.scenes().where(F.col("scene_id") == slug).isEmpty():
            raise Malformed(f"{self.root}/{slug}", "no such scene")
        return one

    def yards(self) -> DataFrame:
        """scene_id and the yard's outer ring in projected metres."""
        return self._read("yard", YARD).select("scene_id", F.col("properties.coordinatesProjected").alias("outer"))

    def bands(self, *names: str) -> DataFrame:
        """scene_id, row, col and each band's value under its own name; the files are joined, one row a scene, not the pixels."""
        a = self._read(names[0], BAND).select("scene_id", "width", F.col("data").alias(names[0]))
        for name in names[1:]:
            a = a.join(self._read(name, BAND).select("scene_id", F.col("data").alias(name)), "scene_id")
        a = a.select("scene_id", "width", F.posexplode(F.arrays_zip(*names)).alias("i", "v"))
        return a.select("scene_id", F.floor(F.col("i") / F.col("width")).cast("int").alias("row"), (F.col("i") % F.col("width")).alias("col"), *[known(F.col("v")[n]).alias(n) for n in names])

    def fine(self) -> DataFrame:
        return self.bands("nir", "red")

    def thermal(self) -> DataFrame:
        return self.bands("thermal", "qa").withColumnRenamed("thermal", "dn")

    def check(self, bands: tuple[str, ...] = ("nir", "red", "thermal", "qa")) -> None:
        """Raises on the first file whose array or ring has the wrong length."""
        for name in bands:
            bad = self._read(name, BAND).where("data is null or size(data) <> width * height").select("scene_id").first()
            if bad:
                raise Malformed(f"{bad.scene_id}/{name}.json", "the number of values is not width x height")
        bad = self.yards().where("outer is null or size(outer) < 3").select("scene_id").first()
        if bad:
            raise Malformed(f"{bad.scene_id}/yard.json", "a ring needs three vertices")


class ParquetScenes:
    """The same four tables as written by ``write_scenes``, each in folders by scene; a filter on scene_id prunes them."""

    def __init__(self, spark: SparkSession, root: str, slug: str | None = None):
        self.spark, self.root, self.slug = spark, root.rstrip("/"), slug

    def _read(self, name: str) -> DataFrame:
        a = self.spark.read.option("basePath", f"{self.root}/{name}").parquet(f"{self.root}/{name}").withColumn("scene_id", F.col("scene_id").cast("string"))
        return a if self.slug is None else a.where(F.col("scene_id") == self.slug)

    def load(self, slug: str) -> ParquetScenes:
        """The source narrowed to one scene; an unknown one is refused at once."""
        one = ParquetScenes(self.spark, self.root, slug)
        if one.scenes().isEmpty():
            raise Malformed(f"{self.root}/{slug}", "no such scene")
        return one

    def scenes(self) -> DataFrame:
        return self._read("scenes")

    def yards(self) -> DataFrame:
        return self._read("yards")

    def fine(self) -> DataFrame:
        return self._read("fine")

    def thermal(self) -> DataFrame:
        return self._read("thermal")


def name_order(name: str = "name") -> Column:
    """By name as people sort it: case and accents come second."""
    return F.collate(F.col(name), "UNICODE")


def in_name_order(scenes: DataFrame, name: str = "name") -> DataFrame:
    return scenes.orderBy(name_order(name))


#: Rows of a scene that are written together.
STRIPE_ROWS = 512


def write_scenes(source: SceneSource, root: str) -> None:
    """Parquet in folders by scene. A rerun replaces the folders of its own scenes, when all their
    files are written, and leaves others as they are. A large scene is written by several tasks."""
    for name in ("scenes", "yards", "fine", "thermal"):
        a = getattr(source, name)()
        a = a.repartition("scene_id", F.floor(F.col("row") / STRIPE_ROWS)).sortWithinPartitions("scene_id", "row", "col") if "row" in a.columns else a
        a.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("scene_id").parquet(f"{root}/{name}")


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object a row, fields in a fixed order."""
    df.select(*sorted(df.columns)).write.mode("overwrite").json(path)
