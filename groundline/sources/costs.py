"""Cost models: JSON files of a region's priced items, class keys and planting classes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import Malformed

MODEL = (
    "region string, currency string, last_verified string,"
    " items array<struct<key:string,label:string,unit:string,low:double,high:double,source_name:string,source_url:string,source_retrieved:string>>,"
    " classCostKeys map<string,string>, perTreeItemKeys array<string>,"
    " plantingClasses array<struct<key:string,label:string,crownRadiusM:double,maturityYears:double,radiusSource:string,radiusStatus:string>>"
)


class JsonCosts:
    def __init__(self, spark: SparkSession, paths: str | list[str]):
        self.models = spark.read.schema(MODEL).option("multiLine", True).json(paths)

    def for_region(self, region: str) -> JsonCosts:
        own = self.models.where(F.col("region") == region)
        if own.isEmpty():
            there = ", ".join(sorted(r.region for r in self.models.select("region").distinct().collect()))
            raise Malformed(region, f"no cost model for this region; there are {there}")
        out = JsonCosts.__new__(JsonCosts)
        out.models = own
        return out

    def items(self) -> DataFrame:
        return self.models.select("region", F.posexplode("items").alias("position", "i")).select("region", "position", "i.*")

    def class_keys(self) -> DataFrame:
        return self.models.select("region", F.explode("classCostKeys").alias("class_key", "key"))

    def per_tree(self) -> DataFrame:
        return self.models.select("region", F.posexplode("perTreeItemKeys").alias("position", "key"))

    def classes(self) -> DataFrame:
        a = self.models.select("region", F.posexplode("plantingClasses").alias("position", "c"))
        return a.select("region", "position", F.col("c.key").alias("class_key"), F.col("c.label").alias("label"), F.col("c.crownRadiusM").alias("crown_radius"), F.col("c.maturityYears").alias("maturity"), F.col("c.radiusStatus").alias("radius_status"))
