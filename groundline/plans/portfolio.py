"""Queries over many scenes, dates, regions and sites, on the driver's tables (``portfolio_sql`` has the same in SQL)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import raster
from ..functions.unknown import fixed
from ..operators import composite, district, edits, planner, refusals, regression, spatial
from ..sources import chart
from ..sources.band_files import BandScenes, write_band_scenes, write_documents
from ..sources.scenes import ParquetScenes, write_scenes
from ..sources.shared import Store
from . import report
from .bindings import KEYS, OPTIONS, PLAN, REPORTED, SAID, FixedCosts, TableScenes, _candidates, _gated, _plan, _rounded, col, lines, lit, pixels, read
from .report import Analysis

ERRORS = ("slope", "slope_se", "moran_i", "moran_z", "hac_se", "spatial_se", "ci_lo", "ci_hi")


def spatial_error(spark: SparkSession, sf: str) -> DataFrame:
    """A lattice with a trend along its rows: residuals resemble their neighbours', and the interval widens."""
    y = 45 - 150 * col("value") + F.floor(col("row") / 8) * 0.7 + (col("row") * 31 + col("col") * 17) % 11 / 10
    a = spatial.error_model(pixels(spark, sf).select("scene_id", "row", "col", "value", y.alias("y")), col("value"), col("y"), KEYS, bandwidth=3)
    return a.select("scene_id", "n", *[fixed(col(c), 4).alias(c) for c in ERRORS])


def scene_error_model(spark: SparkSession, sf: str) -> DataFrame:
    """The error model of each scene's own fit of temperature to cover."""
    return Analysis(TableScenes(spark, sf)).error_model().select("scene_id", "n", *[fixed(col(c), 4).alias(c) for c in ERRORS])


def _dated(spark: SparkSession, sf: str) -> DataFrame:
    """Monthly scenes of each site: a pixel's bands and heat are means over the lines of a month."""
    hundred = lambda c: F.sum(F.round(col(c) * 100).cast("bigint")) / F.count("*") / lit(100)
    a = lines(spark, sf).groupBy("scene_id", F.trunc("l_shipdate", "month").alias("date"), (col("l_orderkey") % 20).cast("int").alias("row"), (col("l_partkey") % 20).cast("int").alias("col"))
    return a.agg(hundred("l_discount").alias("nir"), hundred("l_tax").alias("red"), (F.sum(F.round("l_quantity").cast("bigint")) / F.count("*")).alias("heat"), F.count("*").alias("n"))


def _composite(spark: SparkSession, sf: str) -> DataFrame:
    values = {"ndvi": raster.ndvi(col("nir"), col("red")), "heat": col("heat")}
    return composite.composite(_dated(spark, sf), values, col("n") % 4 != 0, ["scene_id", "row", "col"], least=3)


def composite_pixels(spark: SparkSession, sf: str) -> DataFrame:
    """The median of every pixel over the months on which it was clear."""
    return _composite(spark, sf).select("scene_id", "row", "col", *[fixed(col(c)).alias(c) for c in ("ndvi", "heat")], "n_dates", "first_date", "last_date")


def composite_season(spark: SparkSession, sf: str) -> DataFrame:
    """Summers only, by site."""
    summer = composite.in_season(_dated(spark, sf), (6, 7, 8))
    a = composite.composite(summer, {"heat": col("heat")}, F.lit(True), ["scene_id"])
    return a.select("scene_id", fixed(col("heat")).alias("heat"), "n_dates", "first_date", "last_date")


def composite_fit(spark: SparkSession, sf: str) -> DataFrame:
    """The fit of heat to cover, read from the composite."""
    a = regression.fit(_composite(spark, sf), col("ndvi"), col("heat"), KEYS)
    return a.select("scene_id", "n", *[fixed(col(c)).alias(c) for c in ("slope", "intercept", "r2", "slope_se")])


def district_ranking(spark: SparkSession, sf: str) -> DataFrame:
    """Sites by cooling per dollar; withheld ones keep their row."""
    low = ((col("p_partkey") % 10 + 1) * 100).cast("double")
    a = _gated(spark, sf).withColumns({"total_low": low, "total_high": low * 1.5, "has_unsourced": col("p_partkey") % 13 == 0})
    return district.ranking(a).select("p_partkey", "standing", "place", fixed(col("score")).alias("score"))


class TwoRegions(FixedCosts):
    """``FixedCosts`` of region R0, and a region R1 with smaller crowns, other prices and an uncited item."""

    def __init__(self, spark: SparkSession):
        super().__init__(spark, True)
        self.models = self.few([("R0",), ("R1",)], "region string")

    def _both(self, own: DataFrame, other: list[tuple]) -> DataFrame:
        return own.unionByName(self.few(other, ", ".join(f"{n} {t}" for n, t in own.dtypes)))

    def items(self) -> DataFrame:
        prices = (("tree_large", 600.0, 800.0), ("tree_medium", 450.0, 640.0), ("watering", 10.0, 18.0))
        return self._both(super().items(), [("R1", n, k, k, low, high, "list", "https://prices.example/r1" if k != "watering" else "", "2026-08-07") for n, (k, low, high) in enumerate(prices)])

    def class_keys(self) -> DataFrame:
        return self._both(super().class_keys(), [("R1", "large_shade", "tree_large"), ("R1", "medium_shade", "tree_medium")])

    def per_tree(self) -> DataFrame:
        return self._both(super().per_tree(), [("R1", 0, "watering")])

    def classes(self) -> DataFrame:
        return self._both(super().classes(), [("R1", "large_shade", 6.0, 12.0), ("R1", "medium_shade", 5.5, 16.0)])


def region_reports(spark: SparkSession, sf: str) -> DataFrame:
    """A given plan reported with the prices and crowns of two regions: a row for each scene and region."""
    analysis = Analysis(TableScenes(spark, sf))
    both = analysis.scenes.select("scene_id", F.explode(F.array(F.lit("R0"), F.lit("R1"))).alias("region"))
    a = report.build_report(analysis, _plan(spark, sf), TwoRegions(spark), "2026-08-07", both)
    return _rounded(a.withColumn("limitations", F.array_join("limitations", "|")), REPORTED, ("region", *SAID))


def region_report(spark: SparkSession, sf: str) -> DataFrame:
    """The same for one region, chosen by its name."""
    a = report.build_report(Analysis(TableScenes(spark, sf)), _plan(spark, sf), TwoRegions(spark), "2026-08-07", "R1")
    return _rounded(a.withColumn("limitations", F.array_join("limitations", "|")), REPORTED, ("region", *SAID))


def scene_files(spark: SparkSession, sf: str) -> DataFrame:
    """Scenes written as folders of band files and read back by ranges of rows; pixels without a line are unknown."""
    root = Store(spark, "scene-files").root
    write_band_scenes(TableScenes(spark, sf), root)
    a = BandScenes(spark, root).fine()
    return a.select("scene_id", "row", "col", fixed(col("nir")).alias("nir"), fixed(col("red")).alias("red"))


def scene_load(spark: SparkSession, sf: str) -> DataFrame:
    """One scene of the folders by its key, with its metadata and thermal pixels; no other folder is opened for pixels."""
    root = Store(spark, "scene-files").root
    write_band_scenes(TableScenes(spark, sf), root)
    one = BandScenes(spark, root).load("AF")
    heat = one.thermal().groupBy("scene_id").agg(F.count("dn").alias("pixels"), F.sum("dn").alias("dn"), F.count_if(raster.usable(col("qa"))).alias("usable"))
    grid = col("thermal_grid")
    return one.scenes().join(heat, "scene_id").join(one.yards(), "scene_id").select("scene_id", "name", "cover_threshold", "k1", "overpass", grid["size"].alias("size"), grid["pixel_w"].alias("pixel_w"), "pixels", "dn", "usable", F.size("outer").alias("vertices"))


class Recalibrated(TableScenes):
    """Two of the scenes, their thermal numbers 100 higher."""

    def __init__(self, spark: SparkSession, sf: str):
        super().__init__(spark, sf)
        self.ids = self.ids.where(col("scene_id").isin("AF", "RF"))

    def fine(self) -> DataFrame:
        return super().fine().join(self.ids, "scene_id", "left_semi")

    def thermal(self) -> DataFrame:
        return super().thermal().join(self.ids, "scene_id", "left_semi").withColumn("dn", col("dn") + 100)


def scene_store(spark: SparkSession, sf: str) -> DataFrame:
    """The store written, written again, and two scenes of it replaced: every pixel is there once, the new ones replaced."""
    root = Store(spark, "scene-store").root
    whole = TableScenes(spark, sf)
    write_scenes(whole, root)
    write_scenes(whole, root)
    write_scenes(Recalibrated(spark, sf), root)
    return ParquetScenes(spark, root).thermal().groupBy("scene_id").agg(F.count("*").alias("pixels"), F.sum("dn").alias("dn"), F.min("row").alias("first_row"), F.max("row").alias("last_row"))


def scene_store_load(spark: SparkSession, sf: str) -> DataFrame:
    """One scene of the store; the filter prunes all other folders."""
    root = Store(spark, "scene-store").root
    write_scenes(TableScenes(spark, sf), root)
    a = ParquetScenes(spark, root).load("RF").fine()
    return a.select("scene_id", "row", "col", fixed(col("nir")).alias("nir"), fixed(col("red")).alias("red"))


def _yard_files(spark: SparkSession, sf: str) -> DataFrame:
    """A yard file a supplier: rings of one to five vertices, some cut off."""
    k = col("s_suppkey")
    ring = F.transform(F.sequence(F.lit(1), (k % 5 + 1).cast("int")), lambda i: F.concat(F.lit("["), i.cast("string"), F.lit(".0, 2.0]")))
    body = F.concat(F.lit('{"properties": {"coordinatesProjected": ['), F.array_join(ring, ", "), F.lit("]}"), F.when(k % 7 == 0, "").otherwise("}"))
    return read(spark, sf, "supplier").select(F.concat(F.lit("s"), k.cast("string"), F.lit("/yard.json")).alias("path"), body.alias("text"))


def _band_files(spark: SparkSession, sf: str) -> DataFrame:
    """A band file a supplier, with more or fewer values than its size says, or none at all."""
    k = col("s_suppkey")
    numbers = F.array_join(F.transform(F.sequence(F.lit(1), (k % 6 + 1).cast("int")), lambda i: i.cast("string")), ", ")
    body = F.concat(F.lit('{"width": 2, "height": '), (k % 3 + 1).cast("string"), F.when(k % 11 == 0, "").otherwise(F.concat(F.lit(', "data": ['), numbers, F.lit("]"))), F.lit("}"))
    return read(spark, sf, "supplier").select(F.concat(F.lit("s"), k.cast("string")).alias("scene_id"), F.lit("nir").alias("name"), body.alias("body"))


def refused_sources(spark: SparkSession, sf: str) -> DataFrame:
    """All that cannot be used, of yards, bands, regions and measured sites, in one list with code and remedy."""
    root = Store(spark, "refused").root
    write_documents(_band_files(spark, sf), root)
    key = col("p_partkey")
    measured = read(spark, sf, "part").select(F.concat(F.lit("p"), key.cast("string")).alias("scene_id"), (key % 17).alias("yard_cells"), F.when(key % 19 != 0, key % 21 / lit(20)).alias("coverage"), F.when(key % 23 != 0, key % 101 / lit(100)).alias("r2"))
    wanted = read(spark, sf, "nation").select(F.concat(F.lit("R"), col("n_regionkey").cast("string")).alias("region"))
    found = refusals.documents(_yard_files(spark, sf), "yard").unionByName(refusals.bands(BandScenes(spark, root).sizes(("nir",))))
    return found.unionByName(refusals.regions(wanted, TwoRegions(spark).models)).unionByName(refusals.outcomes(measured))


def accepted_scenes(spark: SparkSession, sf: str) -> DataFrame:
    """What is left of the suppliers' folders after the refusals of their yards and bands."""
    root = Store(spark, "refused").root
    write_documents(_band_files(spark, sf), root)
    found = refusals.documents(_yard_files(spark, sf), "yard").unionByName(refusals.bands(BandScenes(spark, root).sizes(("nir",))))
    return refusals.accepted(_band_files(spark, sf), found).select("scene_id")


def _edits(spark: SparkSession, sf: str) -> DataFrame:
    """The events as edits of 21 plans; every third event belongs to plan 0."""
    k = col("event_id")
    plan = F.when(k % 3 == 0, 0).otherwise(col("user_id") % 20 + 1).cast("int")
    action = F.when(k % 97 == 0, edits.CLEAR).when(k % 89 == 0, edits.RESET).when(k * 7 % 11 < 6, edits.PLACE).otherwise(edits.REMOVE)
    return read(spark, sf, "events").select(plan.alias("plan_id"), "ts", "event_id", action.alias("action"), col("value").alias("x"), (k % 400 - 400).cast("double").alias("y"))


def _suggestions(spark: SparkSession, sf: str) -> DataFrame:
    """The first trees of the fixed plan for each of the plans 0 to 24."""
    trees = F.array(*[F.struct(F.lit(n).alias("ordinal"), F.lit(f"t{n + 1:02d}").alias("id"), lit(x).alias("x"), lit(y).alias("y"), F.lit(c).alias("class_key")) for n, (x, y, c) in enumerate(PLAN)])
    a = read(spark, sf, "nation").select(col("n_nationkey").cast("int").alias("plan_id"), F.explode(trees).alias("t")).select("plan_id", "t.*")
    return a.where(col("ordinal") < col("plan_id") % 5 + 2)


def suggest_rounds(spark: SparkSession, sf: str) -> DataFrame:
    """The plans of ``suggest_greedy``, found by rounds over a grid of conflicts."""
    return planner.place_by_rounds(_candidates(spark, sf), OPTIONS, KEYS, Store(spark, "rounds"))


def fit_plot(spark: SparkSession, sf: str) -> DataFrame:
    """The points of each scene's fit, counted on the cells of its plot."""
    a = chart.binned_points(lines(spark, sf), col("l_quantity"), col("l_extendedprice"), KEYS)
    return a.select("scene_id", "i", "j", "n", *[fixed(col(c), 4).alias(c) for c in ("x0", "x1", "y0", "y1")])


def heat_map(spark: SparkSession, sf: str) -> DataFrame:
    """What the temperature map of each scene shows."""
    a = chart.heat_cells(Analysis(TableScenes(spark, sf)).thermal, KEYS, 5)
    return a.select("scene_id", "i", "j", fixed(col("lst"), 4).alias("lst"), "colour", "in_yard")


CLASSES = ("large_shade", "medium_shade")


def edit_log(spark: SparkSession, sf: str) -> DataFrame:
    """Plans after all their edits."""
    return edits.after_edits(_edits(spark, sf), _suggestions(spark, sf), ["plan_id"], ["ts", "event_id"], CLASSES, Store(spark, "edits"))


def edited_reports(spark: SparkSession, sf: str) -> DataFrame:
    """Reports of those scenes whose plan was edited, after the edits; other scenes are not reported anew."""
    log = _edits(spark, sf).where("plan_id between 1 and 3").withColumn("scene_id", F.get(F.array(F.lit("AF"), F.lit("NO"), F.lit("RF")), col("plan_id") - 1))
    given = F.array(*[F.struct(F.lit(n).alias("ordinal"), F.lit(f"t{n + 1:02d}").alias("id"), lit(x).alias("x"), lit(y).alias("y"), F.lit(c).alias("class_key")) for n, (x, y, c) in enumerate(PLAN)])
    source = TableScenes(spark, sf)
    suggested = source.ids.select("scene_id", F.explode(given).alias("t")).select("scene_id", "t.*")
    analysis = Analysis(source)
    trees = edits.after_edits(log, suggested, ["scene_id"], ["ts", "event_id"], CLASSES, analysis.store)
    changed = analysis.store.save(log.select("scene_id").distinct().withColumn("region", F.lit("R0")), "changed")
    a = report.build_report(analysis, analysis.store.save(trees, "edited"), FixedCosts(spark, True), "2026-08-07", changed)
    return _rounded(a.withColumn("limitations", F.array_join("limitations", "|")), REPORTED, SAID)


QUERIES = {
    f.__name__: f
    for f in (
        spatial_error, scene_error_model, composite_pixels, composite_season, composite_fit, district_ranking, region_reports, region_report,
        scene_files, scene_load, scene_store, scene_store_load, refused_sources, accepted_scenes, edit_log, edited_reports, suggest_rounds, fit_plot, heat_map,
    )
}
