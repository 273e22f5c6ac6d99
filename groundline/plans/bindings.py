"""Operators applied to the driver's tables. A scene is a return flag with a line status; pixels,
yards, trees and cost items are derived from keys by arithmetic (see ``oracles`` for the same in SQL)."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import crowns, geometry, raster
from ..functions.order import placed
from ..functions.unknown import fixed
from ..operators import costs, gates, masks, planner, regression, resample, stats, unions
from ..operators.lattice import GridDef, every_cell, sample
from ..sources.scenes import in_name_order, name_order
from ..sources.shared import Store
from . import report
from .report import Analysis

FINE = GridDef(40, 40, 0.0, 400.0, 10.0, 10.0, 32612)
COARSE = GridDef(10, 10, 0.0, 400.0, 40.0, 40.0, 32612)
SHIFTED = GridDef(12, 12, -15.0, 395.0, 37.0, 37.0, 32612)
RING = ((60.0, 60.0), (330.0, 75.0), (310.0, 220.0), (200.0, 180.0), (180.0, 340.0), (70.0, 300.0))
HOLE = ((100.0, 100.0), (150.0, 100.0), (150.0, 150.0), (100.0, 150.0))
# Thermal band constants.
GAIN, OFFSET, K1, K2 = 3.8e-4, 0.1, 799.0284, 1329.2405
KEYS = ["scene_id"]
SCENES = ("AF", "NF", "NO", "RF")


def col(name: str) -> Column:
    return F.col(name)


def lit(x: float) -> Column:
    return F.lit(float(x))


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def lines(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "lineitem").withColumn("scene_id", F.concat("l_returnflag", "l_linestatus"))


def ring(points: tuple[tuple[float, float], ...]) -> Column:
    return F.array(*[F.array(lit(x), lit(y)) for x, y in points])


def yards(spark: SparkSession, sf: str) -> DataFrame:
    return lines(spark, sf).select("scene_id").distinct().withColumn("outer", ring(RING))


def ndvi_of_line() -> Column:
    return raster.ndvi(col("l_discount"), col("l_tax"))


def pixels(spark: SparkSession, sf: str) -> DataFrame:
    """scene_id, row, col, value, ndvi: means over the lines of a cell, from exact integer sums."""
    hundred = lambda c: F.sum(F.round(col(c) * 100).cast("bigint"))
    a = lines(spark, sf).groupBy("scene_id", (col("l_orderkey") % 40).cast("int").alias("row"), (col("l_partkey") % 40).cast("int").alias("col"))
    a = a.agg((hundred("l_discount") / F.count("*") / lit(100)).alias("value"), (hundred("l_tax") / F.count("*") / lit(100)).alias("red"))
    return a.select("scene_id", "row", "col", "value", raster.ndvi(col("value"), col("red")).alias("ndvi"))


def heat(spark: SparkSession, sf: str) -> DataFrame:
    a = lines(spark, sf).groupBy("scene_id", (col("l_orderkey") % 10).cast("int").alias("row"), (col("l_partkey") % 10).cast("int").alias("col"))
    return a.agg((F.sum(F.round("l_quantity").cast("bigint")) / F.count("*")).alias("lst"))


def ndvi_pixels(spark: SparkSession, sf: str) -> DataFrame:
    return lines(spark, sf).select("scene_id", "l_orderkey", "l_partkey", "l_linenumber", fixed(ndvi_of_line()).alias("ndvi"))


def bands_for_ndvi(spark: SparkSession, sf: str) -> DataFrame:
    nir, red = raster.bands_for_ndvi(ndvi_of_line(), col("l_quantity") / 50)
    return lines(spark, sf).select("scene_id", "l_orderkey", "l_partkey", "l_linenumber", fixed(nir).alias("nir"), fixed(red).alias("red"))


def cover_fraction(spark: SparkSession, sf: str) -> DataFrame:
    v = ndvi_of_line()
    a = lines(spark, sf).groupBy("scene_id")
    return a.agg(stats.cover_fraction(raster.is_cover(v, 0.2), v.isNotNull()).alias("fraction"), stats.count_mask(v.isNotNull()).alias("known"))


def masked_summary(spark: SparkSession, sf: str) -> DataFrame:
    s = stats.summary(ndvi_of_line(), col("l_linenumber") <= 5)
    return lines(spark, sf).groupBy("scene_id").agg(*[(x if n == "n" else fixed(x)).alias(n) for n, x in s.items()])


def percentiles(spark: SparkSession, sf: str) -> DataFrame:
    a = stats.percentiles(lines(spark, sf), ndvi_of_line(), KEYS, [10, 50, 90])
    return a.select("scene_id", *[fixed(col(c)).alias(c) for c in ("p10", "p50", "p90")])


def _dn() -> Column:
    return 25000 + col("l_extendedprice") / 10


def _constants() -> list[Column]:
    return [lit(GAIN), lit(OFFSET), lit(K1), lit(K2)]


def lst_chain(spark: SparkSession, sf: str) -> DataFrame:
    a = raster.with_surface_temperature(lines(spark, sf).withColumn("v", ndvi_of_line()), "lst", _dn(), col("v"), *_constants())
    return a.select("scene_id", "l_orderkey", "l_partkey", "l_linenumber", fixed(col("lst"), 4).alias("lst"))


def lst_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    a = raster.with_thermal_number(lines(spark, sf).withColumn("v", ndvi_of_line()), "dn", col("l_quantity"), col("v"), *_constants())
    a = raster.with_surface_temperature(a, "back", col("dn"), col("v"), *_constants())
    return a.select("scene_id", "l_orderkey", "l_partkey", "l_linenumber", fixed(col("dn"), 3).alias("dn"), fixed(col("back"), 4).alias("celsius"))


def _usable() -> Column:
    return raster.usable(F.expr("shiftleft(cast(1 as bigint), l_linenumber)"))


def qa_mask(spark: SparkSession, sf: str) -> DataFrame:
    return lines(spark, sf).groupBy("scene_id").agg(stats.count_mask(_usable()).alias("usable"), F.count("*").alias("pixels"))


def coverage_gate(spark: SparkSession, sf: str) -> DataFrame:
    yard = col("l_quantity") > 10
    c = stats.coverage(_usable() | (col("l_linenumber") > 1), yard)
    a = lines(spark, sf).groupBy("scene_id").agg(stats.coverage(_usable(), yard).alias("coverage"), c.alias("clear"), stats.coverage(_usable(), F.lit(False)).alias("nothing"))
    return a.select("scene_id", "coverage", "clear", "nothing", stats.sufficient(col("coverage")).alias("enough"), stats.sufficient(col("clear")).alias("clear_enough"))


def settled(x: Column) -> Column:
    """Nine digits of a sum of doubles; twelve come first, so that a tie is not left to the order of adding."""
    return fixed(fixed(x, 12), 9)


def _resampled(spark: SparkSession, sf: str, to: GridDef) -> DataFrame:
    return resample.resample(pixels(spark, sf), FINE, to).withColumn("value", settled(col("value")))


def resample_aligned(spark: SparkSession, sf: str) -> DataFrame:
    return _resampled(spark, sf, COARSE)


def resample_offset(spark: SparkSession, sf: str) -> DataFrame:
    return _resampled(spark, sf, SHIFTED)


def coverage_to_grid(spark: SparkSession, sf: str) -> DataFrame:
    a = pixels(spark, sf).withColumn("mask", raster.is_cover(col("ndvi"), 0.2))
    return resample.coverage(a, FINE, COARSE).withColumn("value", settled(col("value")))


def pip_mask(spark: SparkSession, sf: str) -> DataFrame:
    a = masks.rasterise(pixels(spark, sf), yards(spark, sf), FINE)
    return a.select("scene_id", "row", "col", "in_yard")


def pip_hole(spark: SparkSession, sf: str) -> DataFrame:
    a = masks.rasterise(pixels(spark, sf), yards(spark, sf).withColumn("holes", F.array(ring(HOLE))), FINE)
    return a.groupBy("scene_id").agg(stats.count_mask(col("in_yard")).alias("inside"), F.count("*").alias("pixels"))


def cell_overlap(spark: SparkSession, sf: str) -> DataFrame:
    return masks.cell_shares(heat(spark, sf), yards(spark, sf), COARSE).select("scene_id", "row", "col", "yard_share")


def yard_cells(spark: SparkSession, sf: str) -> DataFrame:
    a = masks.yard_cells(heat(spark, sf), yards(spark, sf), COARSE)
    return a.groupBy("scene_id").agg(stats.count_mask(col("in_yard")).alias("cells"), fixed(stats.masked_mean(col("lst"), col("in_yard"))).alias("lst"))


def sample_at(spark: SparkSession, sf: str) -> DataFrame:
    a = read(spark, sf, "supplier").select("s_suppkey", F.get(F.array(*map(F.lit, SCENES)), (col("s_suppkey") % 4).cast("int")).alias("scene_id"), (col("s_suppkey") * 37 % 450 - 20).cast("double").alias("x"), (col("s_suppkey") * 61 % 450 - 20).cast("double").alias("y"))
    return sample(a, pixels(spark, sf), FINE, "ndvi", keys=("scene_id",)).select("s_suppkey", "scene_id", "row", "col", fixed(col("ndvi")).alias("ndvi"))


def _fit_rows(spark: SparkSession, sf: str) -> DataFrame:
    k = F.when(col("l_returnflag") == "A", 40.0).when(col("l_returnflag") == "N", 130.0).otherwise(300.0)
    return lines(spark, sf).withColumn("y", 45 - 0.2 * col("l_quantity") + k * col("l_discount"))


def _fits(spark: SparkSession, sf: str) -> DataFrame:
    return regression.fit(_fit_rows(spark, sf), col("l_quantity"), col("y"), KEYS)


def ols_fit(spark: SparkSession, sf: str) -> DataFrame:
    return _fits(spark, sf).select("scene_id", "n", *[fixed(col(c)).alias(c) for c in ("slope", "intercept", "r2", "slope_se", "ci_lo", "ci_hi")])


def ols_degenerate(spark: SparkSession, sf: str) -> DataFrame:
    """Four cases without a proper fit, all from one scan."""
    cases = (
        ("constant x", lit(3), col("l_quantity"), F.lit(True)),
        ("constant y", col("l_quantity"), lit(7), F.lit(True)),
        ("two pairs", col("l_quantity"), col("l_tax"), F.lit(False)),
        ("unknown pairs", F.when(col("l_linenumber") < 3, col("l_quantity")), F.when(col("l_linenumber") > 1, col("l_discount")), F.lit(True)),
    )
    each = F.array(*[F.struct(F.lit(name).alias("case"), x.alias("x"), y.alias("y"), where.alias("used")) for name, x, y, where in cases])
    a = lines(spark, sf).select("scene_id", F.explode(each).alias("c")).select("scene_id", "c.*")
    fitted = regression.fit(a, col("x"), col("y"), ["scene_id", "case"], col("used"))
    return fitted.select("scene_id", "case", "n", *[fixed(col(c)).alias(c) for c in ("slope", "r2")])


def t_critical(spark: SparkSession, sf: str) -> DataFrame:
    """Critical values for the numbers of lines by their place in the order, and for one and two degrees of freedom."""
    n = read(spark, sf, "lineitem").groupBy("l_linenumber").agg(F.count("*").alias("n"))
    a = n.select((col("n") - 2).alias("df")).union(n.select(col("n") % 2 + 1)).distinct()
    return a.select("df", fixed(regression.t_critical(col("df").cast("double")), 4).alias("t"))


def regression_band(spark: SparkSession, sf: str) -> DataFrame:
    a = regression.band(_fit_rows(spark, sf), _fits(spark, sf), "l_quantity", KEYS)
    return a.select("scene_id", "step", *[fixed(col(c), 4).alias(c) for c in ("x", "y", "y_lo", "y_hi")])


def quantile_cutoff(spark: SparkSession, sf: str) -> DataFrame:
    return regression.quantile_cutoff(lines(spark, sf), "l_extendedprice", 0.3, KEYS)


def _gate_rows(spark: SparkSession, sf: str) -> DataFrame:
    key = col("p_partkey")
    return read(spark, sf, "part").select(
        "p_partkey",
        (-col("p_size") / lit(5)).alias("slope"),
        (key % 101 / lit(100)).alias("r2"),
        (-col("p_size") / lit(5) - 1.5).alias("ci_lo"),
        (-col("p_size") / lit(5) + 1.5).alias("ci_hi"),
        F.when(key % 11 != 0, key % 7 / lit(20)).alias("delta"),
        (key % 21 / lit(20)).alias("coverage"),
    )


def _gated(spark: SparkSession, sf: str) -> DataFrame:
    return _gate_rows(spark, sf).withColumns(gates.prediction(*[col(c) for c in ("slope", "r2", "ci_lo", "ci_hi", "delta", "coverage")]))


def predict_gate(spark: SparkSession, sf: str) -> DataFrame:
    return _gated(spark, sf).select("p_partkey", "kind", "reason", *[fixed(col(c)).alias(c) for c in ("delta_c", "delta_lo", "delta_hi")])


def explain_gate(spark: SparkSession, sf: str) -> DataFrame:
    return _gated(spark, sf).select("p_partkey", gates.explanation(col("kind"), col("reason"), col("r2"), col("coverage")).alias("explanation"), gates.measured(col("delta"), 2).alias("delta"))


def decision_trace(spark: SparkSession, sf: str) -> DataFrame:
    a = _gate_rows(spark, sf).select("p_partkey", F.explode(gates.decision_trace(col("coverage"), col("r2"), F.lit(3), col("p_partkey") % 4)).alias("g"))
    return a.select("p_partkey", "g.gate", "g.measured", "g.passed")


def verdicts(spark: SparkSession, sf: str) -> DataFrame:
    return _gated(spark, sf).groupBy(gates.verdict(col("kind")).alias("verdict"), gates.ready_kind(col("kind")).alias("state")).agg(F.count("*").alias("n"))


def crown_scalars(spark: SparkSession, sf: str) -> DataFrame:
    r = col("p_size") / lit(4) - 1
    maturity = (15 - col("p_partkey") % 3 * 15).cast("double")
    return read(spark, sf, "part").select(
        "p_partkey",
        fixed(crowns.crown_area(r)).alias("area"),
        fixed(crowns.radius_at(r, maturity, (col("p_partkey") % 20 - 2).cast("double"))).alias("grown"),
        fixed(crowns.percent_after(col("p_retailprice"), col("p_size").cast("double"), (col("p_partkey") % 5 * 1000).cast("double"))).alias("after"),
        fixed(crowns.effective_added(col("p_retailprice"), F.when(col("p_partkey") % 4 != 0, col("p_partkey") % 13 / lit(10)))).alias("effective"),
    )


def lens_area(spark: SparkSession, sf: str) -> DataFrame:
    r1, r2 = (1 + col("s_suppkey") % 7).cast("double"), (1 + col("s_suppkey") % 5).cast("double")
    a = crowns.lens_area(lit(0), lit(0), r1, (col("s_suppkey") % 13).cast("double"), lit(0), r2)
    return read(spark, sf, "supplier").select("s_suppkey", fixed(a).alias("area"))


def _trees(spark: SparkSession, sf: str) -> DataFrame:
    key = col("s_suppkey")
    kinds = F.array(F.lit("large"), F.lit("medium"), F.lit("none"))
    return read(spark, sf, "supplier").select((key % 6).cast("string").alias("scene_id"), (key * 37 % 101).cast("double").alias("x"), (key * 61 % 103).cast("double").alias("y"), F.get(kinds, (key % 3).cast("int")).alias("class_key"))


def _classes(spark: SparkSession, sf: str) -> DataFrame:
    a = read(spark, sf, "region").agg(F.count("*"))
    return a.select(F.explode(F.array(F.struct(F.lit("large").alias("class_key"), lit(7.5).alias("crown_radius")), F.struct(F.lit("medium").alias("class_key"), lit(5.5).alias("crown_radius")))).alias("c")).select("c.*")


def crown_union(spark: SparkSession, sf: str) -> DataFrame:
    a = unions.crown_union(unions.with_radius(_trees(spark, sf), _classes(spark, sf)), KEYS, 0.5)
    return a.select("scene_id", *[fixed(col(c), 4).alias(c) for c in ("summed", "united", "overlap")])


def crown_union_clipped(spark: SparkSession, sf: str) -> DataFrame:
    clip = ((20.0, 20.0), (80.0, 25.0), (75.0, 90.0), (30.0, 70.0))
    trees = unions.with_radius(_trees(spark, sf), _classes(spark, sf))
    clips = trees.select("scene_id").distinct().withColumn("outer", ring(clip))
    return unions.crown_union(trees, KEYS, 0.5, clips).select("scene_id", fixed(col("united"), 4).alias("united"))


OPTIONS = planner.Options(12, ("large", "medium"), cover_threshold=0.3)


def _candidates(spark: SparkSession, sf: str) -> DataFrame:
    return planner.candidates(yards(spark, sf), pixels(spark, sf).select("scene_id", "row", "col", "ndvi"), FINE, heat(spark, sf), COARSE, OPTIONS, KEYS)


def suggest_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return _candidates(spark, sf).select("scene_id", "x", "y", fixed(col("score")).alias("score"))


def suggest_greedy(spark: SparkSession, sf: str) -> DataFrame:
    return planner.place(_candidates(spark, sf), OPTIONS, KEYS)


def plan_edits(spark: SparkSession, sf: str) -> DataFrame:
    a = planner.place(_candidates(spark, sf), OPTIONS, KEYS)
    return planner.remove_last(planner.add_tree(a, {"scene_id": "AF"}, 1.0, 2.0, OPTIONS.classes), KEYS).groupBy("scene_id").agg(F.count("*").alias("trees"), F.max("id").alias("last_id"))


def _types(spark: SparkSession, sf: str) -> DataFrame:
    """The few kinds of part, numbered by name: a list of one row."""
    return read(spark, sf, "part").agg(F.array_sort(F.collect_set("p_type")).alias("every")).select(F.posexplode("every").alias("k", "p_type"))


def _items(spark: SparkSession, sf: str) -> DataFrame:
    url = F.when(col("p_brand").endswith("1"), "").otherwise(F.concat(F.lit(" https://parts.example/"), col("p_partkey").cast("string")))
    return read(spark, sf, "part").select(
        F.concat(F.lit("R"), (col("p_size") % 3).cast("string")).alias("region"),
        F.concat(F.lit("item "), "p_type").alias("key"),
        col("p_partkey").alias("position"),
        col("p_name").alias("label"),
        col("p_retailprice").alias("low"),
        (col("p_retailprice") * 1.25).alias("high"),
        col("p_brand").alias("source_name"),
        url.alias("source_url"),
        F.lit("2026-01-01").alias("source_retrieved"),
    )


def _cost_lines(spark: SparkSession, sf: str) -> DataFrame:
    types = _types(spark, sf)
    total = types.agg(F.count("*").alias("kinds"))
    trees = read(spark, sf, "supplier").join(F.broadcast(total)).withColumn("k", (col("s_suppkey") % col("kinds")).cast("int"))  # one row
    counts = trees.join(types, "k").groupBy(col("s_nationkey").alias("plan_id"), F.concat(F.lit("R"), (col("s_nationkey") % 3).cast("string")).alias("region"), col("p_type").alias("class_key")).agg(F.count("*").alias("quantity"))
    regions = F.explode(F.array(*[F.lit(f"R{i}") for i in range(3)])).alias("region")
    class_keys = types.where("k > 0").select(regions, col("p_type").alias("class_key"), F.concat(F.lit("item "), "p_type").alias("key"))
    per_tree = types.where("k = 0").select(regions, F.concat(F.lit("item "), "p_type").alias("key"), F.lit(0).alias("position"))
    return costs.lines(counts, _items(spark, sf), class_keys, per_tree, ["plan_id"])


def cost_lines(spark: SparkSession, sf: str) -> DataFrame:
    return _cost_lines(spark, sf).withColumns({"low": fixed(col("low"), 2), "high": fixed(col("high"), 2)})


def cost_totals(spark: SparkSession, sf: str) -> DataFrame:
    return costs.totals(_cost_lines(spark, sf), ["plan_id"]).withColumns({c: fixed(col(c), 2) for c in ("total_low", "total_high")})


def cost_format(spark: SparkSession, sf: str) -> DataFrame:
    a = read(spark, sf, "part").select("p_partkey", (col("p_partkey") * 100).cast("double").alias("low"), (col("p_partkey") * 100 + col("p_partkey") % 3 * 1000).cast("double").alias("high"), (col("p_partkey") % 5 == 0).alias("bad"))
    return a.select("p_partkey", costs.formatted(col("low"), col("high"), col("bad")).alias("cost"))


def fully_cited(spark: SparkSession, sf: str) -> DataFrame:
    items = _items(spark, sf)
    return costs.fully_cited(items.unionByName(items.where("source_url <> ''").withColumn("region", F.lit("R9"))))


def _radii(spark: SparkSession, sf: str) -> DataFrame:
    status = F.when(col("p_partkey") % 3 == 0, "cited").when(col("p_partkey") % 3 == 1, "unverified")
    return read(spark, sf, "part").select(F.concat(F.lit("R"), (col("p_size") % 3).cast("string")).alias("region"), col("p_partkey").alias("position"), col("p_name").alias("label"), status.alias("radius_status"))


def unverified_labels(spark: SparkSession, sf: str) -> DataFrame:
    return costs.unverified_labels(_radii(spark, sf))


def unverified(spark: SparkSession, sf: str) -> DataFrame:
    return costs.unverified_classes(_radii(spark, sf)).select("region", F.array_join("unverified", "|").alias("unverified"))


def _rings(spark: SparkSession, sf: str) -> DataFrame:
    k = col("s_suppkey")
    v = [F.array((k * (i + 3) * 17 % 101).cast("double"), (k * (i + 5) * 29 % 103).cast("double")) for i in range(5)]
    return read(spark, sf, "supplier").select("s_suppkey", F.array(*v).alias("ring"))


def ring_area(spark: SparkSession, sf: str) -> DataFrame:
    return _rings(spark, sf).select("s_suppkey", fixed(geometry.signed_area(col("ring")), 3).alias("signed"), fixed(geometry.ring_area(col("ring")), 3).alias("area"))


def ring_centroid(spark: SparkSession, sf: str) -> DataFrame:
    a = _rings(spark, sf).withColumn("c", geometry.centroid(col("ring")))
    return a.select("s_suppkey", fixed(col("c.x"), 4).alias("x"), fixed(col("c.y"), 4).alias("y"))


def inset_ring(spark: SparkSession, sf: str) -> DataFrame:
    a = _rings(spark, sf).select("s_suppkey", F.posexplode(geometry.inset(col("ring"), geometry.inset_factor(lit(0.45)), 2)).alias("i", "p"))
    return a.select("s_suppkey", "i", col("p")[0].alias("x"), col("p")[1].alias("y"))


def utm_forward(spark: SparkSession, sf: str) -> DataFrame:
    k = col("c_custkey")
    a = read(spark, sf, "customer").select("c_custkey", (k * 7919 % 360000 / lit(1000) - 180).alias("lon"), (k * 104729 % 160000 / lit(1000) - 80).alias("lat"))
    a = a.withColumn("zone", geometry.utm_zone(col("lon")))
    east, north = geometry.to_utm(col("lon"), col("lat"), col("zone"), col("lat") >= 0)
    return a.select("c_custkey", "zone", geometry.utm_epsg(col("lon"), col("lat")).alias("epsg"), fixed(east, 2).alias("easting"), fixed(north, 2).alias("northing"))


def color_bins(spark: SparkSession, sf: str) -> DataFrame:
    a = lines(spark, sf).groupBy(raster.heat_colour(col("l_quantity")).alias("heat"), raster.green_colour(ndvi_of_line()).alias("green"))
    return a.agg(F.count("*").alias("n"))


def list_scenes(spark: SparkSession, sf: str) -> DataFrame:
    a = in_name_order(read(spark, sf, "nation").select(F.initcap("n_name").alias("name")))
    return placed(a, name_order(), Store(spark, "names"))


def grid_lattice(spark: SparkSession, sf: str) -> DataFrame:
    """The centres of every scene's cells, unknown as long as nothing is put in them."""
    a = every_cell(lines(spark, sf).select("scene_id").distinct(), SHIFTED)
    x, y = geometry.pixel_x(lit(SHIFTED.origin_x), lit(SHIFTED.pixel_w), col("col")), geometry.pixel_y(lit(SHIFTED.origin_y), lit(SHIFTED.pixel_h), col("row"))
    return a.select("scene_id", "row", "col", x.alias("x"), y.alias("y"), F.lit(None).cast("double").alias("value"))


def scaled_bands(spark: SparkSession, sf: str) -> DataFrame:
    a = read(spark, sf, "part").select("p_partkey", (col("p_partkey") % 10000).cast("double").alias("dn"))
    return a.select("p_partkey", *[fixed(raster.scaled(col("dn"), p)).alias(n) for n, p in (("surface", raster.LANDSAT_SR), ("thermal", raster.LANDSAT_ST), ("optical", raster.SENTINEL2))])


class TableScenes:
    """A source of scenes made of the driver's tables: bands and heat are sums over the lines of a cell.

    The lines are read once: whole-number sums by cell of the fine grid are written, and all else
    is made of them (a cell of heat is four by four of these, so its sums are sums of theirs).
    """

    def __init__(self, spark: SparkSession, sf: str):
        store = Store(spark, "scene-cells")
        total = lambda c, by: F.sum(F.round(col(c) * by).cast("bigint"))
        a = lines(spark, sf).groupBy("scene_id", (col("l_orderkey") % 40).cast("int").alias("row"), (col("l_partkey") % 40).cast("int").alias("col"))
        self.cells = store.save(a.agg(total("l_discount", 100).alias("discount"), total("l_tax", 100).alias("tax"), total("l_quantity", 1).alias("quantity"), F.count("*").alias("n")), "cells")
        self.ids = store.save(self.cells.select("scene_id").distinct(), "ids")

    def scenes(self) -> DataFrame:
        flag = F.substring("scene_id", 1, 1)
        a = self.ids.withColumns({"x": (F.ascii(flag) % 8 * 4096).cast("double"), "y": lit(8192)})
        grid = lambda g: F.struct(col("x").alias("origin_x"), col("y").alias("origin_y"), lit(g.pixel_w).alias("pixel_w"), lit(g.pixel_h).alias("pixel_h"), F.lit(g.width).alias("size"))
        threshold = F.when(flag == "A", lit(0.1)).otherwise(lit(0.14))
        constants = [c.alias(n) for n, c in zip(("gain", "offset", "k1", "k2"), _constants(), strict=True)]
        return a.select("scene_id", F.concat(F.lit("Site "), "scene_id").alias("name"), geometry.ring_area(ring(RING)).alias("yard_area"), threshold.alias("cover_threshold"), F.lit("10:42").alias("overpass"), grid(FINE).alias("fine_grid"), grid(COARSE).alias("thermal_grid"), *constants)

    def yards(self) -> DataFrame:
        a = self.scenes().withColumn("outer", ring(RING))
        return a.select("scene_id", F.transform("outer", lambda p: F.array(p[0] + col("fine_grid.origin_x"), p[1] - 400 + col("fine_grid.origin_y"))).alias("outer"))

    def fine(self) -> DataFrame:
        hundred = lambda c: col(c) / col("n") / lit(100)
        return self.cells.select("scene_id", "row", "col", hundred("discount").alias("nir"), hundred("tax").alias("red"))

    def thermal(self) -> DataFrame:
        by_four = lambda c: F.floor(col(c) / 4).cast("int").alias(c)
        a = self.cells.groupBy("scene_id", by_four("row"), by_four("col")).agg(*[F.sum(c).alias(c) for c in ("discount", "tax", "quantity", "n")])
        a = a.select("scene_id", "row", "col", ((col("discount") - col("tax")) / col("n")).alias("d"), (col("quantity") / col("n")).alias("q"), "n")
        noise = F.when(col("scene_id") == "AF", 20.0).when(col("scene_id") == "RF", 600.0).otherwise(100.0)
        dn = F.floor(30000 - 400 * col("d") + noise * (col("q") - 25) + 0.5).cast("double")
        return a.select("scene_id", "row", "col", dn.alias("dn"), F.when(col("n") % 9 == 0, 8.0).otherwise(64.0).alias("qa"))


class FixedCosts:
    """A cost model of one region; every item is cited, or the watering is not."""

    def __init__(self, spark: SparkSession, cited: bool):
        self.spark, self.cited = spark, cited
        self.models = self.few([("R0",)], "region string")

    def few(self, rows: list[tuple], schema: str) -> DataFrame:
        """A dimension of a few rows in the plan itself, so that Spark knows how small it is."""
        kinds = {"string": pa.string(), "int": pa.int32(), "double": pa.float64()}
        columns = [c.split() for c in schema.split(", ")]
        return self.spark.createDataFrame(pa.table({n: pa.array([r[k] for r in rows], kinds[t]) for k, (n, t) in enumerate(columns)}))

    def items(self) -> DataFrame:
        prices = (("tree_large", 712.0, 944.0), ("tree_medium", 512.0, 700.0), ("watering", 12.0, 20.0))
        rows = [("R0", n, k, k, low, high, "list", "https://prices.example/list" if self.cited or k != "watering" else "", "2026-08-07") for n, (k, low, high) in enumerate(prices)]
        return self.few(rows, "region string, position int, key string, label string, low double, high double, source_name string, source_url string, source_retrieved string")

    def class_keys(self) -> DataFrame:
        return self.few([("R0", "large_shade", "tree_large"), ("R0", "medium_shade", "tree_medium")], "region string, class_key string, key string")

    def per_tree(self) -> DataFrame:
        return self.few([("R0", 0, "watering")], "region string, position int, key string")

    def classes(self) -> DataFrame:
        return self.few([("R0", "large_shade", 7.5, 15.0), ("R0", "medium_shade", 5.5, 20.0)], "region string, class_key string, crown_radius double, maturity double")


def _rounded(a: DataFrame, numbers: tuple[str, ...], others: tuple[str, ...]) -> DataFrame:
    return a.select("scene_id", *others, *[fixed(col(c), 4).alias(c) for c in numbers])


MEASURED = ("cover_fraction", "ndvi_yard", "ndvi_cover", "ndvi_open", "lst_mean", "lst_sd", "lst_min", "lst_max", "coverage", "slope", "intercept", "r2", "ci_lo", "ci_hi")
PLANNED = ("summed", "united", "overlap", "effective", "cover_before", "cover_after", "cover_delta", "delta_ndvi", "maturity")
REPORTED = ("lst_mean", "coverage", *PLANNED, "delta_c", "delta_lo", "delta_hi", "lst_predicted", "total_low", "total_high")
SAID = ("thermal_pixels", "kind", "reason", "explanation", "method", "verdict", "n_lines", "n_sourced", "cost", "limitations")


def analyse_scene(spark: SparkSession, sf: str) -> DataFrame:
    """Masks, resampling, temperature, yard cells and the neighbourhood's fit of every scene."""
    return _rounded(Analysis(TableScenes(spark, sf)).measured(), MEASURED, ("yard_pixels", "yard_cells", "thermal_pixels", "n"))


PLAN = tuple((80.0 + 24.0 * (i % 4), -330.0 + 21.0 * (i // 4), ("large_shade", "medium_shade")[i % 2]) for i in range(12))


def _plan(spark: SparkSession, sf: str) -> DataFrame:
    trees = F.array(*[F.struct(lit(x).alias("x"), lit(y).alias("y"), F.lit(k).alias("class_key")) for x, y, k in PLAN])
    return TableScenes(spark, sf).scenes().where("scene_id <> 'RF'").select("scene_id", F.explode(trees).alias("t")).select("scene_id", "t.*")


def plan_geometry(spark: SparkSession, sf: str) -> DataFrame:
    """What a given plan changes; one scene has none."""
    analysis = Analysis(TableScenes(spark, sf))
    return _rounded(report.plan_geometry(analysis.measured(), _plan(spark, sf), FixedCosts(spark, True).classes(), analysis.yards), PLANNED, ())


def _said(a: DataFrame) -> DataFrame:
    return _rounded(a.withColumn("limitations", F.array_join("limitations", "|")), REPORTED, SAID)


def build_report(spark: SparkSession, sf: str) -> DataFrame:
    """Reports on a given plan, priced with an item that nobody cites."""
    return _said(report.build_report(Analysis(TableScenes(spark, sf)), _plan(spark, sf), FixedCosts(spark, False), "2026-08-07"))


def site_report(spark: SparkSession, sf: str) -> DataFrame:
    """The flagship: a plan is suggested for every scene, and reported on, one row each."""
    return _said(report.build_for(TableScenes(spark, sf), FixedCosts(spark, True), generated_for="2026-08-07"))


def method_labels(spark: SparkSession, sf: str) -> DataFrame:
    return _gated(spark, sf).select("p_partkey", gates.method_label(col("kind"), col("r2"), col("p_partkey") * 7, lit(15)).alias("method"))


def limitation_lines(spark: SparkSession, sf: str) -> DataFrame:
    a = _gate_rows(spark, sf).select("p_partkey", F.posexplode(gates.limitations(col("p_partkey") % 9, F.lit("10:42"), col("coverage"))).alias("place", "line"))
    return a


def contrast(spark: SparkSession, sf: str) -> DataFrame:
    a = read(spark, sf, "part").select("p_partkey", raster.heat_colour(col("p_size") + 10).alias("heat"), raster.green_colour(col("p_size") / 60).alias("green"))
    return a.select("p_partkey", fixed(raster.contrast(col("heat"), col("green")), 4).alias("contrast"))


def known_values(spark: SparkSession, sf: str) -> DataFrame:
    a = lines(spark, sf).withColumn("v", ndvi_of_line())
    return stats.values_in(a, col("v"), col("l_linenumber") <= 2).select("scene_id", "l_orderkey", "l_partkey", "l_linenumber", fixed(col("value")).alias("value"))


def fit_points(spark: SparkSession, sf: str) -> DataFrame:
    a = lines(spark, sf).withColumns({"v": ndvi_of_line(), "ok": _usable()})
    return regression.fit_points(a, "v", "l_quantity", "ok").select("scene_id", "l_orderkey", "l_partkey", "l_linenumber", fixed(col("v")).alias("x"), col("l_quantity").alias("y"))


def bool_grid(spark: SparkSession, sf: str) -> DataFrame:
    """A mask of every scene, true where a line fell into the cell."""
    there = heat(spark, sf).select("scene_id", "row", "col", F.lit(True).alias("there"))
    a = every_cell(lines(spark, sf).select("scene_id").distinct(), COARSE).join(there, ["scene_id", "row", "col"], "left")
    return a.select("scene_id", "row", "col", F.coalesce("there", F.lit(False)).alias("value"))


def plan_reset(spark: SparkSession, sf: str) -> DataFrame:
    a = planner.place(_candidates(spark, sf), OPTIONS, KEYS)
    return planner.reset(planner.remove_last(planner.remove_last(a, KEYS), KEYS), a, {"scene_id": "AF"}).groupBy("scene_id").agg(F.count("*").alias("trees"))


def recess_yard(spark: SparkSession, sf: str) -> DataFrame:
    a = geometry.with_recess_yard(_rings(spark, sf).withColumn("ring", F.transform("ring", lambda p: F.array(p[0] * 3, p[1] * 3))), "ring")
    return a.select("s_suppkey", col("yard_area").alias("area"), "parcel_area", F.size("yard").alias("vertices"))


QUERIES = {
    f.__name__: f
    for f in (
        ndvi_pixels, bands_for_ndvi, cover_fraction, masked_summary, percentiles, lst_chain, lst_roundtrip, qa_mask, coverage_gate,
        resample_aligned, resample_offset, coverage_to_grid, pip_mask, pip_hole, cell_overlap, yard_cells, sample_at, ols_fit, ols_degenerate,
        t_critical, regression_band, quantile_cutoff, predict_gate, explain_gate, decision_trace, verdicts, crown_scalars, lens_area, crown_union,
        crown_union_clipped, suggest_candidates, suggest_greedy, plan_edits, cost_lines, cost_totals, cost_format, fully_cited, unverified, unverified_labels,
        ring_area, ring_centroid, inset_ring, utm_forward, color_bins, list_scenes, grid_lattice, scaled_bands,
        analyse_scene, plan_geometry, build_report, site_report, method_labels, limitation_lines, contrast, known_values, fit_points, bool_grid,
        plan_reset, recess_yard,
    )
}
