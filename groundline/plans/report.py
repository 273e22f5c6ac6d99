"""From pixels to one report row a scene.

All scenes of a source go through one plan, each on its own grids: their sizes are columns. Pixels
are addressed in metres from their own origin, and rings are shifted likewise.
"""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import crowns, raster
from ..functions.unknown import ratio
from ..operators import costs, gates, masks, planner, regression, resample, spatial, stats, unions
from ..operators.lattice import GridDef
from ..sources.errors import Malformed
from ..sources.scenes import SceneSource
from ..sources.shared import Store

KEYS = ["scene_id"]
GRIDS = ("fine_size", "fine_w", "fine_h", "thermal_size", "thermal_w", "thermal_h")


def grid_of(name: str) -> GridDef:
    """A scene's own grid, from its columns; the origin is that of the scene."""
    size = F.col(f"{name}_size")
    return GridDef(size, size, 0.0, 0.0, F.col(f"{name}_w"), F.col(f"{name}_h"))


def sites(source: SceneSource) -> DataFrame:
    """One small row a scene: all of ``scenes``, the yard in metres from the scene's origin, and the grids as columns."""
    grids = [F.col(f"{n}_grid.{old}").alias(f"{n}_{new}") for n in ("fine", "thermal") for old, new in (("size", "size"), ("pixel_w", "w"), ("pixel_h", "h"))]
    a = source.scenes().select("*", F.col("fine_grid.origin_x").alias("__x"), F.col("fine_grid.origin_y").alias("__y"), *grids).join(source.yards(), "scene_id", "left")
    return a.withColumn("outer", F.transform("outer", lambda p: F.array(p[0] - F.col("__x"), p[1] - F.col("__y")))).drop("__x", "__y")


class Analysis:
    """What is measured of each scene of a source.

    The source is read once: scenes with their yards, and the two pixel tables with all that is
    derived of a pixel, are written to the shared folder, and every measurement, the error model
    and the suggested plan read these files. ``release`` deletes them.
    """

    def __init__(self, source: SceneSource, spark: SparkSession | None = None):
        self.store = Store(spark or SparkSession.active(), "analysis")
        self.sites = self.store.save(sites(source), "sites")
        self.scenes = self.sites.drop("outer", *GRIDS)
        self.yards = self.sites.select("scene_id", "outer")
        fine = source.fine().withColumn("ndvi", raster.ndvi(F.col("nir"), F.col("red")))
        fine = masks.rasterise(fine.select("scene_id", "row", "col", "ndvi"), self.sites, grid_of("fine"), keep=("cover_threshold", *GRIDS))
        fine = fine.withColumns({"cover": raster.is_cover(F.col("ndvi"), F.col("cover_threshold")), "valid": F.col("in_yard") & F.col("ndvi").isNotNull()})
        self.fine = self.store.save(fine, "fine")
        means = resample.resample(self.fine, grid_of("fine"), grid_of("thermal"), "ndvi", complete=False).withColumnRenamed("value", "ndvi")
        constants = self.sites.select("scene_id", "gain", "offset", "k1", "k2")
        thermal = source.thermal().join(means, ["scene_id", "row", "col"], "left").join(constants, "scene_id")
        thermal = raster.with_surface_temperature(thermal, "lst", *[F.col(c) for c in ("dn", "ndvi", "gain", "offset", "k1", "k2")]).withColumn("usable", raster.usable(F.col("qa")))
        self.thermal = self.store.save(masks.yard_cells(thermal.select("scene_id", "row", "col", "ndvi", "lst", "usable"), self.sites, grid_of("thermal")), "thermal")

    def release(self) -> None:
        self.store.release()

    def measured(self) -> DataFrame:
        v, cover, valid = F.col("ndvi"), F.col("cover"), F.col("valid")
        cover = self.fine.groupBy(*KEYS).agg(
            stats.cover_fraction(cover, valid).alias("cover_fraction"),
            stats.masked_mean(v, valid).alias("ndvi_yard"),
            stats.masked_mean(v, valid & cover).alias("ndvi_cover"),
            stats.masked_mean(v, valid & ~cover).alias("ndvi_open"),
            stats.count_mask(F.col("in_yard")).alias("yard_pixels"),
        )
        seen = F.col("usable") & F.col("in_yard")
        s = stats.summary(F.col("lst"), seen)
        heat = self.thermal.groupBy(*KEYS).agg(*[s[n].alias(f"lst_{n}") for n in ("mean", "sd", "min", "max")], stats.known_count(F.col("lst"), seen).alias("thermal_pixels"), stats.count_mask(F.col("in_yard")).alias("yard_cells"), stats.coverage(F.col("usable"), F.col("in_yard")).alias("coverage"))
        fits = regression.fit(self.thermal, F.col("ndvi"), F.col("lst"), KEYS, F.col("usable"))
        return self.scenes.join(cover, "scene_id", "left").join(heat, "scene_id", "left").join(fits, "scene_id", "left")

    def error_model(self, bandwidth: int = 2) -> DataFrame:
        """The scenes' fits with residuals that may depend on their neighbours'."""
        return spatial.error_model(self.thermal, F.col("ndvi"), F.col("lst"), KEYS, F.col("usable"), bandwidth)

    def suggested(self, options: planner.Options) -> DataFrame:
        """A plan for each scene, by its own threshold of the index; written, as several joins read it."""
        found = planner.candidates(self.sites.select("scene_id", "outer", "cover_threshold", *GRIDS), self.fine.select("scene_id", "row", "col", "ndvi"), grid_of("fine"), self.thermal.select("scene_id", "row", "col", "lst"), grid_of("thermal"), replace(options, cover_threshold=F.col("cover_threshold")), KEYS)
        return self.store.save(planner.place(found, options, KEYS), "suggested")


def plan_geometry(measured: DataFrame, trees: DataFrame, classes: DataFrame, yards: DataFrame) -> DataFrame:
    """What a plan's crowns change: areas, cover share before and after, and the index's shift.

    Where measurements and classes have a region, a scene has a row for each of its own.
    """
    keys = [*KEYS, "region"] if "region" in measured.columns else KEYS
    own = measured.select(*keys)
    trees = trees if "region" in trees.columns or "region" not in keys else trees.join(own, "scene_id")
    areas = unions.crown_union(unions.with_radius(trees, classes), keys, clips=own.join(yards, "scene_id"))
    if "region" in keys:
        a = measured.join(areas, keys, "left").join(classes.groupBy("region").agg(F.max("maturity").alias("maturity")), "region", "left")
    else:
        a = measured.join(areas, keys, "left").join(F.broadcast(classes.agg(F.max("maturity").alias("maturity"))))  # one row
    a = a.withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) for c in ("summed", "united", "overlap", "maturity")})
    a = a.withColumn("effective", crowns.effective_added(F.col("united"), F.col("cover_fraction")))
    before = F.col("cover_fraction") * 100
    existing = F.coalesce(F.col("cover_fraction") * F.col("yard_area"), F.lit(0.0))
    a = a.withColumns({"cover_before": before, "cover_after": crowns.percent_after(existing, F.col("effective"), F.col("yard_area"))})
    shift = ratio(F.col("effective"), F.col("yard_area")) * (F.col("ndvi_cover") - F.col("ndvi_open"))
    return a.withColumns({"cover_delta": F.col("cover_after") - F.col("cover_before"), "delta_ndvi": shift})


def regions_of(scenes: DataFrame, cost_model, region: str | DataFrame | None) -> DataFrame:
    """scene_id and region: whose prices and crowns a scene is reported with.

    A name serves all scenes; a table (scene_id, region) gives each scene its own, or several;
    without either the model must have one region. A region that the model lacks is refused.
    """
    known = cost_model.models.select("region").distinct()
    if isinstance(region, DataFrame):
        own = scenes.select("scene_id").join(region.select("scene_id", "region").distinct(), "scene_id")
        if strange := own.select("region").distinct().join(known, "region", "left_anti").first():
            raise Malformed(str(strange.region), "no cost model for this region")
        return own
    there = [r.region for r in known.limit(2).collect()] if region is None else [r.region for r in known.where(F.col("region") == region).collect()]
    if len(there) != 1:
        raise Malformed(region or "cost model", "no cost model for this region" if not there else "several regions, of which one has to be chosen")
    return scenes.select("scene_id", F.lit(there[0]).alias("region"))


def build_report(analysis: Analysis, trees: DataFrame, cost_model, generated_for: str, region: str | DataFrame | None = None) -> DataFrame:
    """One row a scene and region. A scene without a prediction or a price keeps its row and says why."""
    run = uuid.uuid4().hex
    own = analysis.store.save(regions_of(analysis.scenes, cost_model, region), f"regions-{run}")
    a = analysis.store.save(analysis.measured().join(own, "scene_id"), f"measured-{run}")  # the plan's geometry reads it twice
    planted = trees.join(own, "scene_id")
    a = plan_geometry(a, planted, cost_model.classes(), analysis.yards)
    a = a.withColumns(gates.prediction(*[F.col(c) for c in ("slope", "r2", "ci_lo", "ci_hi", "delta_ndvi", "coverage")]))
    counts = planted.groupBy(*KEYS, "region", "class_key").agg(F.count("*").alias("quantity"))
    lines = costs.lines(counts, cost_model.items(), cost_model.class_keys(), cost_model.per_tree(), KEYS)
    a = a.join(costs.totals(lines, KEYS), [*KEYS, "region"], "left")
    none = F.col("n_lines").isNull()
    a = a.withColumns({"total_low": F.coalesce("total_low", F.lit(0.0)), "total_high": F.coalesce("total_high", F.lit(0.0)), "has_unsourced": F.coalesce("has_unsourced", F.lit(False)), "n_lines": F.coalesce("n_lines", F.lit(0)), "n_sourced": F.when(none, 0).otherwise(F.col("n_sourced"))})
    return a.withColumns(
        {
            "generated_for": F.lit(generated_for),
            "explanation": gates.explanation(F.col("kind"), F.col("reason"), F.col("r2"), F.col("coverage")),
            "method": gates.method_label(F.col("kind"), F.col("r2"), F.col("n"), F.col("maturity")),
            "lst_predicted": F.col("lst_mean") + F.col("delta_c"),
            "verdict": gates.verdict(F.col("kind")),
            "cost": costs.formatted(F.col("total_low"), F.col("total_high"), F.col("has_unsourced")),
            "limitations": gates.limitations(F.col("thermal_pixels"), F.col("overpass"), F.col("coverage")),
            "trace": gates.decision_trace(F.col("coverage"), F.col("r2"), F.col("n_lines"), F.col("n_sourced")),
        }
    )


def build_for(source: SceneSource, cost_model, classes: tuple[str, ...] = ("large_shade", "medium_shade"), count: int = 12, generated_for: str = "", region: str | DataFrame | None = None) -> DataFrame:
    """Suggest a plan for every scene of the source, and report on it."""
    analysis = Analysis(source)
    return build_report(analysis, analysis.suggested(planner.Options(count, classes)), cost_model, generated_for, region)
