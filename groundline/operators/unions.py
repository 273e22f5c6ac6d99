"""What planned crowns cover: summed areas, the area of their union, their overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import crowns as c
from ..functions import geometry as g
from ..functions.unknown import ratio

CELL = 0.5


def with_radius(trees: DataFrame, classes: DataFrame) -> DataFrame:
    """Trees with their class's crown radius, 0 for a class that is not listed.

    Trees of a region take the radii of that region. The list of classes is a dimension of a few
    rows; Spark broadcasts it only if it is small.
    """
    keys = ["region", "class_key"] if "region" in trees.columns else ["class_key"]
    radii = classes.groupBy(*keys).agg(F.min("crown_radius").alias("radius"))
    return trees.join(radii, keys, "left").withColumn("radius", F.coalesce("radius", F.lit(0.0)))


def summed_area(radius: Column) -> Column:
    return F.coalesce(F.sum(c.crown_area(radius)), F.lit(0.0))


def crown_union(trees: DataFrame, keys: list[str], cell: float = CELL, clips: DataFrame | None = None) -> DataFrame:
    """keys, summed, united, overlap of each plan.

    The union is counted on a lattice of square cells over the crowns' bounding box. Each crown
    sends out only the lattice points that it covers itself; points are then made distinct by
    key, so the work goes with the crowns' areas and no point meets a crown far from it. With
    ``clips`` (keys, outer) points outside the polygon do not count.
    """
    sums = trees.groupBy(*keys).agg(summed_area(F.col("radius")).alias("summed"))
    r = F.col("radius")
    live = trees.where("radius > 0")
    boxes = live.groupBy(*keys).agg(F.min(F.col("x") - r).alias("x0"), F.max(F.col("x") + r).alias("x1"), F.min(F.col("y") - r).alias("y0"), F.max(F.col("y") + r).alias("y1"))
    a = live.select(*keys, "x", "y", "radius").join(boxes, keys)
    limit = lambda n: F.greatest(F.lit(1), F.ceil((F.col(f"{n}1") - F.col(f"{n}0")) / cell).cast("int")) - 1

    def reach(n: str) -> Column:
        first = F.greatest(F.lit(0), F.floor((F.col(n) - r - F.col(f"{n}0")) / cell).cast("int") - 1)
        last = F.least(limit(n), F.ceil((F.col(n) + r - F.col(f"{n}0")) / cell).cast("int") + 1)
        return F.explode(F.sequence(first, F.greatest(first, last)))

    a = a.withColumn("row", reach("y"))
    a = a.withColumn("py", F.col("y0") + (F.col("row") + 0.5) * cell).where(F.abs(F.col("py") - F.col("y")) <= r)
    a = a.withColumn("col", reach("x"))
    a = a.withColumn("px", F.col("x0") + (F.col("col") + 0.5) * cell)
    dx, dy = F.col("px") - F.col("x"), F.col("py") - F.col("y")
    covered = a.where(dx * dx + dy * dy <= r * r).groupBy(*keys, "row", "col").agg(F.first("px").alias("px"), F.first("py").alias("py"))
    if clips is not None:
        covered = covered.join(clips, keys).where(g.in_polygon(F.col("outer"), F.col("px"), F.col("py")))
    counts = covered.groupBy(*keys).agg((F.count("*") * (cell * cell)).alias("counted"))
    out = sums.join(counts, keys, "left").withColumn("united", F.least("summed", F.coalesce("counted", F.lit(0.0))))
    overlap = F.when(F.col("summed") > 0, 1 - ratio(F.col("united"), F.col("summed"))).otherwise(0.0)
    return out.select(*keys, "summed", "united", overlap.alias("overlap"))
