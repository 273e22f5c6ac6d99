"""Area-weighted resampling between grids: an interval-overlap join without a nested loop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.unknown import known, ratio
from ..sources.errors import Malformed
from .lattice import GridDef, every_cell, lattice


def _covered(start: Column, stop: Column, size: Column, cells: Column) -> Column:
    """Numbers of the coarse cells that [start, stop) reaches into, all within the grid."""
    first = F.greatest(F.lit(0), F.floor(start / size).cast("int"))
    last = F.least(cells - 1, F.ceil(stop / size).cast("int") - 1)
    return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))


def resample(fine: DataFrame, grid: GridDef, coarse: GridDef, value: str = "value", keys: tuple[str, ...] = ("scene_id",), complete: bool = True, scenes: DataFrame | None = None) -> DataFrame:
    """keys, row, col, value of every coarse cell: the mean of known fine values by overlap area.

    A fine pixel is sent to the few cells it overlaps, so the only shuffle is that of the sums,
    which are formed before it. With ``complete`` cells that no pixel reaches come as unknown:
    those of ``scenes`` (keys, and the columns that the coarse grid is made of) if given, else of
    the keys that occur.
    """
    if grid.epsg != coarse.epsg:
        raise Malformed("resample", f"EPSG {grid.epsg} and {coarse.epsg} differ")
    f, c = grid.as_columns(), coarse.as_columns()
    left = f.origin_x - c.origin_x + F.col("col") * f.pixel_w
    top = c.origin_y - f.origin_y + F.col("row") * f.pixel_h
    a = fine.withColumns({"__v": known(F.col(value)), "__x0": left, "__y0": top})
    a = a.where("__v is not null").withColumns({"__x1": F.col("__x0") + f.pixel_w, "__y1": F.col("__y0") + f.pixel_h, "__w": c.pixel_w, "__h": c.pixel_h})
    a = a.select(*keys, "__v", "__x0", "__x1", "__y0", "__y1", "__w", "__h", _covered(F.col("__x0"), F.col("__x1"), F.col("__w"), c.width).alias("__cols"), _covered(F.col("__y0"), F.col("__y1"), F.col("__h"), c.height).alias("__rows"))
    a = a.withColumn("__col", F.explode("__cols")).withColumn("__row", F.explode("__rows"))
    dx = F.least(F.col("__x1"), (F.col("__col") + 1) * F.col("__w")) - F.greatest(F.col("__x0"), F.col("__col") * F.col("__w"))
    dy = F.least(F.col("__y1"), (F.col("__row") + 1) * F.col("__h")) - F.greatest(F.col("__y0"), F.col("__row") * F.col("__h"))
    a = a.withColumns({"__dx": dx, "__dy": dy}).where("__dx > 0 and __dy > 0").withColumn("__area", F.col("__dx") * F.col("__dy"))
    out = a.groupBy(*keys, F.col("__row").alias("row"), F.col("__col").alias("col")).agg(ratio(F.sum(F.col("__v") * F.col("__area")), F.sum("__area")).alias("value"))
    if not complete:
        return out
    if not keys:
        return lattice(fine.sparkSession, coarse).select("row", "col").join(out, ["row", "col"], "left")
    cells = every_cell(fine.select(*keys).distinct() if scenes is None else scenes, coarse).select(*keys, "row", "col")
    return cells.join(out, [*keys, "row", "col"], "left")


def coverage(fine: DataFrame, grid: GridDef, coarse: GridDef, mask: str = "mask", keys: tuple[str, ...] = ("scene_id",), scenes: DataFrame | None = None) -> DataFrame:
    """The share of each coarse cell that the mask covers."""
    return resample(fine.withColumn(mask, F.col(mask).cast("double")), grid, coarse, mask, keys, scenes=scenes)
