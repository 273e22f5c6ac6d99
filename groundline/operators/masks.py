"""Polygons on grids: by pixel centre on fine grids, by covered share on coarse ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from .lattice import GridDef


def scan_lines(polygons: DataFrame, grid: GridDef) -> DataFrame:
    """``polygons`` once for each row of their grid, with where the row's centre line crosses ``outer`` and each of ``holes``."""
    own = grid.as_columns()
    a = polygons.withColumn("row", F.explode_outer(F.sequence(F.lit(0), own.height.cast("int") - 1)))
    y = g.pixel_y(own.origin_y, own.pixel_h, F.col("row"))
    a = a.withColumn("outer_at", g.crossings(F.col("outer"), y))
    return a.withColumn("holes_at", F.transform("holes", lambda h: g.crossings(h, y))) if "holes" in polygons.columns else a


def rasterise(pixels: DataFrame, polygons: DataFrame, grid: GridDef, keys: tuple[str, ...] = ("scene_id",), name: str = "in_yard", keep: tuple[str, ...] = ()) -> DataFrame:
    """``pixels`` with whether each centre is inside its scene's polygon (``outer``, optionally ``holes``).

    A scene has one polygon. Its edges meet the grid's rows once (``scan_lines``); a pixel is joined
    by scene and row, so a large scene is no single key, and compares itself with its row's crossings only.
    Columns of ``polygons`` named in ``keep`` stay; the grid may be made of its columns.
    """
    own = grid.as_columns()
    low, high, _, _ = g.bounds(F.col("outer"))
    rows = scan_lines(polygons.withColumns({"bx0": low, "bx1": high}), grid)
    a = pixels.join(rows, [*keys, "row"], "left")
    x = g.pixel_x(own.origin_x, own.pixel_w, F.col("col"))
    inside = x.between(F.col("bx0"), F.col("bx1")) & g.odd_beyond(F.col("outer_at"), x)
    if "holes" in polygons.columns:
        inside &= ~F.coalesce(F.exists("holes_at", lambda h: g.odd_beyond(h, x)), F.lit(False))
    return a.withColumn(name, F.coalesce(inside, F.lit(False))).select(*pixels.columns, *keep, name)


def cell_shares(cells: DataFrame, polygons: DataFrame, grid: GridDef, keys: tuple[str, ...] = ("scene_id",), name: str = "yard_share") -> DataFrame:
    """``cells`` with the share of each that the polygon covers, from 64 sample points."""
    low_x, high_x, low_y, high_y = g.bounds(F.col("outer"))
    a = cells.join(polygons.withColumns({"bx0": low_x, "bx1": high_x, "by0": low_y, "by1": high_y}), list(keys), "left")
    own = grid.as_columns()
    left, top = own.origin_x + F.col("col") * own.pixel_w, own.origin_y - F.col("row") * own.pixel_h
    meets = (left <= F.col("bx1")) & (left + own.pixel_w >= F.col("bx0")) & (top >= F.col("by0")) & (top - own.pixel_h <= F.col("by1"))
    share = F.when(meets, g.cell_share(F.col("outer"), left, top, own.pixel_w, own.pixel_h)).otherwise(0.0)
    return a.withColumn(name, F.coalesce(share, F.lit(0.0))).select(*cells.columns, name)


def yard_cells(cells: DataFrame, polygons: DataFrame, grid: GridDef, keys: tuple[str, ...] = ("scene_id",), least: float = g.MIN_CELL_SHARE, name: str = "in_yard") -> DataFrame:
    shares = cell_shares(cells, polygons, grid, keys, "__share")
    return shares.withColumn(name, F.col("__share") >= least).drop("__share")
