"""Regular grids as long tables of (row, col), and point lookups in them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..sources.errors import Malformed


@dataclass(frozen=True)
class GridDef:
    """North-up grid: outer edge of the top-left pixel, pixel size in metres, projection.

    Any of them may be a column, so that every scene has its own grid.
    """

    width: int | Column
    height: int | Column
    origin_x: float | Column
    origin_y: float | Column
    pixel_w: float | Column
    pixel_h: float | Column
    epsg: int = 0

    def as_columns(self) -> GridDef:
        of = lambda v: v if isinstance(v, Column) else F.lit(v)
        return GridDef(of(self.width), of(self.height), of(self.origin_x), of(self.origin_y), of(self.pixel_w), of(self.pixel_h), self.epsg)


def require_same_shape(a: GridDef, b: GridDef, what: str) -> None:
    """Refuses two grids of numbers that differ in anything."""
    if a != b:
        raise Malformed(what, f"grids differ: {a} and {b}")


def every_cell(scenes: DataFrame, grid: GridDef) -> DataFrame:
    """``scenes`` once for each row and col of the grid."""
    g_ = grid.as_columns()
    a = scenes.withColumn("row", F.explode(F.sequence(F.lit(0), g_.height - 1)))
    return a.withColumn("col", F.explode(F.sequence(F.lit(0), g_.width - 1)))


def lattice(spark: SparkSession, grid: GridDef, fill: Column | None = None) -> DataFrame:
    """row, col, x, y (pixel centres) and value, unknown unless ``fill`` is given."""
    rows = spark.range(grid.height).select(F.col("id").cast("int").alias("row"), F.explode(F.sequence(F.lit(0), F.lit(grid.width - 1))).alias("col"))
    return rows.select(
        "row",
        "col",
        g.pixel_x(F.lit(grid.origin_x), F.lit(grid.pixel_w), F.col("col")).alias("x"),
        g.pixel_y(F.lit(grid.origin_y), F.lit(grid.pixel_h), F.col("row")).alias("y"),
        (F.lit(None).cast("double") if fill is None else fill).alias("value"),
    )


def sample(points: DataFrame, pixels: DataFrame, grid: GridDef, value: str, x: str = "x", y: str = "y", keys: tuple[str, ...] = ()) -> DataFrame:
    """``points`` with the value of the pixel that each lies in; NULL off the grid or where unknown."""
    own = grid.as_columns()
    at = points.withColumn("row", g.cell_row(own.origin_y, own.pixel_h, F.col(y)))
    at = at.withColumn("col", g.cell_col(own.origin_x, own.pixel_w, F.col(x)))
    return at.join(pixels.select(*keys, "row", "col", value), [*keys, "row", "col"], "left")
