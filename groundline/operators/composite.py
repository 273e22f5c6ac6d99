"""Many dates of a site as one: the median of each pixel over the dates on which it was seen clearly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.unknown import known


def composite(pixels: DataFrame, values: dict[str, Column], usable: Column, keys: list[str], date: str = "date", least: int = 1) -> DataFrame:
    """keys, the exact median of each value over usable dates, n_dates (usable ones), first_date, last_date.

    ``pixels`` has a row for every date of a pixel; ``keys`` name the pixel (scene, row, col). All
    values go through one aggregation by pixel, whose groups are as large as there are dates.
    A value that is unknown on a date takes no part in its own median; pixels seen on fewer than
    ``least`` dates stay, with unknown values.
    """
    seen = F.coalesce(usable, F.lit(False))
    enough = F.col("n_dates") >= least
    a = pixels.groupBy(*keys).agg(
        *[F.median(F.when(seen, known(v))).alias(n) for n, v in values.items()],
        F.count_if(seen).alias("n_dates"),
        F.min(F.when(seen, F.col(date))).alias("first_date"),
        F.max(F.when(seen, F.col(date))).alias("last_date"),
    )
    return a.select(*keys, *[F.when(enough, F.col(n)).alias(n) for n in values], "n_dates", "first_date", "last_date")


def in_season(pixels: DataFrame, months: tuple[int, ...], date: str = "date") -> DataFrame:
    """The dates of some months of any year."""
    return pixels.where(F.month(date).isin(*months))
