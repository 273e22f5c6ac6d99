"""Fits on a lattice whose residuals resemble their neighbours': Moran's I and kernel-weighted errors.

Neighbours are met by shifting keys: a cell sends its numbers to the cells around it, and one
aggregation by cell brings them together with the cell's own. So no cell meets a cell far from
it, sums are formed before the only shuffle, and a scene's cells are dealt over all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.unknown import known, ratio
from .regression import fit, t_critical


def lags(bandwidth: int) -> list[tuple[int, int, float, float]]:
    """(rows, columns, kernel, adjacent): the product of two triangles; cells that share a side are adjacent."""
    reach = max(1, bandwidth)
    span = range(-reach, reach + 1)
    weight = lambda d: max(0.0, 1 - abs(d) / (bandwidth + 1))
    return [(i, j, weight(i) * weight(j), float(abs(i) + abs(j) == 1)) for i in span for j in span]


def residuals(cells: DataFrame, x: Column, y: Column, keys: list[str], where: Column, fits: DataFrame) -> DataFrame:
    """keys, row, col, e (residual) and u (residual times centred x) of the cells that the fit uses."""
    a = cells.select(*keys, "row", "col", known(x).alias("__x"), known(y).alias("__y"), where.alias("__used")).where("__used and __x is not null and __y is not null")
    a = a.join(fits.select(*keys, "slope", "intercept", "mx"), keys).where("slope is not null")
    e = F.col("__y") - F.col("intercept") - F.col("slope") * F.col("__x")
    return a.select(*keys, "row", "col", e.alias("e"), ((F.col("__x") - F.col("mx")) * e).alias("u"))


def neighbour_sums(cells: DataFrame, keys: list[str], bandwidth: int) -> DataFrame:
    """keys, row, col, e, u, and of the cells around: ``ku`` (kernel-weighted u, its own included), ``we`` (e of adjacent ones), ``degree``."""
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(k).alias("k"), F.lit(w).alias("w")) for i, j, k, w in lags(bandwidth) if k or w])
    a = cells.withColumn("s", F.explode(steps))
    here = (F.col("s.i") == 0) & (F.col("s.j") == 0)
    a = a.select(*keys, (F.col("row") + F.col("s.i")).alias("row"), (F.col("col") + F.col("s.j")).alias("col"), *[F.when(here, F.col(c)).alias(c) for c in ("e", "u")], (F.col("s.k") * F.col("u")).alias("ku"), (F.col("s.w") * F.col("e")).alias("we"), F.col("s.w").alias("w"))
    sums = a.groupBy(*keys, "row", "col").agg(F.max("e").alias("e"), F.max("u").alias("u"), F.sum("ku").alias("ku"), F.sum("we").alias("we"), F.sum("w").alias("degree"))
    return sums.where("e is not null")


def error_model(cells: DataFrame, x: Column, y: Column, keys: list[str], where: Column | None = None, bandwidth: int = 2) -> DataFrame:
    """keys, n, slope, slope_se, moran_i, moran_z, hac_se, spatial_se, ci_lo, ci_hi.

    ``cells`` have integer ``row`` and ``col``, one row a cell. ``moran_i`` is that of the
    residuals over cells that share a side, ``moran_z`` its distance from independence in
    standard errors under normality. ``hac_se`` is the slope's error with residuals correlated
    over ``bandwidth`` cells each way. ``spatial_se`` is the larger of it and the plain error: an
    interval never becomes narrower for its residuals. Unknown where there is no slope, no
    neighbour or no residual at all.
    """
    used = F.lit(True) if where is None else where
    fits = fit(cells, x, y, keys, used, ("sxx", "mx"))
    own = neighbour_sums(residuals(cells, x, y, keys, used, fits), keys, bandwidth)
    sums = own.groupBy(*keys).agg(F.sum(F.col("u") * F.col("ku")).alias("meat"), F.sum(F.col("e") * F.col("we")).alias("cross"), F.sum(F.col("e") * F.col("e")).alias("ee"), F.sum("degree").alias("s0"), F.sum(F.col("degree") * F.col("degree")).alias("dd"))
    a = fits.join(sums, keys, "left").withColumn("nn", F.col("n").cast("double"))
    a = a.withColumn("moran_i", F.when(F.col("ee") > 0, ratio(F.col("nn") * F.col("cross"), F.col("s0") * F.col("ee"))))
    expected = F.lit(-1.0) / (F.col("nn") - 1)
    # Of weights of one and nought: S1 = 2 S0, S2 = 4 times the sum of squared degrees.
    spread = ratio(2 * F.col("nn") * F.col("nn") * F.col("s0") - 4 * F.col("nn") * F.col("dd") + 3 * F.col("s0") * F.col("s0"), (F.col("nn") * F.col("nn") - 1) * F.col("s0") * F.col("s0")) - expected * expected
    a = a.withColumns({"moran_z": F.when(F.col("moran_i").isNotNull() & (spread > 0), (F.col("moran_i") - expected) / F.sqrt(spread)), "hac_se": F.sqrt(F.greatest(F.lit(0.0), ratio(F.col("nn") * F.col("meat"), (F.col("nn") - 2) * F.col("sxx") * F.col("sxx"))))})
    a = a.withColumn("spatial_se", F.when(F.col("hac_se").isNotNull(), F.greatest("slope_se", "hac_se")))
    a = a.withColumn("reach", t_critical(F.when(F.col("slope").isNotNull(), F.col("nn") - 2)) * F.col("spatial_se"))
    return a.select(*keys, "n", "slope", "slope_se", "moran_i", "moran_z", "hac_se", "spatial_se", (F.col("slope") - F.col("reach")).alias("ci_lo"), (F.col("slope") + F.col("reach")).alias("ci_hi"))
