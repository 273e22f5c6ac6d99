"""Ordinary least squares per group, with Student-t intervals of the slope."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from ..functions.student_t import critical
from ..functions.unknown import clamp, known, ratio
from .stats import at_ranks

#: Residual sums below this share of the total are rounding, and count as none.
ROUNDING = 1e-13


@pandas_udf(DoubleType())
def t_critical(df: pd.Series) -> pd.Series:
    """One value a group of the fit, never one a pixel; repeated ones are remembered."""
    return df.map(lambda d: None if pd.isna(d) or d <= 0 else critical(float(d))).astype("float64")


def fit(rows: DataFrame, x: Column, y: Column, keys: list[str], where: Column | None = None, more: tuple[str, ...] = ()) -> DataFrame:
    """keys, n, slope, intercept, r2, slope_se, ci_lo, ci_hi; ``more`` of sxx, syy, sxy, mx, my.

    One aggregation: Spark's moments are centred, so that the residual sum is syy - sxy**2/sxx
    with an error of rounding only. Fewer than three pairs, or equal x, give unknown numbers;
    equal y gives an unknown r2, which Spark alone would call a perfect fit. Whether numbers are
    equal is told by their bounds: moments of partitions, once merged, leave a rounding instead of 0.
    """
    pairs = rows.select(*keys, known(x).alias("x"), known(y).alias("y"), (F.lit(True) if where is None else where).alias("used"))
    both = F.col("used") & F.col("x").isNotNull() & F.col("y").isNotNull()
    px, py = F.when(both, F.col("x")), F.when(both, F.col("y"))
    same_x, same_y = F.min(px) == F.max(px), F.min(py) == F.max(py)
    sums = pairs.groupBy(*keys).agg(
        F.count(px).alias("n"),
        F.when(same_x, 0.0).otherwise(F.regr_sxx(py, px)).alias("sxx"),
        F.when(same_y, 0.0).otherwise(F.regr_syy(py, px)).alias("syy"),
        F.when(same_x | same_y, 0.0).otherwise(F.regr_sxy(py, px)).alias("sxy"),
        F.avg(px).alias("mx"),
        F.avg(py).alias("my"),
    )
    fits = (F.col("n") >= 3) & (F.col("sxx") > 0)
    slope = F.when(fits, ratio(F.col("sxy"), F.col("sxx")))
    rss = F.col("syy") - F.col("slope") * F.col("sxy")
    rss = F.when(rss <= ROUNDING * F.col("syy"), 0.0).otherwise(rss)
    a = sums.withColumn("slope", slope).withColumn("rss", rss)
    a = a.withColumn("slope_se", F.sqrt(ratio(F.col("rss"), (F.col("n") - 2) * F.col("sxx"))))
    reach = t_critical(F.when(F.col("slope").isNotNull(), (F.col("n") - 2).cast("double"))) * F.col("slope_se")
    a = a.withColumn("reach", reach)
    return a.select(
        *keys,
        "n",
        "slope",
        (F.col("my") - F.col("slope") * F.col("mx")).alias("intercept"),
        F.when(F.col("slope").isNotNull() & (F.col("syy") > 0), clamp(1 - ratio(F.col("rss"), F.col("syy")), 0, 1)).alias("r2"),
        "slope_se",
        (F.col("slope") - F.col("reach")).alias("ci_lo"),
        (F.col("slope") + F.col("reach")).alias("ci_hi"),
        *more,
    )


def fit_points(rows: DataFrame, x: str, y: str, usable: str) -> DataFrame:
    """The rows that a fit uses."""
    return rows.where(F.col(usable) & known(F.col(x)).isNotNull() & known(F.col(y)).isNotNull())


def band(points: DataFrame, fits: DataFrame, x: str, keys: list[str], steps: int = 24) -> DataFrame:
    """The fitted line and its slope interval at steps + 1 places of the padded range of x."""
    low, high = F.min(x), F.max(x)
    pad = F.coalesce(F.nullif((high - low) * 0.06, F.lit(0.0)), F.lit(0.01))
    spans = points.groupBy(*keys).agg((low - pad).alias("x0"), (high + pad).alias("x1"))
    a = spans.join(fits, keys).withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(steps))))
    at = F.col("x0") + (F.col("x1") - F.col("x0")) * F.col("step") / steps
    a = a.withColumn("x", at)
    return a.select(*keys, "step", "x", *[(F.col("intercept") + F.col(s) * F.col("x")).alias(n) for s, n in (("slope", "y"), ("ci_lo", "y_lo"), ("ci_hi", "y_hi"))])


def quantile_cutoff(values: DataFrame, value: str, target: float, keys: list[str]) -> DataFrame:
    """keys and the value of rank round(n * target) in ascending order; NULL if that rank is 0."""
    a = at_ranks(values, F.col(value), keys, {"cutoff": F.floor(F.col("n") * target + 0.5) - 1})
    return a.select(*keys, "cutoff")
