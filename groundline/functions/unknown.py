"""Unknown values. A value that is not known is NULL: never 0, NaN or an infinity.

Spark's own defaults break that rule (NaN sorts above everything, ``least`` skips NULL, dividing
by zero raises), so all division and clamping of measurements goes through this module.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def known(x: Column) -> Column:
    """NaN and the infinities become NULL; written so that NULL stays NULL."""
    x = x.cast("double")
    return F.when(F.abs(x) < F.lit(float("inf")), x)


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.when(x.isNotNull(), F.least(F.lit(float(high)), F.greatest(F.lit(float(low)), x)))


def share(part: Column, whole: Column) -> Column:
    """Count of rows where ``part`` holds among those where ``whole`` does; NULL if there are none."""
    return ratio(F.count_if(part & whole), F.count_if(whole))


def fixed(x: Column, digits: int = 6) -> Column:
    """Half up in steps of 10**-digits, by arithmetic that any engine repeats exactly.

    Values whose multiple passes 2**53 have no such digits left and stay as they are.
    """
    by = F.lit(float(10**digits))
    return F.when(F.abs(x * by) < float(1 << 53), F.floor(x * by + F.lit(0.5)).cast("double") / by).otherwise(x)
