"""Sites of a district by what a dollar cools; a site without evidence is listed as such, not ranked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.order import ranked
from ..functions.unknown import known, ratio

INSUFFICIENT = "insufficient evidence"


def cooling_per_dollar(delta_c: Column, low: Column, high: Column, per: float = 1000.0) -> Column:
    """Degrees that a plan cools by, for each ``per`` dollars of the middle of its price; unknown for a plan without a price."""
    middle = (known(low) + known(high)) / 2
    return F.when(middle > 0, ratio(-known(delta_c) * per, middle))


def ranking(reports: DataFrame, per: float = 1000.0) -> DataFrame:
    """``reports`` (kind, delta_c, total_low, total_high, has_unsourced) with score, standing and place.

    Places count from the most cooling per dollar; sites with equal scores share one. A withheld
    prediction or price leaves score and place unknown and says so in ``standing``: the site is
    neither dropped nor last.
    """
    priced = ~F.coalesce(F.col("has_unsourced"), F.lit(True)) & (F.col("kind") != "suppressed")
    a = reports.withColumn("score", F.when(priced, cooling_per_dollar(F.col("delta_c"), F.col("total_low"), F.col("total_high"), per)))
    a = a.withColumn("standing", F.when(F.col("score").isNull(), INSUFFICIENT).when(F.col("kind") == "weak", "indicative").otherwise("ranked"))
    return ranked(a, "score", "place")
