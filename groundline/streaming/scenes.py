"""Per-scene masked summaries of a stream of pixels, kept in windows of event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import raster
from ..operators import stats


def stream_summary(pixels: DataFrame, time: str = "ts", window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """scene_id, window, and the index's mean, extremes and count; works on batches as well.

    Pixels later than the watermark are left out, and a window's state goes with it.
    """
    s = stats.summary(raster.ndvi(F.col("nir"), F.col("red")))
    a = pixels.withWatermark(time, late).groupBy("scene_id", F.window(time, window))
    return a.agg(s["mean"].alias("mean"), s["min"].alias("min"), s["max"].alias("max"), s["n"].alias("n"))
