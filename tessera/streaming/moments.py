"""Moments of channels over an unbounded stream of pixels.

The sums of values, of squares and of pixels can be added up, so each trigger only updates
them. Quantiles, which clip the pixels, come from an earlier batch job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import stats


def running_moments(pixels: DataFrame, bounds: DataFrame, quantile_level: str = "image", spec: str = "quantile_clipping") -> DataFrame:
    """(channel, mean, std, n), for output modes update and complete."""
    z = stats.transformed(pixels, bounds, quantile_level, spec)
    return z.groupBy("channel").agg(F.avg("z").alias("mean"), F.stddev_pop("z").alias("std"), F.count("z").alias("n"))


def windowed_counts(pixels: DataFrame, time: str, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Pixels of each channel in time windows, late ones up to a limit."""
    return pixels.withWatermark(time, late).groupBy(F.window(time, length), "channel").agg(F.count("*").alias("n"))
