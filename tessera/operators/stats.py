"""Quantiles, clipped moments and standardization of pixels, as plain aggregates and columns.

Pixels are rows (tissue_id, channel, pix, value). Missing statistics are NULL; NaN and
infinite ones count as missing.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPSILON = 1e-8
LEVELS = {"image": ["tissue_id", "channel"], "global": ["channel"]}


def finite(value: Column) -> Column:
    """The value, or NULL for NaN and the infinities."""
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def quantiles(pixels: DataFrame, level: str, upper: float = 0.99, lower: float | None = None, accuracy: int | None = None, ranges: bool | None = None) -> DataFrame:
    """Exact linear-interpolated quantiles by tissue and channel (image) or channel (global).

    By ranges of values no place holds a group's distinct values; that takes two scans. It is
    the way of the global level; the image level takes one scan, and an image's distinct
    values of a channel meet in one place, unless `ranges` is set, for large images of reals.
    `accuracy` asks for the mergeable approximate ones.
    """
    if accuracy is None and (level == "global" if ranges is None else ranges):
        return range_quantiles(pixels, LEVELS[level], upper, lower)
    rank = F.percentile if accuracy is None else lambda c, p: F.percentile_approx(c, p, accuracy)
    value = finite(F.col("value").cast("double"))
    low = rank(value, lower) if lower is not None else F.lit(None).cast("double")
    return pixels.groupBy(*LEVELS[level]).agg(rank(value, upper).alias("upper"), low.alias("lower"))


#: Ranges that the values between a power of two and the next are counted by.
RANGES = 256
#: Below the exponent of every double.
LEAST_EXPONENT = 1100


def value_range(value: Column) -> Column:
    """The number of a value's range: it never falls as values grow, and is 0 for zeros only.

    Equal steps of the logarithm, mirrored for negative values. Strict logarithms don't fall
    as their argument grows, and neither does anything that is done with them here.
    """
    steps = F.floor((F.log2(F.abs(value)) + LEAST_EXPONENT) * RANGES)
    return F.coalesce(F.signum(value) * steps, value * 0).cast("long")


def range_quantiles(pixels: DataFrame, keys: list[str], upper: float, lower: float | None = None, weight: str | None = None) -> DataFrame:
    """The same exact quantiles for large groups: no task sees all of one.

    `weight` names the column that says how many pixels a row stands for.

    Counts by ranges of values say which ranges hold the wanted ranks; only the values of
    those are counted one by one and put in order. Both steps are scans with partial
    aggregation; between them travel a row for each group and range, and the distinct values
    of two or four ranges. The ranges wanted are broadcast where the groups are channels;
    by other keys, whose number grows, the join is left to their size.
    """
    several = [] if weight is None else [F.col(weight).alias("weight")]
    held_by = F.count("*") if weight is None else F.sum("weight")
    rows = pixels.select(*keys, finite(F.col("value").cast("double")).alias("value"), *several).withColumn("range", value_range(F.col("value")))
    counts = rows.groupBy(*keys, "range").agg(held_by.alias("n"))
    known = F.when(F.col("range").isNotNull(), F.col("n"))
    before = Window.partitionBy(*keys).orderBy(F.asc_nulls_first("range")).rowsBetween(Window.unboundedPreceding, -1)
    placed = counts.withColumns({"before": F.coalesce(F.sum(known).over(before), F.lit(0)), "total": F.sum(known).over(Window.partitionBy(*keys))})

    def position(p: float) -> Column:
        return F.lit(p) * (F.col("total") - 1)

    ends = {f"{name}_{end}": at(position(p)) for name, p in (("upper", upper), ("lower", lower)) if p is not None for end, at in (("lo", F.floor), ("hi", F.ceil))}
    holds = [(F.col(e) >= F.col("before")) & (F.col(e) < F.col("before") + F.col("n")) for e in ends]
    held = F.col("range").isNotNull() & functools.reduce(Column.__or__, holds)
    # A group without any value has a row too, with nothing to look for.
    wanted = placed.withColumns(ends).where(held | F.col("total").isNull()).drop("n")
    few = F.broadcast(wanted) if keys == LEVELS["global"] else wanted
    values = rows.where("range is not null").join(few.where("range is not null"), [*keys, "range"]).groupBy(*keys, "range", "value", "before", "total", *ends).agg(held_by.alias("n"))
    upto = F.col("before") + F.sum("n").over(Window.partitionBy(*keys, "range").orderBy("value"))
    ordered = values.withColumn("upto", upto).withColumn("from", F.col("upto") - F.col("n"))
    found = ordered.groupBy(*keys, "total").agg(*[F.max(F.when((F.col(e) >= F.col("from")) & (F.col(e) < F.col("upto")), F.col("value"))).alias(e) for e in ends])

    def interpolated(name: str, p: float | None) -> Column:
        if p is None:
            return F.lit(None).cast("double")
        at, lo, hi = position(p), F.floor(position(p)), F.ceil(position(p))
        between = (hi - at) * F.col(f"{name}_lo") + (at - lo) * F.col(f"{name}_hi")
        # Between equal values there is nothing to weigh, and weights may miss 1 by a rounding.
        return F.when((lo == hi) | (F.col(f"{name}_lo") == F.col(f"{name}_hi")), F.col(f"{name}_lo")).otherwise(between)

    made = found.select(*keys, interpolated("upper", upper).alias("upper"), interpolated("lower", lower).alias("lower"))
    nothing = wanted.where("total is null").select(*keys, *[F.lit(None).cast("double").alias(n) for n in ("upper", "lower")])
    return made.unionByName(nothing)


def clip(value: Column, lower: Column, upper: Column) -> Column:
    """NULL in, NULL out; the floor is 0 where there is no lower quantile."""
    low = F.coalesce(lower, F.lit(0.0))
    return F.when(value.isNotNull() & upper.isNotNull(), F.least(F.greatest(value, low), upper))


def clip_rescale(value: Column, lower: Column, upper: Column) -> Column:
    low = F.coalesce(lower, F.lit(0.0))
    return (clip(value, lower, upper) - low) / (upper - low + EPSILON)


def clip_log1p(value: Column, lower: Column, upper: Column) -> Column:
    return F.log1p(clip(value, lower, upper))


def identity(value: Column, lower: Column, upper: Column) -> Column:
    return value.cast("double")


#: Transforms by the first part of a specification; register more here.
TRANSFORMS: dict[str, Callable[[Column, Column, Column], Column]] = {
    "identity": identity,
    "quantile_clipping": clip_rescale,
    "quantile_clipping_log1p": clip_log1p,
}


def transform_named(spec: str) -> Callable[[Column, Column, Column], Column]:
    name = spec.split("/")[0]
    if name not in TRANSFORMS:
        raise NotImplementedError(f"no transform {name!r}; there are {sorted(TRANSFORMS)}")
    return TRANSFORMS[name]


def transformed(pixels: DataFrame, bounds: DataFrame, level: str, spec: str) -> DataFrame:
    """pixels with z, the transformed value; channels without an upper quantile drop out."""
    joined = pixels.join(bounds.where("upper is not null"), LEVELS[level])
    return joined.withColumn("z", transform_named(spec)(F.col("value").cast("double"), F.col("lower"), F.col("upper")))


def moments(pixels: DataFrame, bounds: DataFrame, quantile_level: str, stats_level: str, spec: str = "quantile_clipping") -> DataFrame:
    """Mean and population deviation of the transformed pixels, by tissue and channel or channel."""
    z = transformed(pixels, bounds, quantile_level, spec)
    return z.groupBy(*LEVELS[stats_level]).agg(F.avg("z").alias("mean"), F.stddev_pop("z").alias("std"), F.count("z").alias("n"))


def moments_by_level(pixels: DataFrame, bounds: DataFrame, quantile_level: str, spec: str = "quantile_clipping") -> dict[str, DataFrame]:
    """`moments` of both levels from one scan: those of a channel are put together from those of its images."""
    image = moments(pixels, bounds, quantile_level, "image", spec)
    # Images without a value have no mean, and 0 values: they add nothing to the sums.
    n, means = F.nullif(F.sum("n"), F.lit(0)), Window.partitionBy("channel")
    whole = F.sum(F.col("mean") * F.col("n")).over(means) / F.nullif(F.sum("n").over(means), F.lit(0))
    apart = image.withColumn("whole", whole)
    around = F.sum((F.pow("std", F.lit(2.0)) + F.pow(F.col("mean") - F.col("whole"), F.lit(2.0))) * F.col("n"))
    together = apart.groupBy("channel").agg(F.first("whole").alias("mean"), F.sqrt(around / n).alias("std"), F.sum("n").alias("n"))
    return {"image": image, "global": together}


def valid_stats(upper: Column, lower: Column, mean: Column, std: Column) -> Column:
    """A usable channel: upper and std positive, mean finite, lower finite where there is one."""
    present = lambda c: finite(c).isNotNull()
    return present(upper) & (upper > 0) & (lower.isNull() | present(lower)) & present(mean) & present(std) & (std > 0)


def standardize(pixels: DataFrame, bounds: DataFrame, stats: DataFrame, quantile_level: str, stats_level: str, spec: str = "quantile_clipping", z_score: bool = True) -> DataFrame:
    """pixels with `standardized`; channels with unusable statistics drop out."""
    z = transformed(pixels, bounds, quantile_level, spec).join(stats.select(*LEVELS[stats_level], "mean", "std"), LEVELS[stats_level])
    z = z.where(valid_stats(F.col("upper"), F.col("lower"), F.col("mean"), F.col("std")))
    return z.withColumn("standardized", (F.col("z") - F.col("mean")) / (F.col("std") + EPSILON) if z_score else F.col("z"))


def wide(stats: DataFrame, value: str, channels: list[str]) -> DataFrame:
    """One column for each channel, as the statistics files have it; missing ones are NULL."""
    return stats.groupBy("tissue_id").pivot("channel", channels).agg(F.first(value))


#: RGB normalization presets: means and deviations of red, green and blue (fixed values).
RGB_PRESETS = {
    "imagenet": ([0.485, 0.456, 0.406], [0.229, 0.224, 0.225]),
    "hibou": ([0.7068, 0.5755, 0.722], [0.195, 0.2316, 0.1816]),
    "identity": ([0.0, 0.0, 0.0], [1.0, 1.0, 1.0]),
}


def rgb_preprocess(value: Column, channel: Column, preset: str) -> Column:
    """Values of 0 to 255 to units of the preset, by channel 0, 1 or 2."""
    mean, std = (F.array(*[F.lit(v) for v in part]) for part in RGB_PRESETS[preset])
    return (value / 255 - F.get(mean, channel)) / F.get(std, channel)
