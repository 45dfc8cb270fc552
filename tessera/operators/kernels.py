"""Neighbourhood filters and renderings of planes: numpy on Arrow batches, a plane a row."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import stats
from tessera.session import ship_package

#: Colours of up to five overlaid markers (fixed values).
MARKER_COLORS = [(1.00, 0.20, 0.20), (0.20, 1.00, 0.35), (0.25, 0.55, 1.00), (1.00, 0.85, 0.15), (1.00, 0.25, 0.95)]
PADDINGS = {"reflect": "reflect", "replicate": "edge", "constant": "constant"}


def median(plane: np.ndarray, size: int = 3, padding: str = "reflect") -> np.ndarray:
    """Median of each size x size neighbourhood; size is odd."""
    if size % 2 == 0 or padding not in PADDINGS:
        raise ValueError(f"size must be odd and padding one of {sorted(PADDINGS)}")
    wide = np.pad(plane, size // 2, mode=PADDINGS[padding])
    return np.median(np.lib.stride_tricks.sliding_window_view(wide, (size, size)), axis=(-2, -1))


def gaussian(plane: np.ndarray, size: int = 3, sigma: float = 1.0) -> np.ndarray:
    """Blur with a normalized discrete Gaussian and reflected borders."""
    at = np.arange(size) - (size - 1) / 2
    weights = np.exp(-0.5 * (at / sigma) ** 2)
    weights /= weights.sum()
    wide = np.pad(plane, size // 2, mode="reflect")
    rows = np.lib.stride_tricks.sliding_window_view(wide, size, axis=0) @ weights
    return np.lib.stride_tricks.sliding_window_view(rows, size, axis=1) @ weights


#: Filters by name; register more here.
FILTERS: dict[str, Callable[..., np.ndarray]] = {"median": median, "gaussian": gaussian}


def apply_filters(planes: DataFrame, filters: list[tuple[str, dict]], height: int | str, width: int | str, values: str = "values") -> DataFrame:
    """planes with its array column `values` (row by row) filtered by each filter in order.

    height and width are numbers, or the names of columns with them.
    """
    for name, _ in filters:
        if name not in FILTERS:
            raise ValueError(f"no filter {name!r}; there are {sorted(FILTERS)}")

    ship_package(planes.sparkSession)

    @F.pandas_udf("array<double>")
    def run(column: pd.Series, heights: pd.Series, widths: pd.Series) -> pd.Series:
        out = []
        for flat, h, w in zip(column, heights, widths, strict=True):
            plane = np.asarray(flat, float).reshape(h, w)
            for name, more in filters:
                plane = FILTERS[name](plane, **more)
            out.append(plane.ravel())
        return pd.Series(out)

    h, w = (F.col(n) if isinstance(n, str) else F.lit(n) for n in (height, width))
    return planes.withColumn(values, run(values, h, w))


def as_planes(pixels: DataFrame, keys: list[str], y: str = "y", x: str = "x") -> DataFrame:
    """(keys, top, left, h, w, values) of full rectangles of pixels, row by row."""
    each = F.array_sort(F.collect_list(F.struct(y, x, "value")))
    size = [(F.max(c) - F.min(c) + 1).alias(n) for c, n in ((y, "h"), (x, "w"))]
    return pixels.groupBy(*keys).agg(F.min(y).alias("top"), F.min(x).alias("left"), *size, F.transform(each, lambda p: p["value"]).alias("values"))


def as_pixels(planes: DataFrame, keys: list[str], y: str = "y", x: str = "x") -> DataFrame:
    """The pixels (keys, y, x, value) of such planes."""
    rows = planes.select(*keys, "top", "left", "w", F.posexplode("values").alias("at", "value"))
    return rows.select(*keys, (F.col("top") + F.floor(F.col("at") / F.col("w"))).cast("int").alias(y), (F.col("left") + F.col("at") % F.col("w")).cast("int").alias(x), "value")


def stretch(planes: DataFrame, keys: list[str], low: float = 0.01, high: float = 0.99, ranges: bool = False) -> DataFrame:
    """Pixels (keys, y, x, value) with `level`, 0 to 255 between two percentiles of the plane.

    With `ranges` no place holds a plane's distinct values; it takes one more scan.
    """
    if ranges:
        bounds = stats.range_quantiles(planes, keys, high, low).withColumnsRenamed({"lower": "lo", "upper": "hi"})
    else:
        bounds = planes.groupBy(*keys).agg(F.percentile("value", low).alias("lo"), F.percentile("value", high).alias("hi"))
    scaled = (F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo"))
    level = F.when(F.col("hi") > F.col("lo"), F.floor(F.least(F.greatest(scaled, F.lit(0.0)), F.lit(1.0)) * 255)).otherwise(0)
    return planes.join(bounds, keys).withColumn("level", level.cast("int")).drop("lo", "hi")


def overlay(levels: DataFrame, image: str, marker: str, pick: list[int]) -> DataFrame:
    """(image, y, x, red, green, blue) of up to five markers, added up in their colours; one alone is grey."""
    if len(pick[:5]) == 1:
        grey = levels.where(F.col(marker) == pick[0]).groupBy(image, "y", "x").agg(F.max("level").cast("int").alias("red"))
        return grey.withColumns({"green": F.col("red"), "blue": F.col("red")})
    places = F.create_map(*[F.lit(v) for i, m in enumerate(pick[:5]) for v in (m, i)])
    chosen = levels.withColumn("i", F.try_element_at(places, F.col(marker))).where("i is not null")

    def channel(k: int) -> Column:
        color = F.get(F.array(*[F.lit(c[k]) for c in MARKER_COLORS]), F.col("i"))
        return F.floor(F.least(F.round(F.sum(F.col("level") / 255 * color), 9), F.lit(1.0)) * 255).cast("int")

    return chosen.groupBy(image, "y", "x").agg(channel(0).alias("red"), channel(1).alias("green"), channel(2).alias("blue"))


def rgb_composite(levels: DataFrame, image: str, plane: str, planes: int) -> DataFrame:
    """(image, y, x, red, green, blue) of the first three planes; one plane gives grey, two repeat the last."""
    picked = [min(i, planes - 1) for i in range(3)]
    each = [F.max(F.when(F.col(plane) == p, F.col("level"))).cast("int").alias(n) for p, n in zip(picked, ("red", "green", "blue"), strict=True)]
    return levels.where(F.col(plane).isin(picked)).groupBy(image, "y", "x").agg(*each)


def png_images(pixels: DataFrame, image: str) -> DataFrame:
    """(image, png) of pixels (image, y, x, red, green, blue): each image, in one row, as PNG bytes."""
    ship_package(pixels.sparkSession)
    each = F.array_sort(F.collect_list(F.struct("y", "x", "red", "green", "blue")))
    flat = F.flatten(F.transform(each, lambda p: F.array(p["red"], p["green"], p["blue"])))
    rows = pixels.groupBy(image).agg(flat.alias("flat"), (F.max("y") - F.min("y") + 1).alias("h"), (F.max("x") - F.min("x") + 1).alias("w"))

    @F.pandas_udf("binary")
    def encoded(values: pd.Series, heights: pd.Series, widths: pd.Series) -> pd.Series:
        return pd.Series([png(np.asarray(v).reshape(h, w, 3)) for v, h, w in zip(values, heights, widths, strict=True)])

    return rows.select(image, encoded("flat", "h", "w").alias("png"))


def png(pixels: np.ndarray) -> bytes:
    """An 8-bit grey (h, w) or RGB (h, w, 3) image as PNG bytes."""
    h, w = pixels.shape[:2]
    raw = np.hstack([np.zeros((h, 1), np.uint8), pixels.reshape(h, -1).astype(np.uint8)]).tobytes()

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    head = struct.pack(">IIBBBBB", w, h, 8, 2 if pixels.ndim == 3 else 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def layout(pixels: DataFrame, channels_first: bool = True) -> DataFrame:
    """Flat values of each image, plane by plane or pixel by pixel."""
    order = ["channel_pos", "y", "x"] if channels_first else ["y", "x", "channel_pos"]
    each = F.array_sort(F.collect_list(F.struct(*order, "value")))
    return pixels.groupBy("tissue_id").agg(F.transform(each, lambda p: p["value"]).alias("values"))


def picked_markers(text: Column, markers: int) -> Column:
    """Up to five whole numbers of a comma-separated list, within the markers; bad ones are skipped."""
    numbers = F.filter(F.transform(F.split(text, ","), lambda t: F.trim(t).try_cast("int")), lambda v: v.isNotNull())
    some = F.when(F.coalesce(F.size(numbers), F.lit(0)) > 0, numbers).otherwise(F.array(F.lit(0)))
    return F.transform(F.slice(some, 1, 5), lambda v: F.greatest(F.lit(0), F.least(F.lit(markers - 1), v)))
