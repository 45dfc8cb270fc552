"""Neighbourhood filters on images of any size: chunks filtered alone, with a halo of their neighbours' pixels.

A pixel goes to its own chunk and, near a border, to the chunks whose halo it lies in, so one
shuffle brings a chunk and its halo together. The halo is as wide as all filters reach; what they
make up beyond a cut is trimmed with it. Where the image ends, a chunk's array ends too, and each
filter pads it there by its own rule, as it would the whole plane.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import kernels
from tessera.session import ship_package

#: How many pixels away a filter of kernels.FILTERS looks, by its name and arguments; register those of more filters here.
REACH: dict[str, Callable[..., int]] = {
    "median": lambda size=3, **more: size // 2,
    "gaussian": lambda size=3, **more: size // 2,
}
#: Rows and columns of a chunk.
CHUNK = 512


def halo(filters: list[tuple[str, dict]]) -> int:
    """The pixels around a chunk that the filters need one after another."""
    for name, _ in filters:
        if name not in kernels.FILTERS or name not in REACH:
            raise ValueError(f"no filter {name!r}; there are {sorted(set(kernels.FILTERS) & set(REACH))}")
    return sum(REACH[name](**more) for name, more in filters)


def filter_pixels(pixels: DataFrame, keys: list[str], filters: list[tuple[str, dict]], y: str = "y", x: str = "x", chunk: int = CHUNK) -> DataFrame:
    """(keys, y, x, value) with the filters applied in order to each plane of the keys.

    Planes are full rectangles of pixels, wherever they begin, each pixel once. No task holds more
    of a plane than a chunk and its halo.
    """
    reach = halo(filters)
    if chunk <= reach:
        raise ValueError("a chunk must be larger than what the filters reach")
    ship_package(pixels.sparkSession)

    def chunks(at: str) -> Column:
        return F.sequence(F.floor((F.col(at) - reach) / chunk), F.floor((F.col(at) + reach) / chunk))

    dealt = pixels.select(*keys, F.col(y).cast("int").alias("__y"), F.col(x).cast("int").alias("__x"), F.col("value").cast("double").alias("__value"))
    dealt = dealt.withColumn("__cy", F.explode(chunks("__y"))).withColumn("__cx", F.explode(chunks("__x")))
    kinds = ", ".join(f"`{k}` {pixels.schema[k].dataType.simpleString()}" for k in keys)

    # a row holds a chunk and its halo
    each = F.collect_list(F.struct("__y", "__x", "__value")).alias("__pixels")
    chunked = dealt.groupBy(*keys, "__cy", "__cx").agg(each)

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                held = batch.column("__pixels")[i].values
                ys, xs, values = (held.field(k).to_numpy(zero_copy_only=False) for k in range(3))
                top, left = ys.min(), xs.min()
                plane = np.full((ys.max() - top + 1, xs.max() - left + 1), np.nan)
                plane[ys - top, xs - left] = values
                cy, cx = batch.column("__cy")[i].as_py() * chunk, batch.column("__cx")[i].as_py() * chunk
                own = (slice(max(cy - top, 0), max(cy + chunk - top, 0)), slice(max(cx - left, 0), max(cx + chunk - left, 0)))
                if not plane[own].size:  # a halo without a chunk: the image ends before it
                    continue
                for name, more in filters:
                    plane = kernels.FILTERS[name](plane, **more)
                part = plane[own]
                py, px = np.indices(part.shape, np.int32)
                places = [pa.array((p.ravel() + o.start + first).astype(np.int32)) for p, o, first in ((py, own[0], top), (px, own[1], left))]
                same = pa.array(np.full(part.size, i, np.int64))
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(same) for k in keys), *places, pa.array(part.ravel())], [*keys, "__y", "__x", "__value"])

    made = chunked.mapInArrow(run, ", ".join([*([kinds] if keys else []), "__y int, __x int, __value double"]))
    return made.select(*keys, F.col("__y").alias(y), F.col("__x").alias(x), F.col("__value").alias("value"))
