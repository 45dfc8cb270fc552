"""Summed areas of masks in two levels: within blocks, and over the blocks' sums.

The pixels above and left of a corner are those of whole blocks (`base`), of the block's rows in the
blocks to its left (`beside`), of its columns in the blocks above (`above`), and of the block itself
(`inner`). A block is a row with these, so a corner is one look-up by equi-join, and a rectangle four.
No window is longer than the blocks along an edge, and no row holds more than a block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import tiling
from tessera.session import ship_package

#: Rows and columns of a block.
BLOCK = 128


def _blocks(mask: DataFrame, block: int) -> DataFrame:
    """(tissue_id, by, bx, inner, rows, cols) of blocks with pixels: exclusive prefix sums over both axes, rows or columns."""
    kind = mask.schema["tissue_id"].dataType.simpleString()
    dealt = mask.select("tissue_id", F.floor(F.col("y") / block).cast("int").alias("by"), F.floor(F.col("x") / block).cast("int").alias("bx"), ((F.col("y") % block) * block + F.col("x") % block).cast("int").alias("at"))
    ints = pa.list_(pa.int32())

    def run(batches):
        for batch in batches:
            inner, rows, cols = [], [], []
            for held in batch.column("held"):
                image = np.zeros((block + 1, block + 1), np.int32)
                image[1:, 1:].flat[held.values.to_numpy()] = 1
                sums = image.cumsum(0).cumsum(1).astype(np.int32)
                inner.append(sums[:block, :block].ravel())
                # place block is the sum of all: what a block to the right, or below, adds
                rows.append(sums[:, block])
                cols.append(sums[block])
            made = [pa.array(part, ints) for part in (inner, rows, cols)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), *made], ["tissue_id", "by", "bx", "inner", "rows", "cols"])

    held = dealt.groupBy("tissue_id", "by", "bx").agg(F.collect_list("at").alias("held"))
    return held.mapInArrow(run, f"tissue_id {kind}, by int, bx int, inner array<int>, `rows` array<int>, cols array<int>")


def summed_areas(mask: DataFrame, extents: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """(tissue_id, by, bx, base, beside, above, inner) of all blocks of mask(tissue_id, y, x), each pixel once.

    extents(tissue_id, h, w) are the masks' shapes, which else end at their last pixels.
    """
    ship_package(mask.sparkSession)
    size = tiling.sizes(mask, extents)
    # one block more than needed along each edge, for corners at the end
    grid = size.select("tissue_id", F.explode(F.sequence(F.lit(0), F.floor(F.col("h") / block).cast("int"))).alias("by"), "w")
    grid = grid.select("tissue_id", "by", F.explode(F.sequence(F.lit(0), F.floor(F.col("w") / block).cast("int"))).alias("bx"))
    none = F.array_repeat(F.lit(0), block + 1)
    cells = grid.join(_blocks(mask, block), ["tissue_id", "by", "bx"], "left").withColumns({"rows": F.coalesce("rows", none), "cols": F.coalesce("cols", none)})

    def before(partition: list[str], order: str):
        return Window.partitionBy(*partition).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)

    def strips(array: str, partition: str, order: str, name: str) -> DataFrame:
        """Exclusive sums of the array's entries along the order, as an array of each cell again."""
        each = cells.select("tissue_id", "by", "bx", F.posexplode(array).alias("d", "n"))
        summed = each.withColumn("s", F.coalesce(F.sum("n").over(before(["tissue_id", partition, "d"], order)), F.lit(0)))
        return summed.groupBy("tissue_id", "by", "bx").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "s"))), lambda p: p["s"]).alias(name))

    beside, above = strips("rows", "by", "bx", "beside"), strips("cols", "bx", "by", "above")
    # the whole blocks above and left: what all rows of the blocks to the left hold, summed downwards
    whole = beside.select("tissue_id", "by", "bx", "beside", F.element_at("beside", -1).alias("all"))
    whole = whole.withColumn("base", F.coalesce(F.sum("all").over(before(["tissue_id", "bx"], "by")), F.lit(0))).drop("all")
    return whole.join(above, ["tissue_id", "by", "bx"]).join(cells.select("tissue_id", "by", "bx", "inner"), ["tissue_id", "by", "bx"])


def _total(block: int, y: str = "y", x: str = "x", prefix: str = ""):
    """Pixels above and left of the corner (y, x) of a block row."""
    dy, dx = (F.col(y) % block).cast("int"), (F.col(x) % block).cast("int")
    base, beside, above, inner = (f"{prefix}{n}" for n in ("base", "beside", "above", "inner"))
    return F.col(base) + F.get(beside, dy) + F.get(above, dx) + F.coalesce(F.get(inner, dy * block + dx), F.lit(0))


def rect_sums(rectangles: DataFrame, areas: DataFrame, extents: DataFrame, block: int = BLOCK) -> DataFrame:
    """rectangles(tissue_id, y0, x0, y1, x1, ...) with `pixels`, the mask's pixels in y0 to below y1, x0 to below x1.

    areas are summed_areas with the same block; what lies outside of the extents(tissue_id, h, w) has none,
    and neither have tissues that these lack. A rectangle goes from one corner's block to the next as one
    row, which is half of what four rows and their sum would shuffle.
    """
    columns = rectangles.columns
    known = rectangles.join(extents.select("tissue_id", F.col("h").alias("__h"), F.col("w").alias("__w")), "tissue_id", "left")

    def clipped(c: str, most: str):
        return F.greatest(F.lit(0), F.least(F.col(c), F.coalesce(F.col(most), F.lit(0))))

    known = known.withColumns({"__y0": clipped("y0", "__h"), "__y1": clipped("y1", "__h"), "__x0": clipped("x0", "__w"), "__x1": clipped("x1", "__w"), "__sum": F.lit(0).cast("long")})
    # dealt by the join's keys here, so that all four joins share one shuffle of the areas
    dealt = areas.select("tissue_id", *[F.col(c).alias(f"__{c}") for c in ("by", "bx", "base", "beside", "above", "inner")]).repartition("tissue_id", "__by", "__bx")
    for sign, y, x in ((1, "__y1", "__x1"), (-1, "__y0", "__x1"), (-1, "__y1", "__x0"), (1, "__y0", "__x0")):
        at = known.withColumns({"__by": F.floor(F.col(y) / block).cast("int"), "__bx": F.floor(F.col(x) / block).cast("int")})
        found = at.join(dealt, ["tissue_id", "__by", "__bx"], "left")
        known = found.select(*columns, "__y0", "__y1", "__x0", "__x1", (F.col("__sum") + sign * F.coalesce(_total(block, y, x, "__"), F.lit(0))).alias("__sum"))
    return known.select(*columns, F.col("__sum").alias("pixels"))


def integral_image(mask: DataFrame, extents: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """(tissue_id, y, x, total): pixels of the mask above and left of each, itself included, from the blocks."""
    size = tiling.sizes(mask, extents)
    areas = summed_areas(mask, size, block)
    # the corner below and right of a pixel: places 1 to block of a block are pixels 0 to block - 1 of it, one block on at the end
    spots = F.sequence(F.lit(0), F.lit(block - 1))
    each = areas.join(size.select("tissue_id", "h", "w"), "tissue_id").withColumn("dy", F.explode(spots)).withColumn("dx", F.explode(spots))
    each = each.withColumns({"y": F.col("by") * block + F.col("dy"), "x": F.col("bx") * block + F.col("dx")}).where("y > 0 and x > 0 and y <= h and x <= w")
    return each.select("tissue_id", (F.col("y") - 1).alias("y"), (F.col("x") - 1).alias("x"), _total(block).alias("total"))
