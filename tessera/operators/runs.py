"""Masks as runs: rows (tissue_id, y, x0, x1) of pixels x0 to below x1 that are tissue, instead of a row a pixel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.tiles import grade

#: Runs are cut at multiples of this where pixels look for theirs.
CUT = 256


def of_pixels(mask: DataFrame) -> DataFrame:
    """The runs of mask(tissue_id, y, x), each pixel once."""
    nth = F.row_number().over(Window.partitionBy("tissue_id", "y").orderBy("x"))
    each = mask.select("tissue_id", "y", "x", (F.col("x") - nth).alias("__run"))
    return each.groupBy("tissue_id", "y", "__run").agg(F.min("x").alias("x0"), (F.max("x") + 1).alias("x1")).drop("__run")


def pixels(runs: DataFrame) -> DataFrame:
    """(tissue_id, y, x) of the runs."""
    return runs.select("tissue_id", "y", F.explode(F.sequence(F.col("x0"), F.col("x1") - 1)).alias("x"))


def sizes(runs: DataFrame) -> DataFrame:
    """(tissue_id, h, w, total): extents up to the last pixel, and pixels."""
    return runs.groupBy("tissue_id").agg((F.max("y") + 1).alias("h"), F.max("x1").alias("w"), F.sum(F.col("x1") - F.col("x0")).alias("total"))


def _overlap(first: Column, last: Column) -> Column:
    return F.least(F.col("x1"), last) - F.greatest(F.col("x0"), first)


def grid_tiles(runs: DataFrame, tile: int, stride: int | None = None, tolerance: float = 0.85) -> DataFrame:
    """(tissue_id, tile_id, row, col, valid): the grid tiles of tiling.grid_tiles, from runs: a row for each run and tile that meet."""
    step = stride or tile
    if tile <= 0 or step <= 0 or not 0 <= tolerance < 1:
        raise ValueError("tile and stride must be positive and tolerance from 0 to below 1")

    def starts(first: Column, last: Column) -> Column:
        low = F.greatest(F.lit(0), F.ceil((first - tile + 1) / step).cast("int"))
        high = F.floor(last / step).cast("int")
        return F.when(low <= high, F.transform(F.sequence(low, high), lambda i: i * step)).otherwise(F.array().cast("array<int>"))

    met = runs.withColumn("row", F.explode(starts(F.col("y"), F.col("y")))).withColumn("col", F.explode(starts(F.col("x0"), F.col("x1") - 1)))
    held = met.withColumn("n", _overlap(F.col("col"), F.col("col") + tile)).where("n > 0")
    counts = held.groupBy("tissue_id", "row", "col").agg(F.sum("n").cast("int").alias("valid"))
    kept = counts.where(F.col("valid") / (tile * tile) >= 1 - tolerance)
    order = Window.partitionBy("tissue_id").orderBy("row", "col")
    return kept.withColumn("tile_id", F.row_number().over(order) - 1).select("tissue_id", "tile_id", "row", "col", "valid")


def valid_ratio(runs: DataFrame, coords: DataFrame, tile: int) -> DataFrame:
    """coords with valid_ratio and grade, as tiles.valid_ratio: runs are cut to the cells of a grid, an equi-join brings them to tiles."""
    cells = coords.withColumn("cy", F.explode(F.array_distinct(F.array(F.floor(F.col("row") / tile), F.floor((F.col("row") + tile - 1) / tile)))))
    cells = cells.withColumn("cx", F.explode(F.array_distinct(F.array(F.floor(F.col("col") / tile), F.floor((F.col("col") + tile - 1) / tile)))))
    cut = runs.withColumn("cy", F.floor(F.col("y") / tile)).withColumn("cx", F.explode(F.sequence(F.floor(F.col("x0") / tile), F.floor((F.col("x1") - 1) / tile))))
    cut = cut.withColumns({"x0": F.greatest("x0", F.col("cx") * tile), "x1": F.least("x1", (F.col("cx") + 1) * tile)})
    inside = (F.col("y") >= F.col("row")) & (F.col("y") < F.col("row") + tile)
    met = cut.join(cells, ["tissue_id", "cy", "cx"]).where(inside).withColumn("n", _overlap(F.col("col"), F.col("col") + tile)).where("n > 0")
    counts = met.groupBy("tissue_id", "tile_id").agg(F.sum("n").alias("n"))
    ratio = F.coalesce(F.col("n"), F.lit(0)) / (tile * tile)
    return coords.join(counts, ["tissue_id", "tile_id"], "left").withColumn("valid_ratio", ratio).withColumn("grade", grade(F.col("valid_ratio"))).drop("n")


def masked(rows: DataFrame, runs: DataFrame, cut: int = CUT) -> DataFrame:
    """rows(tissue_id, y, x, ...) that lie in a run: runs are cut at multiples of `cut`, so a pixel meets those of its stretch only."""
    columns = rows.columns
    parts = runs.select("tissue_id", "y", "x0", "x1", F.explode(F.sequence(F.floor(F.col("x0") / cut), F.floor((F.col("x1") - 1) / cut))).alias("__cx"))
    inside = (F.col("x") >= F.col("x0")) & (F.col("x") < F.col("x1"))
    return rows.withColumn("__cx", F.floor(F.col("x") / cut)).join(parts, ["tissue_id", "y", "__cx"]).where(inside).select(*columns)
