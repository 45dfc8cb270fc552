"""Reading tiles: which pixels lie in which tile, padded crops, hit tests and tile quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.metadata import drawn


def in_bounds(coords: DataFrame, sizes: DataFrame, tile: int) -> DataFrame:
    """coords of tiles that lie within their tissue's (h, w)."""
    inside = (F.col("row") >= 0) & (F.col("col") >= 0) & (F.col("row") + tile <= F.col("h")) & (F.col("col") + tile <= F.col("w"))
    return coords.join(sizes.select("tissue_id", "h", "w"), "tissue_id").where(inside).drop("h", "w")


def containing(points: DataFrame, coords: DataFrame, tile: int) -> DataFrame:
    """points(tissue_id, y, x) with each tile of coords that holds them.

    A containment join as an equi-join: a tile meets at most four cells of a grid with the
    tile's size, so tiles go to those cells and points to their own.
    """
    cells = coords.withColumns({
        "cy": F.explode(F.array_distinct(F.array(F.floor(F.col("row") / tile), F.floor((F.col("row") + tile - 1) / tile)))),
    }).withColumns({
        "cx": F.explode(F.array_distinct(F.array(F.floor(F.col("col") / tile), F.floor((F.col("col") + tile - 1) / tile)))),
    })
    located = points.withColumns({"cy": F.floor(F.col("y") / tile), "cx": F.floor(F.col("x") / tile)})
    inside = (F.col("y") >= F.col("row")) & (F.col("y") < F.col("row") + tile) & (F.col("x") >= F.col("col")) & (F.col("x") < F.col("col") + tile)
    return located.join(cells, ["tissue_id", "cy", "cx"]).where(inside).drop("cy", "cx")


def valid_ratio(mask: DataFrame, coords: DataFrame, tile: int) -> DataFrame:
    """coords with valid_ratio, the share of tissue pixels, and its grade."""
    counts = containing(mask, coords, tile).groupBy("tissue_id", "tile_id").agg(F.count("*").alias("n"))
    ratio = F.coalesce(F.col("n"), F.lit(0)) / (tile * tile)
    return coords.join(counts, ["tissue_id", "tile_id"], "left").withColumn("valid_ratio", ratio).withColumn("grade", grade(F.col("valid_ratio"))).drop("n")


def grade(ratio: Column) -> Column:
    return F.when(ratio >= 0.5, "good").when(ratio >= 0.2, "warn").otherwise("none")


def ratio_histogram(ratios: DataFrame, bins: int = 20) -> DataFrame:
    """Counts of valid ratios in equal bins; the last one holds 1."""
    at = F.least(F.lit(bins - 1), F.floor(F.col("valid_ratio") * bins)).cast("int")
    return ratios.groupBy(at.alias("bin")).agg(F.count("*").alias("tiles"))


def ratio_summary(ratios: DataFrame) -> DataFrame:
    """Tiles and their mean valid ratio."""
    return ratios.agg(F.count("*").alias("tiles"), F.avg("valid_ratio").alias("mean_ratio"))


def hit(points: DataFrame, coords: DataFrame, tile: int) -> DataFrame:
    """For each point(point_id, tissue_id, y, x) the first tile of the list that holds it."""
    first = Window.partitionBy("point_id").orderBy("tile_id")
    return containing(points, coords, tile).withColumn("k", F.row_number().over(first)).where("k = 1").select("point_id", "tissue_id", "tile_id")


def crop(pixels: DataFrame, coords: DataFrame, tile: int, padded: bool = True) -> DataFrame:
    """Values of each tile, (tissue_id, tile_id, dy, dx, value).

    Padded crops have every pixel of the tile, 0 where the image has none; others only the
    pixels that are there, so tiles at a border are cut short.
    """
    held = containing(pixels, coords, tile).select("tissue_id", "tile_id", (F.col("y") - F.col("row")).alias("dy"), (F.col("x") - F.col("col")).alias("dx"), "value")
    if not padded:
        return held
    steps = F.sequence(F.lit(0), F.lit(tile - 1))
    full = coords.select("tissue_id", "tile_id", F.explode(steps).alias("dy")).select("*", F.explode(steps).alias("dx"))
    return full.join(held, ["tissue_id", "tile_id", "dy", "dx"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))


def by_ordinal(coords: DataFrame, ordinal: int) -> DataFrame:
    """The tile at a place of each tissue's sorted list, which need not be its tile_id."""
    if ordinal < 0:
        raise ValueError("ordinals are from 0")
    place = F.row_number().over(Window.partitionBy("tissue_id").orderBy("tile_id")) - 1
    return coords.withColumn("place", place).where(F.col("place") == ordinal).drop("place")


def validated(coords: DataFrame) -> DataFrame:
    """Coordinates with the columns that readers need; `lists` puts a tissue's in order."""
    missing = {"tissue_id", "tile_id", "row", "col"} - set(coords.columns)
    if missing:
        raise ValueError(f"tile coordinates lack {sorted(missing)}")
    return coords


def lists(coords: DataFrame) -> DataFrame:
    """Per tissue its tiles in order."""
    each = F.sort_array(F.collect_list(F.struct("tile_id", "row", "col")))
    return coords.groupBy("tissue_id").agg(each.alias("tiles"))


def random_tiles(sizes: DataFrame, tile: int, seed: int) -> DataFrame:
    """A reproducible offset for tissues without coordinates, any that fits, the last included."""

    def offset(n: str, what: str) -> Column:
        room = F.greatest(F.col(n) - tile + 1, F.lit(1))
        return (drawn(["tissue_id", F.lit(what)], seed) % room).cast("int")

    return sizes.select("tissue_id", offset("h", "row").alias("row"), offset("w", "col").alias("col"))
