"""Whole jobs that write results in the layout that readers expect."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import states, stats, tiling
from tessera.sources import catalog


def write_new(tables: dict[str, DataFrame], overwrite: bool = False) -> list[str]:
    """Write each table to its path unless all of them are there; returns what was written.

    Where only some are there, those stay and the others are written, unless asked to
    overwrite. Each table appears as a whole: it is written beside its path and moved.
    """
    spark = next(iter(tables.values())).sparkSession
    missing = [path for path in tables if overwrite or not catalog.exists(spark, path)]
    for path in missing:
        catalog.replace(spark, tables[path], path)
    return missing


def compute_statistics(pixels: DataFrame, root: str, channels: list[str], upper: float = 0.99, lower: float | None = None, quantile_level: str = "image", stats_level: str = "image", method: str = "quantile_clipping", overwrite: bool = False, ranges: bool | None = None) -> list[str]:
    """Quantiles, then means and deviations of the clipped pixels, a wide file for each.

    `ranges` as for stats.quantiles: set it for large images of real numbers.
    """
    # a row for each image and channel, which several files are written from: the pixels are scanned for each once
    bounds = stats.quantiles(pixels, quantile_level, upper, lower, ranges=ranges).persist(StorageLevel.MEMORY_AND_DISK)
    found = stats.moments(pixels, bounds, quantile_level, stats_level, method).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return _write_statistics(bounds, found, root, channels, upper, lower, quantile_level, stats_level, method, overwrite)
    finally:
        found.unpersist()
        bounds.unpersist()


def update_statistics(counts: states.PixelCounts, root: str, channels: list[str], upper: float = 0.99, lower: float | None = None, quantile_level: str = "image", stats_level: str = "image", method: str = "quantile_clipping") -> list[str]:
    """The same files from the counts that there are, in the place of those from fewer tissues."""
    held = counts.table()
    bounds = states.quantiles(held, quantile_level, upper, lower)
    found = states.moments(held, bounds, quantile_level, stats_level, method)
    return _write_statistics(bounds, found, root, channels, upper, lower, quantile_level, stats_level, method, True)


def _write_statistics(bounds: DataFrame, found: DataFrame, root: str, channels: list[str], upper: float, lower: float | None, quantile_level: str, stats_level: str, method: str, overwrite: bool) -> list[str]:
    folder = f"{root}/standardization/{catalog.spec_dir(method, upper, lower, quantile_level)}"

    def wide(df: DataFrame, value: str, level: str) -> DataFrame:
        if level == "image":
            return stats.wide(df, value, channels).orderBy("tissue_id")
        return stats.wide(df.selectExpr("'all' AS tissue_id", "*"), value, channels).drop("tissue_id")

    tables = {f"{folder}/{quantile_level}_level_upper_quantiles.parquet": wide(bounds, "upper", quantile_level)}
    if lower is not None:
        tables[f"{folder}/{quantile_level}_level_lower_quantiles.parquet"] = wide(bounds, "lower", quantile_level)
    for name, value in (("means", "mean"), ("stds", "std")):
        tables[f"{folder}/{stats_level}_level_{name}.parquet"] = wide(found, value, stats_level)
    return write_new(tables, overwrite)


def compute_tiling(mask: DataFrame, root: str, resolution: float, size: int, strategy: str = "grid", stride: int | None = None, tolerance: float = 0.85, overwrite: bool = False, goal: float = 1.0, min_gain: float = 0.05, extents: DataFrame | None = None, files: DataFrame | None = None, **greedy) -> list[str]:
    """Coordinates and statistics of a grid, or of the greedy cover for any other strategy.

    extents(tissue_id, h, w) are the masks' shapes. A greedy cover takes mask files(path,
    content) instead of the pixels where they are given, and so needs no shuffle. The
    strategy named default has no tiles of its own: readers slice it freely.
    """
    if strategy == "default":
        raise ValueError("the default strategy can't be tiled")
    path = f"{root}/tiling/{catalog.resolution_dir(resolution)}/{strategy}/{size}_tile"
    if strategy == "grid":
        step = stride or size
        coords, found = tiling.grid_tiles(mask, size, step, tolerance), tiling.grid_stats(mask, size, step, tolerance, extents)
    else:
        step = stride or max(1, size // 2)
        how = {"tile": size, "stride": step, "tolerance": tolerance, "goal": goal, "min_gain": min_gain, **greedy}
        rows = tiling.greedy_tiles(mask, extents=extents, **how) if files is None else tiling.greedy_file_tiles(files, **how)
        coords, found = rows.where("tile_id is not null"), tiling.greedy_stats(rows, size)
    parameters = {"tile_size": F.lit(size), "stride": F.lit(step), "tolerance": F.lit(float(tolerance)), "coverage_goal": F.lit(float(goal)), "min_gain_ratio": F.lit(float(min_gain)), "tiling_method": F.lit(strategy)}
    tables = {
        f"{path}_coordinates.parquet": coords.select("tissue_id", "tile_id", "row", "col"),
        f"{path}_stats.parquet": found.withColumns(parameters).orderBy("tissue_id"),
    }
    return write_new(tables, overwrite)
