"""Covering a tissue mask with tiles: a fixed grid as a join, and a greedy cover per tissue."""

from __future__ import annotations

import heapq
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import ship_package
from tessera.sources.arrays import decoded_mask

#: What a greedy cover tells of each tile, and of its tissue in each of the tissue's rows.
TILE = "tile_id int, row int, col int, valid int, gain int, stop_reason string, covered long, total long, candidates int, h int, w int"
#: Rows of an image that are summed at once.
STRIP = 256
# Why a cover stopped, as the statistics files have it.
GRID_COMPLETE, EMPTY, NO_GAIN, ADAPTIVE, MOST, EXHAUSTED = "fixed_grid_complete", "empty_mask", "no_gain", "adaptive_stop", "max_tiles", "candidates_exhausted"


def candidate_starts(n: Column, tile: int, stride: int) -> Column:
    """0, stride, ... and the last start that fits; 0 alone if the tile is as long as n."""
    last = n - tile
    return F.when(last <= 0, F.array(F.lit(0))).otherwise(F.array_distinct(F.concat(F.sequence(F.lit(0), last, F.lit(stride)), F.array(last))))


def grid_extent(n: Column, tile: int, stride: int) -> Column:
    return F.when(n <= tile, F.lit(tile)).otherwise((F.ceil((n - tile) / stride) * stride + tile).cast("int"))


def sizes(mask: DataFrame, extents: DataFrame | None = None) -> DataFrame:
    """(tissue_id, h, w, total) of the masks.

    extents(tissue_id, h, w) are the masks' shapes, and name tissues whose masks are empty;
    without them a tissue's extent ends at its last pixel.
    """
    found = mask.groupBy("tissue_id").agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"), F.count("*").alias("total"))
    if extents is None:
        return found
    return extents.select("tissue_id", "h", "w").join(found.select("tissue_id", "total"), "tissue_id", "left").na.fill(0, ["total"])


def covering(mask: DataFrame, tile: int, stride: int) -> DataFrame:
    """mask with row and col of every grid tile that holds the pixel, without a range join."""

    def starts(at: str) -> Column:
        first = F.greatest(F.lit(0), F.ceil((F.col(at) - tile + 1) / stride).cast("int"))
        last = F.floor(F.col(at) / stride).cast("int")
        return F.when(first <= last, F.transform(F.sequence(first, last), lambda i: i * stride)).otherwise(F.array().cast("array<int>"))

    rows = mask.withColumn("row", F.explode(starts("y")))
    return rows.withColumn("col", F.explode(starts("x")))


def grid_tiles(mask: DataFrame, tile: int, stride: int | None = None, tolerance: float = 0.85) -> DataFrame:
    """(tissue_id, tile_id, row, col, valid): grid tiles with enough tissue, row by row.

    A tile needs a tissue pixel, and 1 - tolerance of its area at least.
    """
    if tile <= 0 or (stride is not None and stride <= 0) or not 0 <= tolerance < 1:
        raise ValueError("tile and stride must be positive and tolerance from 0 to below 1")
    counts = covering(mask, tile, stride or tile).groupBy("tissue_id", "row", "col").agg(F.count("*").cast("int").alias("valid"))
    kept = counts.where(F.col("valid") / (tile * tile) >= 1 - tolerance)
    order = Window.partitionBy("tissue_id").orderBy("row", "col")
    return kept.withColumn("tile_id", F.row_number().over(order) - 1).select("tissue_id", "tile_id", "row", "col", "valid")


def _with_overlap(rows: DataFrame, tile: int) -> DataFrame:
    """rows(num_tiles, covered, total) with what the tiles' areas and the covered pixels tell."""
    area = F.col("num_tiles") * tile * tile
    overlap = F.greatest(F.lit(0), area - F.col("covered"))
    return rows.withColumns({
        "tissue_mask_frac": F.col("total") / (F.col("h").cast("long") * F.col("w")),
        "coverage_ratio": F.when(F.col("total") == 0, 1.0).otherwise(F.col("covered") / F.col("total")),
        "covered_valid_pixels": F.col("covered"),
        "total_valid_pixels": F.col("total"),
        "total_tile_area": area,
        "overlap_pixels": overlap,
        "overlap_ratio": F.coalesce(F.try_divide(overlap, area), F.lit(0.0)),
        "mask_height": F.col("h"),
        "mask_width": F.col("w"),
    })


#: Columns of the statistics of any cover.
STATS = [
    "tissue_id", "mask_height", "mask_width", "tissue_mask_frac", "num_tiles", "coverage_ratio", "covered_valid_pixels", "total_valid_pixels",
    "candidate_count", "total_tile_area", "overlap_pixels", "overlap_ratio", "stop_reason",
]


def grid_stats(mask: DataFrame, tile: int, stride: int | None = None, tolerance: float = 0.85, extents: DataFrame | None = None) -> DataFrame:
    """Per tissue what the grid's tiles cover; an empty mask of `extents` is covered in full by no tile."""
    step = stride or tile
    tiles = grid_tiles(mask, tile, step, tolerance)
    counts = tiles.groupBy("tissue_id").agg(F.count("*").alias("num_tiles"), F.sum("valid").alias("covered"))
    if step < tile:  # tiles overlap: a pixel counts once
        held = covering(mask, tile, step).join(tiles.select("tissue_id", "row", "col"), ["tissue_id", "row", "col"], "left_semi")
        once = held.select("tissue_id", "y", "x").distinct().groupBy("tissue_id").agg(F.count("*").alias("covered"))
        counts = counts.drop("covered").join(once, "tissue_id")
    rows = sizes(mask, extents).join(counts, "tissue_id", "left").na.fill(0, ["num_tiles", "covered"])
    height, width = grid_extent(F.col("h"), tile, step), grid_extent(F.col("w"), tile, step)
    rows = _with_overlap(rows, tile).withColumns({
        "candidate_count": F.col("num_tiles"),
        "stop_reason": F.when(F.col("total") == 0, EMPTY).otherwise(GRID_COMPLETE),
        "padded_height": height,
        "padded_width": width,
        "grid_candidate_count": (((height - tile) / step + 1) * ((width - tile) / step + 1)).cast("int"),
    })
    return rows.select(*STATS, "grid_candidate_count", "padded_height", "padded_width")


def _starts(n: int, tile: int, stride: int) -> np.ndarray:
    return np.unique(np.append(np.arange(0, max(1, n - tile + 1), stride), max(0, n - tile)))


def _window_sums(values: np.ndarray, rows: np.ndarray, cols: np.ndarray, tile: int) -> np.ndarray:
    """Sums of tile x tile windows, from prefix sums of a strip of the image at a time along its rows, then of the windows' columns downwards."""
    down = np.zeros((len(values) + 1, len(cols)), np.int64)
    for top in range(0, len(values), STRIP):
        part = values[top : top + STRIP]
        sums = np.zeros((len(part), values.shape[1] + 1), np.int32)
        np.cumsum(part, axis=1, out=sums[:, 1:])
        down[top + 1 : top + 1 + len(part)] = sums[:, cols + tile] - sums[:, cols]
    np.cumsum(down, axis=0, out=down)
    return down[rows + tile] - down[rows]


class Cover(NamedTuple):
    """(row, col, valid, gain) of tiles in the order chosen, why it stopped, pixels covered, candidates at first."""

    tiles: list[tuple[int, int, int, int]]
    reason: str
    covered: int
    candidates: int


def greedy_cover(mask: np.ndarray, tile: int, stride: int, tolerance: float, goal: float, min_gain: float, max_tiles: int | None, overlap: bool) -> Cover:
    """Tiles each of which is the first with the largest gain, until the goal or nothing is left."""
    h, w = max(mask.shape[0], tile), max(mask.shape[1], tile)
    open_pixels = np.zeros((h, w), bool)
    open_pixels[: mask.shape[0], : mask.shape[1]] = mask
    total = int(open_pixels.sum())
    if not total:
        return Cover([], EMPTY, 0, 0)
    rows, cols = _starts(h, tile, stride), _starts(w, tile, stride)
    valid = _window_sums(open_pixels, rows, cols, tile)
    able = (valid > 0) & (valid / tile**2 >= 1 - tolerance)
    # gains only fall, so the top of the heap is the largest one if it is up to date; ties go to the first in order
    heap = [(-int(valid[i, j]), int(i), int(j)) for i, j in zip(*np.nonzero(able), strict=True)]
    heapq.heapify(heap)
    old, gone = np.zeros(able.shape, bool), np.zeros(able.shape, bool)
    chosen, covered, least, candidates = [], 0, int(np.ceil(min_gain * tile**2)), len(heap)
    while heap:
        gain, i, j = -heap[0][0], heap[0][1], heap[0][2]
        row, col = int(rows[i]), int(cols[j])
        if gone[i, j]:
            heapq.heappop(heap)
            continue
        if old[i, j]:
            old[i, j] = False
            heapq.heapreplace(heap, (-int(np.count_nonzero(open_pixels[row : row + tile, col : col + tile])), i, j))
            continue
        if gain <= 0:
            return Cover(chosen, NO_GAIN, covered, candidates)
        if (goal >= 1 or covered / total >= goal) and gain < least:
            return Cover(chosen, ADAPTIVE, covered, candidates)
        heapq.heappop(heap)
        chosen.append((row, col, int(valid[i, j]), gain))
        covered += gain
        open_pixels[row : row + tile, col : col + tile] = False
        near = (slice(*np.searchsorted(rows, (row - tile + 1, row + tile))), slice(*np.searchsorted(cols, (col - tile + 1, col + tile))))
        (old if overlap else gone)[near] = True
        if max_tiles is not None and len(chosen) >= max_tiles:
            return Cover(chosen, MOST, covered, candidates)
    return Cover(chosen, EXHAUSTED, covered, candidates)


class Greedy(NamedTuple):
    """How tiles are chosen: each the first with the largest gain, until what stops it."""

    tile: int
    stride: int | None = None
    tolerance: float = 0.2
    goal: float = 0.99
    min_gain: float = 0.05
    max_tiles: int | None = None
    overlap: bool = True

    @property
    def step(self) -> int:
        return self.stride or max(1, self.tile // 2)

    def check(self) -> None:
        if self.tile <= 0 or self.step <= 0 or not 0 <= self.tolerance <= 1 or not 0 <= self.min_gain <= 1:
            raise ValueError("tile and stride must be positive, tolerance and min_gain from 0 to 1")

    def rows(self, tissue: object, image: np.ndarray) -> pd.DataFrame:
        """One row for each tile, or one with a NULL tile_id if there is none."""
        cover = greedy_cover(image, self.tile, self.step, self.tolerance, self.goal, self.min_gain, self.max_tiles, self.overlap)
        made = pd.DataFrame(cover.tiles or [(None,) * 4], columns=["row", "col", "valid", "gain"]).astype("Int32")
        made.insert(0, "tissue_id", tissue)
        made.insert(1, "tile_id", pd.array(range(len(cover.tiles)) if cover.tiles else [None], "Int32"))
        h, w = image.shape
        return made.assign(stop_reason=cover.reason, covered=cover.covered, total=int(image.sum()), candidates=cover.candidates, h=h, w=w)


def greedy_tiles(mask: DataFrame, tile: int, stride: int | None = None, tolerance: float = 0.2, goal: float = 0.99, min_gain: float = 0.05, max_tiles: int | None = None, overlap: bool = True, extents: DataFrame | None = None) -> DataFrame:
    """Tiles of each tissue in the order chosen, of masks as pixels.

    The choice is sequential within a tissue, whose mask is one image; tissues are
    independent. extents(tissue_id, h, w) are the masks' shapes, else they end at their
    last pixels. `greedy_file_tiles` is the way for mask files, which need no shuffle.
    """
    how = Greedy(tile, stride, tolerance, goal, min_gain, max_tiles, overlap)
    how.check()
    ship_package(mask.sparkSession)
    kind = f"tissue_id {mask.schema['tissue_id'].dataType.simpleString()}, {TILE}"

    def cover(rows: pd.DataFrame, extent: pd.DataFrame | None = None) -> pd.DataFrame:
        if extent is None or not len(extent):
            h, w = int(rows.y.max()) + 1, int(rows.x.max()) + 1
        else:
            h, w = int(extent.h.iloc[0]), int(extent.w.iloc[0])
        image = np.zeros((h, w), bool)
        image[rows.y, rows.x] = True
        return how.rows((rows if len(rows) else extent).tissue_id.iloc[0], image)

    pixels = mask.select("tissue_id", "y", "x").groupBy("tissue_id")
    if extents is None:
        return pixels.applyInPandas(lambda rows: cover(rows), kind)
    return pixels.cogroup(extents.select("tissue_id", "h", "w").groupBy("tissue_id")).applyInPandas(cover, kind)


def greedy_file_tiles(files: DataFrame, **how) -> DataFrame:
    """The same of mask files(path, content): each is decoded and covered where it is read."""
    greedy = Greedy(**how)
    greedy.check()

    def run(batches):
        for batch in batches:
            for path, data in zip(batch.path, batch.content, strict=True):
                tissue, mask = decoded_mask(path, data)
                yield greedy.rows(tissue, np.asarray(mask) > 0)

    return files.select("path", "content").mapInPandas(run, f"tissue_id string, {TILE}")


def greedy_stats(rows: DataFrame, tile: int) -> DataFrame:
    """Per tissue what the tiles of a greedy cover add up to."""
    once = {"covered": "covered", "total": "total", "candidates": "candidate_count", "stop_reason": "stop_reason", "h": "h", "w": "w"}
    found = rows.groupBy("tissue_id").agg(F.count("tile_id").alias("num_tiles"), *[F.first(c).alias(name) for c, name in once.items()])
    return _with_overlap(found, tile).select(*STATS)


def integral_image(mask: DataFrame) -> DataFrame:
    """(tissue_id, y, x, total): pixels of the mask above and left of each, itself included."""
    size = sizes(mask)
    grid = size.select("tissue_id", F.explode(F.sequence(F.lit(0), F.col("h") - 1)).alias("y"), "w")
    grid = grid.select("tissue_id", "y", F.explode(F.sequence(F.lit(0), F.col("w") - 1)).alias("x"))
    filled = grid.join(mask.withColumn("one", F.lit(1)), ["tissue_id", "y", "x"], "left").na.fill(0, ["one"])
    along = Window.partitionBy("tissue_id", "y").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("tissue_id", "x").orderBy("y").rowsBetween(Window.unboundedPreceding, 0)
    return filled.withColumn("s", F.sum("one").over(along)).select("tissue_id", "y", "x", F.sum("s").over(down).alias("total"))


def run_summary(stats: DataFrame) -> DataFrame:
    return stats.agg(
        F.count("*").alias("tissues"), F.sum("num_tiles").alias("tiles"), F.avg("coverage_ratio").alias("mean_coverage"), F.stddev_pop("coverage_ratio").alias("std_coverage")
    )

