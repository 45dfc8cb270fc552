"""What lets images grow: chunks with halos, runs, blocked summed areas, the lazy greedy cover."""

from __future__ import annotations

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import index, kernels, runs, stencil, summed, tiles, tiling
from tessera.sources import arrays


def pixels_of(spark, planes, top=0, left=0):
    rows = [(k, y + top, x + left, float(v)) for k, plane in planes.items() for (y, x), v in np.ndenumerate(plane)]
    return spark.createDataFrame(rows, "plane string, y int, x int, value double")


CHAINS = [
    [("median", {"size": 3, "padding": p})] for p in ("reflect", "replicate", "constant")
] + [[("gaussian", {"size": 5, "sigma": 1.3})], [("median", {"size": 5}), ("gaussian", {})], [("gaussian", {}), ("median", {"padding": "replicate"}), ("gaussian", {"size": 5})]]


@pytest.mark.parametrize("filters", CHAINS)
def test_chunks_with_halos_equal_whole_planes(spark, filters):
    rng = np.random.default_rng(1)
    planes = {"a": rng.normal(size=(17, 23)), "b": rng.normal(size=(8, 9)), "c": rng.normal(size=(16, 7))}
    for chunk, top, left in ((5, 0, 0), (8, 3, -11), (64, 1, 1)):
        made = stencil.filter_pixels(pixels_of(spark, planes, top, left), ["plane"], filters, chunk=chunk)
        got = {(r.plane, r.y - top, r.x - left): r.value for r in made.collect()}
        want = {}
        for k, plane in planes.items():
            for name, more in filters:
                plane = kernels.FILTERS[name](plane, **more)
            want |= {(k, y, x): v for (y, x), v in np.ndenumerate(plane)}
        assert got.keys() == want.keys()
        assert max(abs(got[k] - want[k]) for k in want) < 1e-12


def test_no_row_holds_more_than_a_chunk_and_its_halo(spark, monkeypatch):
    seen = []
    plane = np.arange(40 * 40, dtype=float).reshape(40, 40)
    made = stencil.filter_pixels(pixels_of(spark, {None: plane}), ["plane"], [("median", {})], chunk=8)
    assert made.count() == 1600  # a null key is one as well
    held = pixels_of(spark, {"a": plane}).withColumn("cy", F.explode(F.sequence(F.floor((F.col("y") - 1) / 8), F.floor((F.col("y") + 1) / 8))))
    seen = held.withColumn("cx", F.explode(F.sequence(F.floor((F.col("x") - 1) / 8), F.floor((F.col("x") + 1) / 8)))).groupBy("cy", "cx").count().agg(F.max("count")).first()[0]
    assert seen == 100
    assert stencil.filter_pixels(pixels_of(spark, {"a": plane}).where("false"), ["plane"], [("median", {})]).collect() == []
    with pytest.raises(ValueError, match="no filter"):
        stencil.filter_pixels(pixels_of(spark, {"a": plane}), ["plane"], [("nope", {})])
    with pytest.raises(ValueError, match="larger"):
        stencil.filter_pixels(pixels_of(spark, {"a": plane}), ["plane"], [("median", {"size": 9})], chunk=4)


@pytest.fixture(scope="module")
def blobs():
    """Masks with long runs, one of single pixels, an empty one."""
    y, x = np.indices((60, 70))
    disc = (y - 30) ** 2 + (x - 35) ** 2 < 700
    return {"disc": disc, "two": disc & (abs(x - 35) > 4), "dots": (y + x) % 2 == 0, "none": np.zeros((9, 9), bool)}


@pytest.fixture(scope="module")
def files(spark, blobs, tmp_path_factory):
    folder = tmp_path_factory.mktemp("masks")
    for name, mask in blobs.items():
        np.savez(folder / f"{name}.npz", mask=mask.astype(np.uint8) * 3)
    return str(folder)


def test_runs_of_files_are_those_of_pixels(spark, blobs, files, monkeypatch):
    monkeypatch.setattr(arrays, "TOGETHER", 500)
    found, mask = arrays.mask_runs(spark, files), arrays.masks(spark, files)
    got = sorted(map(tuple, found.collect()))
    assert got == sorted(map(tuple, runs.of_pixels(mask).select("tissue_id", "y", "x0", "x1").collect()))
    assert sorted(map(tuple, runs.pixels(found).collect())) == sorted(map(tuple, mask.collect()))
    assert {tuple(r) for r in runs.sizes(found).collect()} == {tuple(r) for r in tiling.sizes(mask).collect()}
    long = [r for r in got if r[0] == "disc"]
    assert len(long) * 30 < blobs["disc"].sum()  # rows fall by the length of a run
    known = arrays.mask_sizes(spark, files)
    sizes = spark.createDataFrame([("disc", 60, 70), ("none", 9, 9), ("new", 2, 5)], "tissue_id string, h int, w int")
    more = arrays.runs_or_full(found, known, sizes).where("tissue_id in ('new', 'none')")
    assert sorted(map(tuple, more.collect())) == [("new", 0, 0, 5), ("new", 1, 0, 5)]


@pytest.mark.parametrize(("tile", "stride"), [(8, 8), (9, 4), (7, 10), (100, 100)])
def test_tiles_of_runs_equal_those_of_pixels(spark, files, tile, stride):
    found, mask = arrays.mask_runs(spark, files), arrays.masks(spark, files)
    want = tiling.grid_tiles(mask, tile, stride, 0.9)
    got = runs.grid_tiles(found, tile, stride, 0.9)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    coords = want.select("tissue_id", "tile_id", F.col("row") - 2, F.col("col") + 3).toDF("tissue_id", "tile_id", "row", "col")
    ratios = [sorted((r.tissue_id, r.tile_id, round(r.valid_ratio, 9), r.grade) for r in part.valid_ratio(m, coords, tile).collect()) for part, m in ((runs, found), (tiles, mask))]
    assert ratios[0] == ratios[1]


def test_pixels_inside_runs(spark, files):
    found, mask = arrays.mask_runs(spark, files), arrays.masks(spark, files)
    every = spark.range(70).selectExpr("cast(id as int) as x").crossJoin(spark.range(60).selectExpr("cast(id as int) as y")).crossJoin(spark.createDataFrame([("disc",), ("two",), ("none",)], "tissue_id string"))
    got = runs.masked(every.select("tissue_id", "y", "x", F.lit(1).alias("value")), found, cut=16)
    assert got.columns == ["tissue_id", "y", "x", "value"]
    assert sorted(tuple(r)[:3] for r in got.collect()) == sorted(map(tuple, mask.where("tissue_id <> 'dots'").collect()))


@pytest.mark.parametrize("block", [4, 16, 64])
def test_rectangles_from_blocked_sums(spark, blobs, files, block):
    mask, extents = arrays.masks(spark, files), arrays.mask_sizes(spark, files)
    rng = np.random.default_rng(block)
    rects = [(str(t), *map(int, rng.integers(-5, 80, 2)), *map(int, rng.integers(0, 40, 2))) for t in rng.choice([*blobs, "unknown"], 150)]
    rects += [("disc", 0, 0, 60, 70), ("disc", 0, 0, 64, 64), ("disc", 16, 16, 16, 16), ("disc", 16, 16, 16, 16)]
    laid = spark.createDataFrame([(t, y, x, y + h, x + w) for t, y, x, h, w in rects], "tissue_id string, y0 int, x0 int, y1 int, x1 int")
    areas = summed.summed_areas(mask, extents, block)
    got = sorted(tuple(r) for r in summed.rect_sums(laid, areas, extents, block).collect())
    held = lambda t, y, x, h, w: int(blobs[t][max(y, 0) : max(y + h, 0), max(x, 0) : max(x + w, 0)].sum()) if t in blobs else 0
    assert got == sorted((t, y, x, y + h, x + w, held(t, y, x, h, w)) for t, y, x, h, w in rects)


def test_integral_image_from_blocks(spark, blobs, files):
    mask, extents = arrays.masks(spark, files), arrays.mask_sizes(spark, files)
    got = {(r.tissue_id, r.y, r.x): r.total for r in summed.integral_image(mask, extents, 16).collect()}
    assert got == {(t, y, x): n for t, m in blobs.items() for (y, x), n in np.ndenumerate(m.cumsum(0).cumsum(1))}


def test_windows_of_summed_areas_are_no_longer_than_the_blocks_along_an_edge(spark):
    mask = spark.range(0, 3000, 7).selectExpr("'t' as tissue_id", "cast(id as int) as y", "cast(id as int) as x")
    areas = summed.summed_areas(mask, block=64)
    assert areas.count() == 47**2
    longest = areas.groupBy("by").count().agg(F.max("count")).first()[0]
    assert longest <= 64


def cover_by_argmax(mask, tile, stride, tolerance, goal, min_gain, max_tiles, overlap):
    """Every gain counted anew at each step."""
    h, w = max(mask.shape[0], tile), max(mask.shape[1], tile)
    left = np.zeros((h, w), bool)
    left[: mask.shape[0], : mask.shape[1]] = mask
    total, least = int(left.sum()), int(np.ceil(min_gain * tile**2))
    starts = [[*dict.fromkeys([*range(0, n - tile + 1, stride), n - tile])] for n in (h, w)]
    window = lambda r, c: left[r : r + tile, c : c + tile]
    valid = {(r, c): int(window(r, c).sum()) for r in starts[0] for c in starts[1]}
    able = [k for k, v in valid.items() if v > 0 and v / tile**2 >= 1 - tolerance]
    chosen, covered = [], 0
    while able:
        gains = [int(window(*k).sum()) for k in able]
        gain = max(gains)
        r, c = able[gains.index(gain)]
        if gain <= 0:
            return chosen, tiling.NO_GAIN, covered
        if (goal >= 1 or covered / total >= goal) and gain < least:
            return chosen, tiling.ADAPTIVE, covered
        chosen.append((r, c, valid[r, c], gain))
        covered += gain
        left[r : r + tile, c : c + tile] = False
        able = [k for k in able if k != (r, c) and (overlap or abs(k[0] - r) >= tile or abs(k[1] - c) >= tile)]
        if max_tiles is not None and len(chosen) >= max_tiles:
            return chosen, tiling.MOST, covered
    return chosen, tiling.EXHAUSTED, covered


def test_lazy_cover_chooses_the_same_tiles():
    rng = np.random.default_rng(7)
    for _ in range(60):
        mask = rng.random((int(rng.integers(3, 40)), int(rng.integers(3, 40)))) < rng.choice([0.3, 0.8, 1])
        tile, stride = int(rng.integers(2, 9)), int(rng.integers(1, 7))
        how = (tile, stride, float(rng.choice([0.2, 0.5, 1])), float(rng.choice([0.5, 0.9, 1.0])), float(rng.choice([0, 0.05, 0.4])), rng.choice([None, 3]), bool(rng.integers(2)))
        if mask.any():
            got = tiling.greedy_cover(mask, *how)
            assert (got.tiles, got.reason, got.covered) == cover_by_argmax(mask, *how), how


def test_lazy_cover_of_a_large_mask():
    y, x = np.ogrid[:20_000, :20_000]
    mask = (y - 10_000) ** 2 + (x - 10_000) ** 2 < 8_000**2
    began = time.perf_counter()
    cover = tiling.greedy_cover(mask, 256, 64, 0.2, 0.99, 0.05, None, True)
    assert cover.covered >= 0.99 * mask.sum()
    assert time.perf_counter() - began < 120


def test_numbers_of_blocks_are_dense_and_in_order(spark):
    rows = spark.createDataFrame([(b, i) for b in (3, 1, 2) for i in range(4, 0, -1)], "b int, i int")
    got = index.numbered(rows, ["b"], ["i"]).collect()
    assert {(r.b, r.i): r.global_id for r in got} == {(b, i): 4 * (b - 1) + i - 1 for b in (1, 2, 3) for i in range(1, 5)}


def test_a_rectangle_stays_one_row(spark):
    """Its corners are looked up one after the other: no sum over corners that shuffles rectangles again."""
    mask = spark.createDataFrame([("t", y, x) for y in range(9) for x in range(9) if (y + x) % 3], "tissue_id string, y int, x int")
    laid = spark.createDataFrame([("t", i, -1, 2, 5, 7 + i) for i in range(3)] * 2 + [("u", 9, 0, 0, 4, 4)], "tissue_id string, rect_id int, y0 int, x0 int, y1 int, x1 int")
    extents = tiling.sizes(mask)
    made = summed.rect_sums(laid, summed.summed_areas(mask, extents, 4), extents, 4)
    want = sorted([i, sum(1 for y in range(5) for x in range(2, min(9, 7 + i)) if (y + x) % 3)] for i in (0, 0, 1, 1, 2, 2)) + [[9, 0]]
    assert sorted([r.rect_id, r.pixels] for r in made.collect()) == want
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "Aggregate" in line and "rect_id" in line]
