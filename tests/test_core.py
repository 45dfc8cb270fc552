"""Golden values, contracts and plans of the imaging operators."""

from __future__ import annotations

import json
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import channels, inventory, jobs, kernels, metadata, stats, tiles, tiling
from tessera.sources import arrays, catalog
from tessera.streaming import moments as streaming


@pytest.fixture(scope="module")
def ones(spark):
    return spark.createDataFrame([(1, y, x) for y in range(5) for x in range(7)], "tissue_id long, y int, x int")


def test_grid_covers_a_full_mask(ones):
    got = tiling.grid_tiles(ones, 3, 3, 0.85).orderBy("tile_id").collect()
    assert [(r.row, r.col, r.valid) for r in got] == [(0, 0, 9), (0, 3, 9), (0, 6, 3), (3, 0, 6), (3, 3, 6), (3, 6, 2)]
    s = tiling.grid_stats(ones, 3, 3, 0.85).first()
    assert (s.covered_valid_pixels, s.total_valid_pixels, s.overlap_pixels, s.padded_height, s.padded_width) == (35, 35, 19, 6, 9)
    got = tiling.grid_tiles(ones, 3, 3, 0.5).orderBy("tile_id").collect()
    assert [(r.row, r.col, r.valid) for r in got] == [(0, 0, 9), (0, 3, 9), (3, 0, 6), (3, 3, 6)]
    with pytest.raises(ValueError, match="positive"):
        tiling.grid_tiles(ones, 0)


@pytest.mark.parametrize(
    ("more", "tiles_", "reason", "covered"),
    [
        ((0.99, 0.05, None, True), [(0, 0, 9), (0, 3, 9), (2, 4, 7), (2, 0, 6), (0, 4, 2), (2, 3, 2)], "candidates_exhausted", 35),
        ((1.0, 0.5, None, True), [(0, 0, 9), (0, 3, 9), (2, 4, 7), (2, 0, 6)], "adaptive_stop", 31),
        ((0.99, 0.05, None, False), [(0, 0, 9), (0, 3, 9)], "candidates_exhausted", 18),
        ((0.99, 0.05, 2, True), [(0, 0, 9), (0, 3, 9)], "max_tiles", 18),
    ],
)
def test_greedy_cover_of_a_full_mask(more, tiles_, reason, covered):
    cover = tiling.greedy_cover(np.ones((5, 7), bool), 3, 3, 0.2, *more)
    assert ([(r, c, g) for r, c, _, g in cover.tiles], cover.reason, cover.covered) == (tiles_, reason, covered)
    assert cover.candidates == 6


def test_greedy_cover_equals_full_recomputation(spark):
    rng = np.random.default_rng(1)
    for _ in range(20):
        mask = rng.random((rng.integers(3, 25), rng.integers(3, 25))) < 0.6
        chosen, _, covered, _ = tiling.greedy_cover(mask, 5, 3, 0.9, 0.95, 0.05, None, True)
        left = np.zeros((max(5, mask.shape[0]), max(5, mask.shape[1])), bool)
        left[: mask.shape[0], : mask.shape[1]] = mask
        for row, col, _, gain in chosen:
            assert left[row : row + 5, col : col + 5].sum() == gain
            left[row : row + 5, col : col + 5] = False
        assert sum(g for *_, g in chosen) == covered <= mask.sum()
    assert tiling.greedy_cover(np.zeros((4, 4), bool), 3, 3, 0.2, 0.99, 0.05, None, True) == ([], "empty_mask", 0, 0)


def test_quantiles_and_moments_of_small_values(spark):
    px = spark.createDataFrame([(1, "c", i, float(i), True) for i in range(5)] + [(1, "c", 9, float("nan"), True)], "tissue_id long, channel string, pix long, value double, fg boolean")
    q = stats.quantiles(px, "image", 0.99, 0.01)
    assert (round(q.first().upper, 9), round(q.first().lower, 9)) == (3.96, 0.04)
    upper = stats.quantiles(px, "image", 0.99)
    fine = px.where("pix < 9")
    m = stats.moments(fine, upper, "image", "global").first()
    assert (round(m["mean"], 9), round(m["std"], 9)) == (0.503030302, 0.354279159) or abs(m["mean"] - 0.5030303018) < 1e-9
    m = stats.moments(fine, upper, "image", "image", "quantile_clipping_log1p").first()
    assert abs(m["mean"] - 0.9558919142) < 1e-9 and abs(m["std"] - 0.5665805536) < 1e-9
    with pytest.raises(NotImplementedError):
        stats.transform_named("other/x")


def test_unusable_statistics(spark):
    rows = [(1.0, None, 0.1, 1.0, True), (0.0, None, 0.1, 1.0, False), (float("nan"), None, 0.1, 1.0, False), (None, None, 0.1, 1.0, False), (1.0, float("inf"), 0.1, 1.0, False), (1.0, 0.0, 0.1, 0.0, False)]
    df = spark.createDataFrame(rows, "u double, l double, m double, s double, want boolean")
    got = df.select(F.coalesce(stats.valid_stats(F.col("u"), F.col("l"), F.col("m"), F.col("s")), F.lit(False)).alias("got"), "want").collect()
    assert all(r.got == r.want for r in got)


def test_channel_choice_and_its_contracts(spark):
    rows = [(0, "a", "P68431", True), (1, "b", "A0A024", True), (2, "c", " P68431", True), (3, "d", "Q9Y2X3-2", None), (4, "a", None, False)]
    table = spark.createDataFrame(rows, "channel_pos int, channel_name string, uniprot_id string, qc_pass boolean")
    wide = spark.createDataFrame([("t", 1.0, 0.0, float("nan"), 1.0, 1.0)], "tissue_id string, a double, b double, c double, d double, e double")
    assert {r.channel_name for r in channels.long_map(wide).where("measured").collect()} == {"a", "d", "e"}
    every = channels.default_map(wide, table)
    pick = lambda kind: [r.channel_pos for r in channels.select(every, table, kind).orderBy("channel_pos").collect()]
    assert (pick("complete"), pick("qc_filtered"), pick("uniprot_filtered")) == ([0, 1, 2, 3, 4], [0, 1, 2], [0])
    assert channels.select(every, table.drop("qc_pass", "uniprot_id"), "qc_filtered").count() == 5
    with pytest.raises(ValueError, match="kind"):
        channels.select(every, table, "other")


def test_filters_reflect_at_borders():
    plane = np.arange(9.0).reshape(3, 3)
    assert kernels.median(plane).tolist() == [[3, 3, 4], [4, 4, 4], [4, 5, 5]]
    assert abs(kernels.gaussian(np.ones((4, 4))) - 1).max() < 1e-12
    with pytest.raises(ValueError, match="odd"):
        kernels.median(plane, 2)
    image = kernels.png(np.arange(12, dtype=np.uint8).reshape(2, 2, 3))
    assert image[:8] == b"\x89PNG\r\n\x1a\n" and zlib.decompress(image[image.index(b"IDAT") + 4 :])[0] == 0


def test_crops_at_borders_and_hits(spark, ones):
    px = ones.withColumn("value", F.lit(1.0))
    coords = spark.createDataFrame([(1, 0, -1, -1), (1, 1, 4, 6), (1, 2, 50, 50), (1, 5, 0, 0)], "tissue_id long, tile_id int, row int, col int")
    sums = {r.tile_id: (r.n, r.s) for r in tiles.crop(px, coords, 3).groupBy("tile_id").agg(F.count("*").alias("n"), F.sum("value").alias("s")).collect()}
    assert sums == {0: (9, 4.0), 1: (9, 1.0), 2: (9, 0.0), 5: (9, 9.0)}
    assert tiles.crop(px, coords, 3, padded=False).where("tile_id = 0").count() == 4
    point = spark.createDataFrame([("p", 1, 1, 1), ("q", 1, 40, 1)], "point_id string, tissue_id long, y int, x int")
    assert [(r.point_id, r.tile_id) for r in tiles.hit(point, coords, 3).collect()] == [("p", 0)]
    assert [r.tile_id for r in tiles.in_bounds(coords, tiling.sizes(ones), 3).collect()] == [5]
    assert [r.tile_id for r in tiles.by_ordinal(coords, 3).collect()] == [5]
    with pytest.raises(ValueError, match="lack"):
        tiles.validated(coords.drop("row"))
    plan = tiles.containing(px, coords, 3)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_metadata_contracts(spark):
    rows = [(1, 7, "imc", "train", 0), (2, 7, "codex", "train", 1), (3, None, "he", "test", 2)]
    t = spark.createDataFrame(rows, "tissue_id long, patient_id long, modality string, split string, pos int")
    assert [(r.patient_id, r.tissue_ids) for r in metadata.patients(t).collect()] == [(7, [1, 2])]
    assert metadata.of_patient(t, "7").count() == 2 and metadata.of_patient(t, "8").count() == 0
    assert {r.modality: r.code for r in metadata.label_codes(t, "modality").collect()} == {"imc": 0, "codex": 1, "he": 2}
    for split, frame in (("nope", t), ("train", t.drop("split"))):
        with pytest.raises(ValueError, match="split"):
            metadata.filtered(frame, split=split)
    assert metadata.filtered(t, label="modality").count() == 3
    drawn = metadata.sample_with_replacement(t.withColumn("id0", F.col("pos").cast("long")), 20, 3, "id0")
    assert drawn.count() == 20


def test_pushdown_and_broadcast_free_plans(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    spark.range(100).selectExpr("id AS tissue_id", "id % 3 AS patient_id", "'imc' AS modality", "'train' AS split", "id AS pos").write.parquet(path)
    plan = metadata.filtered(spark.read.parquet(path), modality="imc").select("tissue_id")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(modality,imc)" in plan and "patient_id" not in plan


def test_searches(spark):
    df = spark.createDataFrame([("d", "imc", 1, "CD45 (PTPRC)", None), ("d", "imc", 2, "dapi", "nan")], "dataset string, modality string, channel_index int, channel_name string, uniprot_id string")
    every = inventory.channel_inventory(df)
    assert [r.channel_index for r in inventory.filtered(every, search="(ptprc)").collect()] == [1]
    assert [(r.nuclear_reason, r.has_uniprot, r.qc_display) for r in every.orderBy("channel_index").collect()] == [("", False, "unknown"), ("DAPI stain", False, "unknown")]
    with pytest.raises(Exception, match="(?i)regex|pattern"):
        inventory.regex_search(df, "(").collect()


def test_jobs_write_once_and_read_back(spark, tmp_path, ones):
    root = str(tmp_path)
    px = spark.createDataFrame([(t, c, i, float(i * t), True) for t in (1, 2) for c in ("a", "b") for i in range(9)], "tissue_id long, channel string, pix long, value double, fg boolean")
    assert len(jobs.compute_statistics(px, root, ["a", "b"], 0.9, 0.1)) == 4
    assert jobs.compute_statistics(px, root, ["a", "b"], 0.9, 0.1) == []
    names = spark.createDataFrame([("a",), ("b",), ("z",)], "channel_name string")
    got = catalog.statistics(spark, f"{root}/standardization/{catalog.spec_dir('quantile_clipping', 0.9, 0.1, 'image')}", "image", names)
    assert {(r.channel, r.tissue_id, r["mean"] is None) for r in got.collect()} == {("a", 1, False), ("a", 2, False), ("b", 1, False), ("b", 2, False), ("z", None, True)}
    assert len(jobs.compute_tiling(ones, root, 1, 3)) == 2
    assert spark.read.parquet(f"{root}/tiling/1_0mpp/grid/3_tile_coordinates.parquet").count() == 6
    assert len(jobs.compute_tiling(ones, root, 1, 3, "greedy", 3, 0.2)) == 2
    with pytest.raises(ValueError, match="default"):
        jobs.compute_tiling(ones, root, 1, 3, "default")


def test_array_stores(spark, tmp_path):
    mask = np.zeros((4, 5), np.int32)
    mask[1, 2], mask[3, 4] = 1, 7
    np.savez(tmp_path / "t1.npz", mask=mask)
    got = arrays.masks(spark, str(tmp_path), labels=True)
    assert {tuple(r) for r in got.collect()} == {("t1", 1, 2, 1), ("t1", 3, 4, 7)}
    np.savez(tmp_path / "t3.npz", mask=np.zeros((5, 6)))
    sizes = spark.createDataFrame([("t1", 4, 5), ("t2", 2, 3), ("t3", 5, 6)], "tissue_id string, h int, w int")
    known = arrays.mask_sizes(spark, str(tmp_path))
    assert sorted(map(tuple, known.collect())) == [("t1", 4, 5), ("t3", 5, 6)]
    full = arrays.masks_or_full(got, known, sizes)
    assert full.groupBy("tissue_id").count().orderBy("tissue_id").collect() == [("t1", 2), ("t2", 6)]
    level = tmp_path / "images" / "t1.ome.zarr" / "0"
    level.mkdir(parents=True)
    image = np.arange(2 * 5 * 7, dtype="<f4").reshape(2, 5, 7)
    (level / ".zarray").write_text(json.dumps({"shape": [2, 5, 7], "chunks": [1, 4, 4], "dtype": "<f4", "order": "C", "compressor": {"id": "zlib"}, "zarr_format": 2, "fill_value": 0}))
    for c in range(2):
        for y in range(2):
            for x in range(2):
                part = np.zeros((1, 4, 4), "<f4")
                cut = image[c : c + 1, 4 * y : 4 * y + 4, 4 * x : 4 * x + 4]
                part[:, : cut.shape[1], : cut.shape[2]] = cut
                (level / f"{c}.{y}.{x}").write_bytes(zlib.compress(part.tobytes()))
    folder = str(tmp_path / "images")
    assert [(r.store, r.shape) for r in arrays.zarr_shapes(spark, folder).collect()] == [("t1", [2, 5, 7])]
    every = {(r.plane, r.y, r.x): r.value for r in arrays.zarr_pixels(spark, folder).collect()}
    assert every == {(c, y, x): float(image[c, y, x]) for c in range(2) for y in range(5) for x in range(7)}
    part = arrays.zarr_pixels(spark, folder, planes=[1], window=(3, 2, 2, 3)).collect()
    assert {(r.plane, r.y, r.x): r.value for r in part} == {(1, y, x): float(image[1, y, x]) for y in (3, 4) for x in (2, 3, 4)}


@pytest.mark.parametrize("separator", [".", "/"])
def test_only_chunks_asked_for_are_opened(spark, tmp_path, separator):
    image = np.arange(3 * 6 * 6, dtype="<i2").reshape(3, 6, 6)
    for store in ("t1", "t2"):
        level = tmp_path / f"{store}.ome.zarr" / "0"
        level.mkdir(parents=True)
        meta = {"shape": [3, 6, 6], "chunks": [1, 3, 3], "dtype": "<i2", "order": "F", "compressor": None, "fill_value": 7, "dimension_separator": separator}
        (level / ".zarray").write_text(json.dumps(meta))
        for c in range(3):
            for y in range(2):
                for x in range(2):
                    if (c, y, x) == (2, 1, 1):
                        continue  # a missing chunk
                    file = level / separator.join(map(str, (c, y, x)))
                    file.parent.mkdir(parents=True, exist_ok=True)
                    data = image[c : c + 1, 3 * y : 3 * y + 3, 3 * x : 3 * x + 3].tobytes(order="F")
                    file.write_bytes(data if store == "t1" and c != 1 else b"unreadable")
    folder = str(tmp_path)
    got = arrays.zarr_pixels(spark, folder, planes=[0, 2], window=(2, 2, 3, 3), stores=["t1"])
    want = image.astype(float)
    want[2, 3:, 3:] = 7
    assert {(r.plane, r.y, r.x): r.value for r in got.collect()} == {(c, y, x): want[c, y, x] for c in (0, 2) for y in (2, 3, 4) for x in (2, 3, 4)}
    opened = arrays.zarr_chunks(spark, folder, [0], (0, 0, 2, 2), ["t1"])
    assert {f.rsplit(".zarr/0/", 1)[1] for f in opened.inputFiles()} == {separator.join("000")}
    assert arrays.zarr_pixels(spark, folder, planes=[2], window=(4, 4, 1, 1), stores=["t1"]).first().value == 7
    assert arrays.zarr_pixels(spark, folder, planes=[0], window=(50, 50, 3, 3)).collect() == []


def test_covers_of_mask_files_have_all_statistics(spark, tmp_path):
    folder = tmp_path / "masks"
    folder.mkdir()
    corner = np.zeros((20, 20), np.uint8)
    corner[:4, :4] = 1
    for name, mask in (("corner", corner), ("empty", np.zeros((9, 11))), ("full", np.ones((5, 7)))):
        np.savez(folder / f"{name}.npz", mask=mask)
    pixels, files, known = (f(spark, str(folder)) for f in (arrays.masks, arrays.mask_files, arrays.mask_sizes))
    root = str(tmp_path / "d")
    jobs.compute_tiling(pixels, root, 1, 3, "grid", 3, 0.85, extents=known)
    jobs.compute_tiling(pixels, root, 1, 3, "greedy", 3, 0.2, goal=0.99, files=files)
    grid, greedy = ({r.tissue_id: r for r in spark.read.parquet(f"{root}/tiling/1_0mpp/{s}/3_tile_stats.parquet").collect()} for s in ("grid", "greedy"))
    assert (grid["corner"].mask_height, grid["corner"].padded_height, grid["corner"].grid_candidate_count, grid["corner"].num_tiles) == (20, 21, 49, 3)
    assert grid["corner"].tissue_mask_frac == 16 / 400
    for stats_ in (grid, greedy):
        e = stats_["empty"]
        assert (e.mask_height, e.mask_width, e.num_tiles, e.coverage_ratio, e.stop_reason, e.overlap_pixels) == (9, 11, 0, 1.0, "empty_mask", 0)
    full = greedy["full"]
    assert (full.num_tiles, full.candidate_count, full.covered_valid_pixels, full.overlap_pixels, full.stop_reason) == (6, 6, 35, 19, "candidates_exhausted")
    assert (full.tile_size, full.stride, full.tolerance, full.coverage_goal, full.min_gain_ratio, full.tiling_method) == (3, 3, 0.2, 0.99, 0.05, "greedy")
    again = tiling.greedy_tiles(pixels, 3, 3, 0.2, extents=known)
    assert sorted(map(tuple, again.select("tissue_id", "row", "col").dropna().collect())) == sorted(map(tuple, spark.read.parquet(f"{root}/tiling/1_0mpp/greedy/3_tile_coordinates.parquet").select("tissue_id", "row", "col").collect()))
    assert {r.tissue_id: r.stop_reason for r in again.collect()}["empty"] == "empty_mask"
    assert "Exchange" not in tiling.greedy_file_tiles(files, tile=3)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("values", [[1.0], [2.0, 2.0, 2.0], [float(i * i % 97) for i in range(1000)], [float(i) for i in range(7)] + [float("nan"), float("inf")]])
def test_range_quantiles_equal_the_sorted_ones(spark, values):
    px = spark.createDataFrame([(1, c, v * k) for c, k in (("a", 1), ("b", -2)) for v in values] + [(1, "none", None)], "tissue_id long, channel string, value double")
    got = {r.channel: (r.upper, r.lower) for r in stats.quantiles(px, "global", 0.93, 0.07).collect()}
    fine = np.array([v for v in values if np.isfinite(v)])
    assert got.pop("none") == (None, None)
    for c, k in (("a", 1), ("b", -2)):
        assert np.allclose(got[c], np.quantile(fine * k, [0.93, 0.07]))


def test_large_images_by_ranges_and_moments_of_both_levels_from_one_scan(spark):
    rng = np.random.default_rng(5)
    rows = [(t, c, float(v)) for t in (1, 2, 3) for c in ("a", "b") for v in rng.normal(t, 10.0 ** (t - 2), 400 * t)]
    rows += [(4, "a", None), (4, "b", 0.0), (1, "a", float("nan")), (5, "none", None)]
    px = spark.createDataFrame(rows, "tissue_id long, channel string, value double")
    near = lambda a, b: (a is None) == (b is None) and (a is None or abs(a - b) < 1e-9)
    sides = [{(r.tissue_id, r.channel): (r.upper, r.lower) for r in stats.quantiles(px, "image", 0.97, 0.2, ranges=how).collect()} for how in (None, True)]
    assert sides[0].keys() == sides[1].keys() and len(sides[0]) == 9
    assert all(near(x, y) for k in sides[0] for x, y in zip(sides[0][k], sides[1][k], strict=True))
    clean = px.where("not isnan(value) or value is null")
    for q in stats.LEVELS:
        bounds = stats.quantiles(clean, q, 0.97, 0.2)
        for level, made in stats.moments_by_level(clean, bounds, q).items():
            keys = stats.LEVELS[level]
            got, want = ({tuple(r[k] for k in keys): (r["mean"], r["std"], r["n"]) for r in d.collect()} for d in (made, stats.moments(clean, bounds, q, level)))
            assert got.keys() == want.keys() and all(near(x, y) for k in got for x, y in zip(got[k], want[k], strict=True))


def test_stretch_by_ranges_equals_the_plain_one(spark):
    rng = np.random.default_rng(7)
    rows = [(p, i // 8, i % 8, float(v)) for p in (0, 1) for i, v in enumerate(rng.normal(0, 5, 64))] + [(2, 0, 0, 3.0), (2, 0, 1, 3.0)]
    planes = spark.createDataFrame(rows, "plane int, y int, x int, value double")
    plain, by_ranges = (sorted(map(tuple, kernels.stretch(planes, ["plane"], 0.05, 0.9, ranges=how).collect())) for how in (False, True))
    assert plain == by_ranges and len(plain) == 130


def test_value_ranges_never_fall(spark):
    rng = np.random.default_rng(6)
    some = np.concatenate([rng.normal(0, 10.0 ** e, 300) for e in (-300, -9, 0, 3, 300)] + [np.nextafter(2.0 ** np.arange(-20, 20), s * np.inf) for s in (-1, 1)])
    values = sorted({float(v) for v in some} | {float(2.0**i) for i in range(-20, 20)} | {0.0, 5e-324, -5e-324, 1.7e308})
    got = [r.r for r in spark.createDataFrame([(v,) for v in values], "v double").coalesce(1).select(stats.value_range(F.col("v")).alias("r")).collect()]
    assert got == sorted(got) and [v for v, r in zip(values, got, strict=True) if r == 0] == [0.0]


def test_first_and_single_rows_of_statistics(spark, tmp_path):
    for name, rows in (("upper_quantiles", [("t1", 1.0), ("t1", 9.0)]), ("means", [("t1", 0.1), ("t2", 0.2)]), ("stds", [("t1", 1.0), ("t2", 2.0)])):
        spark.createDataFrame(rows, "tissue_id string, a double").coalesce(1).write.parquet(str(tmp_path / f"image_level_{name}.parquet"))
    names = spark.createDataFrame([("a",)], "channel_name string")
    rows = spark.createDataFrame([("t1", "a"), ("t2", "a"), ("t3", "a")], "tissue_id string, channel string")
    for columns in (["upper", "lower"], ["mean", "std"]):
        rows = catalog.with_statistics(rows, catalog.statistics_of(spark, str(tmp_path), "image", names, columns), columns)
    got = {r.tissue_id: (r.upper, r["mean"]) for r in rows.collect()}
    assert got == {"t1": (1.0, 0.1), "t2": (1.0, 0.2), "t3": (1.0, None)}


def test_counts_in_text_and_composed_samples(spark):
    text = ["64:1, 64:2", "128:99999999999", "a, :3, b:x, c:1:2, d: -4 ", "", None]
    got = [r.m for r in spark.createDataFrame([(t,) for t in text], "t string").select(inventory.parsed_counts(F.col("t")).alias("m")).collect()]
    assert got == [{"64": 2}, {"128": 99999999999}, {"": 3, "d": -4}, {}, None]
    rows = spark.createDataFrame([("t", "he", 1), ("t", "he", 2), ("t", "imc", 3)], "tissue_id string, modality string, n int")
    assert {k: v["n"] for k, v in metadata.composed(rows, ["tissue_id"]).first().samples.items()} == {"he": 2, "imc": 3}


def test_catalog_of_folders(spark, tmp_path):
    for name in ("d1/imc/1_0mpp/images/t.ome.zarr/0/0.0.0", "d1/imc/1_0mpp/images/t.ome.zarr/0/0.0.1", "d1/ihc/ihc_cd3/x.txt", "d2/he/y.txt", "d1/standardization/clip/uq_0.9_image/a.parquet", "d1/segmentations/1_0mpp/cell_masks/types/t.npz", "d1/segmentations/1_0mpp/cell_masks/instances/t.npz"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"1")
    listing = catalog.below_root(catalog.files(spark, str(tmp_path), "*"), str(tmp_path))
    found = catalog.modalities_on_disk(listing)
    assert {tuple(r) for r in found.collect()} == {("d1", "imc"), ("d1", "ihc_cd3"), ("d2", "he")}
    assert [r.dataset for r in catalog.datasets_of_modality(found, "multiplex").collect()] == ["d1"]
    assert {r.modality for r in catalog.requested_modalities(found, ["ihc", "he"]).collect()} == {"ihc_cd3", "he"}
    assert [(r.dataset, r.stores) for r in catalog.image_stores(listing).collect()] == [("d1", 1)]
    assert [r.spec for r in catalog.standardization_specs(listing).collect()] == ["clip/uq_0.9_image"]
    assert [r.mask_type for r in catalog.mask_types(listing).collect()] == ["types"]
    (tmp_path / "allow.txt").write_text("d1\n\n# no\n d2 \n")
    assert {r.dataset for r in catalog.allow_list(spark, str(tmp_path / "allow.txt")).collect()} == {"d1", "d2"}


def test_running_moments_of_a_stream(spark, tmp_path):
    px = spark.createDataFrame([(1, "c", i, float(i)) for i in range(50)], "tissue_id long, channel string, pix long, value double")
    bounds = stats.quantiles(px, "image")
    px.repartition(5).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(px.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    q = streaming.running_moments(stream, bounds).writeStream.format("memory").queryName("moments").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    got, want = spark.table("moments").first(), stats.moments(px, bounds, "image", "global").first()
    assert abs(got["mean"] - want["mean"]) < 1e-12 and abs(got["std"] - want["std"]) < 1e-12 and got["n"] == 50
