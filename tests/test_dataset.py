"""Datasets, composed datasets, cohorts and inventories over a small folder tree."""

from __future__ import annotations

import functools
import json
import pathlib
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tessera import dataset
from tessera.dataset import Cohort, ComposedDataset, ImagingDataset, register_modality
from tessera.operators import index, inventory, kernels
from tessera.sources import collections

MULTI = {"t1": 2, "t2": 3}


def store(level, image):
    level.mkdir(parents=True)
    (level / ".zarray").write_text(json.dumps({"shape": list(image.shape), "chunks": [1, 5, 6], "dtype": image.dtype.str, "compressor": {"id": "zlib"}, "fill_value": 0}))
    for c in range(len(image)):
        (level / f"{c}.0.0").write_bytes(zlib.compress(image[c].tobytes()))


def multiplex(planes):
    return np.arange(planes * 30, dtype="<f4").reshape(planes, 5, 6)


def photo():
    return (np.arange(90) * 2).astype("u1").reshape(3, 5, 6)


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("datasets")
    rows = [("t1", "p", "imc", "train"), ("t2", "p", "imc", "test"), ("t1", "p", "he", "train"), ("t1", "p", "ihc_cd3", "train")]
    for name in ("d1", "d2"):
        base = top / name
        spark.createDataFrame(rows, "tissue_id string, patient_id string, modality string, split string").coalesce(1).write.parquet(str(base / "metadata/tissues.parquet"))
        spark.createDataFrame([(0, "DAPI", None, True), (1, "CD3", "P07766", True), (2, "CD8", "P01732", False)], "index int, channel_name string, uniprot_id string, qc_pass boolean").write.parquet(str(base / "imc/channels.parquet"))
        spark.createDataFrame([("t1", 1, 0, 1), ("t2", 1, 1, 1)], "tissue_id string, DAPI int, CD3 int, CD8 int").write.parquet(str(base / "imc/channels_per_tissue.parquet"))
        for tissue, planes in MULTI.items():
            store(base / f"imc/1_0mpp/images/{tissue}.ome.zarr/0", multiplex(planes))
        store(base / "he/1_0mpp/images/t1.ome.zarr/0", photo())
        store(base / "ihc/ihc_cd3/1_0mpp/images/t1.ome.zarr/0", photo())
        masks = base / "segmentations/1_0mpp/tissue_masks"
        masks.mkdir(parents=True)
        mask = np.ones((5, 6))
        mask[0, 0] = 0
        np.savez(masks / "t1.npz", mask=mask)
    (top / "d3" / "notes").mkdir(parents=True)
    return str(top)


@pytest.fixture(scope="module")
def tiled(spark, root):
    """Statistics of d1 and tiles of d1 and d2."""
    for name in ("d1", "d2"):
        ImagingDataset(spark, root, name, "imc", tile_size=4).compute_tiling(overwrite=True)
    ImagingDataset(spark, root, "d1", "imc").compute_statistics(0.9)
    return root


def test_pixels_of_measured_channels(spark, root):
    d = ImagingDataset(spark, root, "d1", "imc")
    got = {(r.channel, r.y, r.x): r.value for r in d.pixels("t1").collect()}
    assert len(got) == 60 and got["DAPI", 0, 1] == 1 and got["CD8", 0, 0] == 30
    assert {r.channel_name for r in d.selected_channels("qc_filtered").where("tissue_id = 't2'").collect()} == {"DAPI", "CD3"}
    assert {r.tissue_id: (r.c, r.h, r.w) for r in d.sizes().collect()} == {"t1": (2, 5, 6), "t2": (3, 5, 6)}
    assert {r.tissue_id: r["count"] for r in d.mask().groupBy("tissue_id").count().collect()} == {"t1": 29, "t2": 30}
    assert [r.tissue_ids for r in d.patients().collect()] == [["t1", "t2"]]
    assert (d.tissues().count(), d.tissues("all").count()) == (2, 4)
    assert d.channel_labels("t2") == ["CD3"] and d.channel_labels("t1") == ["DAPI", "CD8"]
    for name in ("0.0.0", "2.0.0"):  # only the plane of CD3 is opened
        file = pathlib.Path(root, "d1/imc/1_0mpp/images/t2.ome.zarr/0", name)
        data = file.read_bytes()
        file.write_bytes(b"unreadable")
        assert d.pixels("t2", "uniprot_filtered").count() == 30
        file.write_bytes(data)


def test_standardized_pixels_and_masked_statistics(spark, tiled):
    raw = ImagingDataset(spark, tiled, "d1", "imc")
    assert raw.masked_pixels().where("tissue_id = 't1' and channel = 'DAPI'").count() == 29
    ready = ImagingDataset(spark, tiled, "d1", "imc", spec="quantile_clipping/uq_0.9_image")
    values = np.array([r.value for r in ready.pixels("t2").where("channel = 'CD8'").collect()])
    assert abs(values.mean()) < 1e-6 and abs(values.std() - 1) < 1e-6
    plain = ImagingDataset(spark, tiled, "d1", "imc", spec="quantile_clipping/uq_0.9_image", z_score=False)
    assert max(r.value for r in plain.pixels("t2").collect()) <= 1
    assert ImagingDataset(spark, tiled, "d1", "imc", spec="identity").pixels("t1").count() == 60
    with pytest.raises(FileNotFoundError, match="uq_0.5"):
        ImagingDataset(spark, tiled, "d1", "imc", spec="quantile_clipping/uq_0.5_image").pixels("t1")
    for wrong in ({"modality": "xray"}, {"modality": "he", "preset": "other"}, {"modality": "ihc_cd3", "preset": "identity"}, {"modality": "imc", "filters": [("blur", {})]}):
        with pytest.raises(ValueError, match="no "):
            ImagingDataset(spark, tiled, "d1", **wrong)


def test_photographs_are_normalized_by_channel(spark, root):
    he = ImagingDataset(spark, root, "d1", "HE", preset="hibou")
    got = {(r.channel, r.y, r.x): r.value for r in he.pixels("t1").collect()}
    mean, std = [0.7068, 0.5755, 0.722], [0.195, 0.2316, 0.1816]
    image = photo()
    assert len(got) == 90
    assert all(abs(got["RGB"[c], y, x] - (image[c, y, x] / 255 - mean[c]) / std[c]) < 1e-9 for c in range(3) for y in range(5) for x in range(6))
    ihc = ImagingDataset.of_marker(spark, root, "d1", "cd3")
    assert ihc.modality == "ihc_cd3"
    assert {r.value for r in ihc.pixels("t1", preprocess=False).where("channel = 'R'").collect()} == set(image[0].ravel().astype(float))
    flat = he.image("t1", channels_first=False).first()["values"]
    assert len(flat) == 90 and abs(flat[1] - got["G", 0, 0]) < 1e-12


def test_tiles_with_padding_and_filters(spark, tiled):
    grid = ImagingDataset(spark, tiled, "d1", "imc", strategy="grid", tile_size=4)
    tile = {(r.channel, r.dy, r.dx): r.value for r in grid.tile("t1", 1).collect()}
    assert len(tile) == 2 * 16 and tile["DAPI", 0, 0] == 4 and tile["DAPI", 0, 3] == 0
    assert {r.stop_reason for r in grid.tile_stats().collect()} == {"fixed_grid_complete"}
    free = ImagingDataset(spark, tiled, "d1", "imc", tile_size=4, filters=[("median", {})])
    got = {(r.channel, r.dy, r.dx): r.value for r in free.tile_at("t2", 2, 3).collect()}
    want = {c: kernels.median(multiplex(3)[i, 2:5, 3:6]) for i, c in enumerate(("DAPI", "CD3", "CD8"))}
    assert got == {(c, y, x): want[c][y, x] for c in want for y in range(3) for x in range(3)}
    whole = {(r.channel, r.y, r.x): r.value for r in free.pixels("t1").collect()}
    assert whole["DAPI", 0, 0] == kernels.median(multiplex(2)[0])[0, 0]
    assert {(r.h, r.w, len(r["values"])) for r in free.planes().collect()} == {(5, 6, 30)}
    with pytest.raises(KeyError):
        grid.tile("t1", 99)


def test_modalities_together(spark, tiled):
    both = ComposedDataset(spark, tiled, "d1", ["ihc", "he", "imc"], strategy="grid", tile_size=4, settings={"he": {"preset": "identity"}})
    assert both.available() == ["he", "imc", "ihc_cd3"]
    assert {r.tissue_id: r.modalities for r in both.tissue_modalities().collect()} == {"t1": ["he", "imc", "ihc_cd3"], "t2": ["imc"]}
    rows = both.tissue("t1", "complete").groupBy("modality").count().collect()
    assert {r.modality: r["count"] for r in rows} == {"he": 90, "imc": 60, "ihc_cd3": 90}
    assert abs(both.tissue("t1").where("modality = 'he' and channel = 'G' and y = 0 and x = 0").first().value - 60 / 255) < 1e-9
    assert {r.modality: r["count"] for r in both.tile("t1", 0, "complete").groupBy("modality").count().collect()} == {"he": 48, "imc": 32, "ihc_cd3": 48}
    assert both.patient("p", "complete").select("tissue_id").distinct().count() == 2 and both.patient("x") is None
    with pytest.raises(KeyError):
        both.dataset("codex")
    with pytest.raises(KeyError):
        both.tissue("t9")


def test_cohorts(spark, tiled):
    cohort = Cohort(spark, tiled, ["d1", "d3", "d2"], ["imc", "he"], strategy="grid", tile_size=4, settings={"he": {"preset": "identity"}}, dataset_settings={"d2": {"he": {"preset": "hibou"}}})
    assert list(cohort.members) == ["d1", "d2"]
    assert [cohort.dataset(n).dataset("he").preset for n in ("d1", "d2")] == ["identity", "hibou"]
    index = cohort.tile_index()
    assert sorted(r.global_tile_id for r in index.collect()) == list(range(index.count())) and cohort.size() == index.count()
    assert cohort.sample(3, 1).count() == 3 and cohort.draws(50, 2).count() == 50
    first = cohort.at(0, "complete")
    assert {r.dataset_name for r in first.collect()} == {"d1"} and {r.dataset_name for r in cohort.at(-1, "complete").collect()} == {"d2"}
    assert cohort.random(3, 1, "complete").collect() == cohort.random(3, 1, "complete").collect() != []
    with pytest.raises(IndexError):
        cohort.at(999)
    some = Cohort(spark, tiled, ["d1", "d2"], ["imc"], strategy="grid", tile_size=999)
    with pytest.raises(FileNotFoundError, match="999"):
        some.tile_index()
    tissues = Cohort(spark, tiled, ["d1"], ["he", "imc"])
    assert {(r.dataset_name, r.tissue_id, tuple(r.modalities)) for r in tissues.tissue_index().collect()} == {("d1", "t1", ("he", "imc")), ("d1", "t2", ("imc",))}
    assert {r.dataset_name: r.n for r in tissues.per_dataset().collect()} == {"d1": 2} and tissues.at(1, "complete").count() == 90
    for names, modalities, error in ((["d3"], None, ValueError), ([], None, ValueError), (["nope"], None, FileNotFoundError), (["d1"], ["codex"], ValueError)):
        with pytest.raises(error):
            Cohort(spark, tiled, names, modalities)


def test_a_modality_of_ones_own(spark, root):
    class Depth(ImagingDataset):
        """One plane of depths in millimetres, read as metres."""

        @property
        def rgb(self):
            return False

        @functools.cached_property
        def channel_table(self):
            return self.spark.createDataFrame([(0, "depth")], "channel_pos int, channel_name string")

        def all_tissues(self):
            return super().all_tissues().where("modality = 'he'").withColumn("modality", F.lit("depth"))

        def _normalized(self, rows):
            return rows.withColumn("value", F.col("value") / 1000)

    register_modality("depth", Depth)
    try:
        store(pathlib.Path(root) / "d1/depth/1_0mpp/images/t1.ome.zarr/0", multiplex(1))
        both = ComposedDataset(spark, root, "d1", ["depth"], tile_size=2)
        assert both.dataset("depth").pixels("t1").where("y = 4 and x = 5").first().value == 0.029
        assert both.dataset("depth").tile_at("t1", 4, 5).collect()[0].value == 0.029
        assert Cohort(spark, root, ["d1", "d2"], ["depth"]).members.keys() == {"d1"}
    finally:
        dataset.KINDS.clear()


def test_unreadable_tables_count_nothing(spark, tmp_path):
    for name in ("good", "bad"):
        spark.createDataFrame([("t", "p", "imc")], "tissue_id string, patient_id string, modality string").write.parquet(str(tmp_path / name / "metadata/tissues.parquet"))
    at = tmp_path / "good/tiling/1_0mpp/grid"
    at.mkdir(parents=True)
    (at / "64_tile_coordinates.parquet").write_bytes(b"no parquet file")
    broken = tmp_path / "worse/metadata"
    broken.mkdir(parents=True)
    (broken / "tissues.parquet").write_bytes(b"no parquet file")
    tables = collections.load(spark, str(tmp_path))
    assert [(r.dataset, r.crop_counts_by_size) for r in tables["datasets"].collect()] == [("bad", "-"), ("good", "64:0")]
    assert [(r.tissues_with_crops, r.num_crops) for r in tables["crops"].collect()] == [(0, 0)]


def test_inventory_of_folders(spark, tiled):
    tables = collections.load(spark, tiled)
    heads = {r.dataset: r for r in tables["datasets"].collect()}
    assert set(heads) == {"d1", "d2"}
    d1 = heads["d1"]
    assert (d1.num_modalities, d1.loader_modalities, d1.disk_roots, d1.metadata_rows, d1.unique_metadata_tissues) == (3, "he, ihc_cd3, imc", "he, ihc, imc", 4, 2)
    assert (d1.images_best_resolution_total, d1.num_crop_specs, d1.resolutions, d1.num_standardization_specs) == (4, 1, "1_0mpp", 1)
    imc = tables["modalities"].where("dataset = 'd1' and modality = 'imc'").first()
    assert (imc.channel_count, imc.qc_pass_count, imc.image_counts_by_resolution, imc.crop_specs, imc.standardization_specs) == (3, 2, "1_0mpp:2", "1_0mpp/grid/4", "1_0mpp/quantile_clipping/uq_0.9_image")
    crop = tables["crops"].where("dataset = 'd1'").first()
    assert (crop.crop_size, crop.tissues_with_crops) == ("4", 2) and d1.crop_counts_by_size == f"4:{crop.num_crops}"
    kpis = inventory.inventory_kpis(tables["datasets"], tables["modalities"], tables["crops"], tables["specs"]).first()
    assert (kpis.datasets, kpis.modalities, kpis.images, kpis.tile_files, kpis.specs) == (2, 6, 8, 2, 1)
    assert inventory.drill_down(tables, "d2", "he")["modalities"].count() == 1
    assert collections.channels(spark, tiled, ["d2"]).select("dm", "qc_display").distinct().count() == 2
    assert collections.load(spark, tiled, ["none"])["datasets"].collect() == []


def test_tasks_and_driver_find_the_same(spark, tiled, monkeypatch):
    from tessera.sources import store

    def everything():
        tables = {**collections.load(spark, tiled), "channels": collections.channels(spark, tiled).orderBy("dataset", "modality", "channel_index")}
        return {name: (df.dtypes, [r.asDict() for r in df.collect()]) for name, df in tables.items()}

    by_tasks = everything()
    monkeypatch.setattr(store, "reachable", lambda folder: False)
    assert by_tasks == everything() and all(rows for _, rows in by_tasks.values())


def test_many_datasets_are_walked_by_tasks(spark, tmp_path):
    for i in range(60):
        base = tmp_path / f"d{i:02}"
        for name, table in (("metadata/tissues.parquet", {"tissue_id": [1, 2, 2], "modality": ["imc", None, "he"]}), ("imc/channels.parquet", {"channel_name": ["DAPI", None]}), ("tiling/0_5mpp/grid/8_tile_coordinates.parquet", {"tissue_id": ["1", None, "1"]})):
            (base / name).parent.mkdir(parents=True)
            pq.write_table(pa.table(table), base / name)
    context = spark.sparkContext
    context.setJobGroup("walk", "walk")
    tables = collections.load(spark, f"file:{tmp_path}")
    assert len(context.statusTracker().getJobIdsForGroup("walk")) == 0
    rows = tables["crops"].collect()
    assert [(r.crop_size, r.resolution, r.tissues_with_crops, r.num_crops) for r in rows] == [("8", "0_5mpp", 1, 3)] * 60
    heads = tables["datasets"].collect()
    assert [(r.dataset, r.metadata_modalities, r.metadata_rows, r.unique_metadata_tissues) for r in heads] == [(f"d{i:02}", "he, imc", 3, 2) for i in range(60)]
    found = collections.channels(spark, str(tmp_path), ["d07"]).orderBy("channel_index").collect()
    assert [(r.channel_index, r.channel_name) for r in found] == [(0, "DAPI"), (1, None)]


# Repeated channel names, orders of tables and cohorts, stored indices


@pytest.fixture(scope="module")
def repeated(spark, tmp_path_factory):
    """A dataset whose channels DAPI, CD3, CD3 have planes of their own, and rows in no order of their ids."""
    top = tmp_path_factory.mktemp("repeated")
    for name, ids in (("zeta", ["t9", "t1", "t5"]), ("alpha", ["t3", "t2"])):
        base = top / name
        rows = [(t, f"p{len(t) % 2}", "imc", label) for t, label in zip(ids, ["late", "early", "late"], strict=False)]
        spark.createDataFrame(rows, "tissue_id string, patient_id string, modality string, grade string").coalesce(1).write.parquet(str(base / "metadata/tissues.parquet"))
        spark.createDataFrame([(0, "DAPI"), (1, "CD3"), (2, "CD3")], "index int, channel_name string").coalesce(1).write.parquet(str(base / "imc/channels.parquet"))
        masks = base / "segmentations/1_0mpp/tissue_masks"
        masks.mkdir(parents=True)
        for t in ids:
            store(base / f"imc/1_0mpp/images/{t}.ome.zarr/0", multiplex(3))
            np.savez(masks / f"{t}.npz", mask=np.ones((5, 6)))
        coords = [(t, i, 0, c) for t in ids for i, c in ((9, 2), (5, 1))]
        spark.createDataFrame(coords, "tissue_id string, tile_id int, row int, col int").coalesce(1).write.parquet(str(base / "tiling/1_0mpp/grid/4_tile_coordinates.parquet"))
    return str(top)


def test_repeated_channel_names_keep_their_planes(spark, repeated):
    d = ImagingDataset(spark, repeated, "zeta", "imc", strategy="grid", tile_size=4)
    d.compute_statistics(0.9, overwrite=True)
    image = multiplex(3)
    spec = ImagingDataset(spark, repeated, "zeta", "imc", spec="quantile_clipping/uq_0.9_image", z_score=False, strategy="grid", tile_size=4)
    got = {(r.channel_pos, r.y, r.x): r.value for r in spec.pixels("t1").collect()}
    assert len(got) == 90 == spec.pixels("t1").count()
    bound = np.quantile(image[1], 0.9)  # of the first CD3, for both
    assert got[2, 4, 5] == pytest.approx(1) and got[1, 0, 1] == pytest.approx(image[1, 0, 1] / bound, rel=1e-6)
    tile = spec.tile_at("t1", 1, 1)
    assert tile.count() == 48 and len({(r.channel_pos, r.dy, r.dx) for r in tile.collect()}) == 48
    raw = {(r.channel_pos, r.dy, r.dx): r.value for r in d.tile_at("t1", 3, 4, preprocess=False).collect()}
    assert len(raw) == 48 and raw[2, 0, 0] == image[2, 3, 4] and raw[1, 1, 1] == image[1, 4, 5] and raw[1, 2, 0] == 0


def test_labels_patients_and_cohorts_follow_the_tables(spark, repeated):
    d = ImagingDataset(spark, repeated, "zeta", "imc", label="grade")
    assert {r.grade: r.code for r in d.label_codes().collect()} == {"late": 0, "early": 1}
    assert [r.tissue_ids for r in d.patients().collect()] == [["t9", "t1", "t5"]]
    cohort = Cohort(spark, repeated, ["zeta", "alpha"], ["imc"])
    assert [(r.dataset_name, r.tissue_id) for r in cohort.index().orderBy("global_id").collect()] == [("zeta", "t9"), ("zeta", "t1"), ("zeta", "t5"), ("alpha", "t3"), ("alpha", "t2")]
    assert [r.tissue_ids for r in cohort.dataset("alpha").patients().collect()] == [["t3", "t2"]]


def test_stored_index_is_read_by_number(spark, repeated, tmp_path):
    cohort = Cohort(spark, repeated, ["zeta", "alpha"], ["imc"], strategy="grid", tile_size=4)
    want = [(n, t, i) for n, ids in (("zeta", ["t9", "t1", "t5"]), ("alpha", ["t3", "t2"])) for t in ids for i in (9, 5)]
    assert [(r.dataset_name, r.tissue_id, r.tile_id) for r in cohort.index().orderBy("global_id").collect()] == want
    before = {r.draw: (r.dataset_name, r.tissue_id, r.tile_id) for r in cohort.draws(20, 3).collect()}
    stored = index.StoredIndex(spark, str(tmp_path / "index"))
    stored.write(cohort.index(), file_rows=3)
    assert cohort.store_index(str(tmp_path / "index")).size() == cohort.size() == 10
    assert stored.manifest.count() == 4 and stored.manifest.agg(F.max(F.expr("last - first"))).first()[0] <= 3
    row = stored.at(7)
    assert [(r.dataset_name, r.tissue_id, r.tile_id) for r in row.collect()] == [want[7]]
    plan = row._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and len(row.inputFiles()) == 1 and "PushedFilters: [IsNotNull(global_id), EqualTo(global_id,7)]" in plan
    assert {r.draw: (r.dataset_name, r.tissue_id, r.tile_id) for r in cohort.draws(20, 3).collect()} == before
    image = multiplex(3)
    got = {(r.channel_pos, r.dy, r.dx): r.value for r in cohort.at(1, "complete").collect()}
    assert len(got) == 48 and got[2, 1, 1] == image[2, 1, 2]  # tile 5 of t9, at column 1, whatever the ids
    assert {r.tissue_id for r in cohort.at(-1, "complete").collect()} == {"t2"}
    for wrong in (10, -11):
        with pytest.raises(IndexError):
            cohort.at(wrong)
    assert stored.at(99).collect() == [] == stored.numbers([]).collect()
