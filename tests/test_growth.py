"""Statistics from counts of values that grow with a cohort."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.dataset import ImagingDataset
from tessera.operators import states, stats
from tests.test_dataset import multiplex, store


def rows_of(df, keys):
    return {tuple(r[k] for k in keys): {c: r[c] for c in df.columns if c not in keys} for r in df.collect()}


def same(got, want):
    assert got.keys() == want.keys()
    for k, row in want.items():
        for c, v in row.items():
            assert got[k][c] == v if v is None or isinstance(v, int) else math.isclose(got[k][c], v, rel_tol=1e-9, abs_tol=1e-12), (k, c)


@pytest.fixture(scope="module")
def pixels(spark):
    """Ties, constants, negatives, missing and not finite values, and a channel that has only those."""
    rng = np.random.default_rng(5)
    rows = [(f"t{t}", c, float(v)) for t in range(4) for c in ("A", "B") for v in rng.integers(-3, 40, 300)]
    rows += [(f"t{t}", "B", float(rng.normal())) for t in range(4) for _ in range(200)]
    rows += [("t1", "one", 7.3)] * 9 + [("t2", "one", 7.3)] * 4 + [("t0", "A", None), ("t0", "B", float("nan")), ("t3", "A", float("inf"))]
    rows += [("t2", "none", None), ("t2", "none", float("nan"))]
    return spark.createDataFrame(rows, "tissue_id string, channel string, value double").repartition(5).cache()


@pytest.mark.parametrize(("quantile_level", "stats_level", "spec"), [("image", "image", "quantile_clipping"), ("image", "global", "quantile_clipping_log1p"), ("global", "image", "identity"), ("global", "global", "quantile_clipping")])
def test_counts_give_the_statistics_of_the_pixels(pixels, quantile_level, stats_level, spec):
    counts = states.counted(pixels)
    bounds, plain = states.quantiles(counts, quantile_level, 0.95, 0.02), stats.quantiles(pixels, quantile_level, 0.95, 0.02)
    same(rows_of(bounds, stats.LEVELS[quantile_level]), rows_of(plain, stats.LEVELS[quantile_level]))
    finite = pixels.withColumn("value", stats.finite(F.col("value")))
    got, want = states.moments(counts, bounds, quantile_level, stats_level, spec), stats.moments(finite, plain, quantile_level, stats_level, spec)
    same(rows_of(got, stats.LEVELS[stats_level]), rows_of(want, stats.LEVELS[stats_level]))
    assert {r["std"] for r in got.where("channel = 'one'").collect()} <= {0.0}


def test_batches_are_counted_once_and_compacted(spark, pixels, tmp_path):
    counts = states.PixelCounts(spark, str(tmp_path / "counts"))
    assert counts.table().count() == 0 and counts.batches() == []
    assert counts.add(pixels.where("tissue_id = 't0'"), "first") and not counts.add(pixels, "first")
    assert counts.add(pixels.where("tissue_id in ('t1', 't2') and channel = 'A'"), "second")
    counts.compact()
    assert counts.batches() == ["first", "second"] and not counts.add(pixels, "second")
    assert counts.add(pixels.where("tissue_id in ('t1', 't2') and channel <> 'A'"))
    assert counts.add_new(pixels)  # t3 is left
    whole = rows_of(states.counted(pixels), states.KEYS)
    assert rows_of(states.added(counts.table(), states.KEYS), states.KEYS) == whole
    counts.compact()
    assert rows_of(counts.table(), states.KEYS) == whole
    with pytest.raises(ValueError, match="name"):
        counts.add(pixels, "a/b")


def test_a_batch_half_written_counts_nothing(spark, pixels, tmp_path):
    counts = states.PixelCounts(spark, str(tmp_path))
    counts.add(pixels, "whole")
    before = counts.table().count()
    states.counted(pixels).write.parquet(str(tmp_path / "generation-0/batch-torn.writing-1"))
    states.counted(pixels).write.parquet(str(tmp_path / "making-1/batch-"))
    assert counts.table().count() == before and counts.batches() == ["whole"]


def test_a_stream_adds_to_the_counts(spark, pixels, tmp_path):
    source = str(tmp_path / "pixels")
    counts = states.PixelCounts(spark, str(tmp_path / "counts"))
    for part in (0, 1):
        pixels.where(F.abs(F.hash("value", "tissue_id")) % 2 == part).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(pixels.schema).parquet(source)
        counts.follow(stream, str(tmp_path / "checkpoint"), availableNow=True).awaitTermination()
    assert counts.batches() == ["stream-0", "stream-1"]
    assert rows_of(states.added(counts.table(), states.KEYS), states.KEYS) == rows_of(states.counted(pixels), states.KEYS)


def test_new_tissues_are_read_and_old_ones_are_not(spark, tmp_path):
    def tissues(names):
        rows = [(t, "p", "imc") for t in names]
        spark.createDataFrame(rows, "tissue_id string, patient_id string, modality string").coalesce(1).write.mode("overwrite").parquet(str(base / "metadata/tissues.parquet"))

    def come(t, factor):
        store(base / f"imc/1_0mpp/images/{t}.ome.zarr/0", multiplex(2) * np.float32(factor))
        mask = np.ones((5, 6))
        mask[0, :3] = 0
        np.savez(masks / f"{t}.npz", mask=mask)

    base = tmp_path / "d"
    masks = base / "segmentations/1_0mpp/tissue_masks"
    masks.mkdir(parents=True)
    spark.createDataFrame([(0, "DAPI"), (1, "CD3")], "index int, channel_name string").coalesce(1).write.parquet(str(base / "imc/channels.parquet"))
    come("t1", 1), come("t2", 3)
    tissues(["t1", "t2"])
    how = {"quantile_level": "global", "stats_level": "global"}
    ImagingDataset(spark, str(tmp_path), "d", "imc").update_statistics(0.9, 0.1, **how)
    # what was read before can't be read again
    kept = {f: f.read_bytes() for t in ("t1", "t2") for f in [masks / f"{t}.npz", *(base / f"imc/1_0mpp/images/{t}.ome.zarr/0").glob("?.0.0")]}
    for f in kept:
        f.write_bytes(b"unreadable")
    come("t3", 0.5)
    tissues(["t1", "t2", "t3"])
    d = ImagingDataset(spark, str(tmp_path), "d", "imc")
    written = d.update_statistics(0.9, 0.1, **how)
    d.update_statistics(0.9, 0.1)  # nothing new: other levels of the same counts
    assert len(d.pixel_counts.batches()) == 2
    got = {f.split("/")[-1]: spark.read.parquet(f).first().asDict() for f in written}
    for f, data in kept.items():
        f.write_bytes(data)
    again = d.compute_statistics(0.9, 0.1, overwrite=True, **how)
    assert written == again and len(again) == 4
    for f in again:
        assert got[f.split("/")[-1]] == pytest.approx(spark.read.parquet(f).first().asDict())
