"""Python functions of one's own in the places of Column functions."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import user
from tessera.operators import metadata, stats


@pytest.fixture()
def transforms():
    before = dict(stats.TRANSFORMS)
    yield
    stats.TRANSFORMS.clear()
    stats.TRANSFORMS.update(before)


def test_a_python_transform_standardizes(spark, transforms):
    rows = [("t", "A", float(v)) for v in range(20)] + [("t", "A", None), ("u", "A", 3.0), ("u", "B", None)]
    px = spark.createDataFrame(rows, "tissue_id string, channel string, value double")
    bounds = stats.quantiles(px, "image", 0.9, 0.1)
    user.register_transform("mine", lambda v, low, high: (np.minimum(np.maximum(v, low), high) - low) / (high - low + stats.EPSILON))
    got = stats.moments(px, bounds, "image", "image", "mine/uq_0.9_lq_0.1_image").orderBy("tissue_id").collect()
    want = stats.moments(px, bounds, "image", "image", "quantile_clipping").orderBy("tissue_id").collect()
    assert [(r.tissue_id, r.n) for r in got] == [(r.tissue_id, r.n) for r in want] == [("t", 20), ("u", 1)]
    assert [r.mean for r in got] == pytest.approx([r.mean for r in want])
    # NULL stays NULL: no row of a batch takes the place of another
    z = stats.transformed(px, bounds, "image", "mine").where("value is null").select("z").collect()
    assert [r.z for r in z] == [None]
    assert stats.moments(px.where("false"), bounds, "image", "image", "mine").collect() == []


def test_transforms_of_bad_names_and_shapes_are_errors(spark, transforms):
    for name in ("quantile_clipping", "identity", "a/b", ""):
        with pytest.raises(ValueError):
            user.register_transform(name, lambda v, low, high: v)
    short = user.of_arrays(lambda v: v[:1])
    with pytest.raises(Exception, match="shape"):
        spark.range(0, 4, 1, 1).select(short(F.col("id"))).collect()


def test_a_python_function_changes_labels(spark):
    rows = [(3, "b", "Low-1"), (1, "a", "HIGH-2"), (2, "a", None), (0, "b", "low-7")]
    tissues = spark.createDataFrame(rows, "pos int, split string, grade string").repartition(3)
    change = user.of_values(lambda label: label.split("-")[0].lower())
    made = metadata.filtered(tissues, label="grade", change=change)
    assert [(r.pos, r.grade) for r in made.orderBy("pos").collect()] == [(0, "low"), (1, "high"), (2, None), (3, "low")]
    assert [(r.grade, r.code) for r in metadata.label_codes(made, "grade").collect()] == [("low", 0), ("high", 1)]
    numbers = user.of_values(lambda label: len(label), "int")
    assert [r.n for r in tissues.orderBy("pos").select(numbers("grade").alias("n")).collect()] == [5, 6, None, 5]


def test_a_value_is_passed_once_a_batch(spark):
    """A function that counts its calls: many equal labels cost one."""
    calls = []

    def counting(label):
        calls.append(label)
        return f"{label}:{len(calls)}"

    rows = spark.range(0, 1000, 1, 1).select((F.col("id") % 2).cast("string").alias("label"))
    made = {r[0] for r in rows.select(user.of_values(counting)("label").alias("x")).distinct().collect()}
    assert made == {"0:1", "1:2"}
