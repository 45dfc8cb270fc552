"""Tissue metadata: filters, label codes, patients, modalities and cohort indices."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def filtered(tissues: DataFrame, split: str | None = None, label: str | None = None, keep: list | None = None, change: Callable[[Column], Column] | None = None, modality: str | None = None) -> DataFrame:
    """Split, then label, then modality filter, each optional; `keep` None keeps all labels."""
    if split is not None:
        if "split" not in tissues.columns:
            raise ValueError("there is no column split")
        tissues = tissues.where(F.col("split") == split)
        if tissues.isEmpty():
            raise ValueError(f"no tissue is in split {split!r}")
    if label is not None:
        if keep is not None:
            tissues = tissues.where(F.col(label).isin(keep))
        if change is not None:
            tissues = tissues.withColumn(label, change(F.col(label)))
    return tissues if modality is None else tissues.where(F.col("modality") == modality)


def label_codes(tissues: DataFrame, label: str, position: str = "pos") -> DataFrame:
    """(label, code): codes from 0 in order of first appearance."""
    first = tissues.where(F.col(label).isNotNull()).groupBy(label).agg(F.min(position).alias("first"))
    # One row for each label: a small table.
    return first.withColumn("code", F.row_number().over(Window.orderBy("first")) - 1).select(label, "code")


def patients(tissues: DataFrame) -> DataFrame:
    """(patient_id, tissue_ids) in table order, without tissues of unknown patients."""
    each = F.array_sort(F.collect_list(F.struct("pos", "tissue_id")))
    known = tissues.where("patient_id is not null").groupBy("patient_id").agg(each.alias("t"))
    return known.select("patient_id", F.col("t.tissue_id").alias("tissue_ids"))


def of_patient(tissues: DataFrame, patient: object) -> DataFrame:
    return tissues.where(F.col("patient_id").cast("string") == str(patient))


def modalities(tissues: DataFrame, requested: list[str]) -> DataFrame:
    """(tissue_id, modalities) in the order requested, of tissues that have one."""
    order = F.array_position(F.array(*[F.lit(m) for m in requested]), F.col("modality"))
    each = F.array_sort(F.collect_set(F.struct(order.alias("o"), "modality")))
    return tissues.where(F.col("modality").isin(requested)).groupBy("tissue_id").agg(each.alias("m")).select("tissue_id", F.col("m.modality").alias("modalities"))


def composed(samples: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each key with a map from modality to the sample's other columns.

    Of several samples of a modality the one with the greatest columns counts.
    """
    rest = [c for c in samples.columns if c not in (*keys, "modality")]
    once = samples.groupBy(*keys, "modality").agg(F.max(F.struct(*rest)).alias("sample"))
    each = F.map_from_entries(F.array_sort(F.collect_list(F.struct("modality", "sample"))))
    return once.groupBy(*keys).agg(each.alias("samples"))


def tissue_index(parts: dict[str, DataFrame]) -> DataFrame:
    """(dataset_name, tissue_id, modalities) of all datasets that have tissues of their own."""
    out = None
    for name, part in parts.items():
        one = part.select(F.lit(name).alias("dataset_name"), F.col("tissue_id").cast("string").alias("tissue_id"), "modalities")
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no dataset has a modality that was asked for")
    return out


def tile_index(coords: DataFrame, dataset: str = "dataset_name") -> DataFrame:
    """coords with global_tile_id, dense from 0 in order of dataset, tissue and tile.

    Numbers come from counts of each dataset and tissue, added up, so no single task sorts
    all tiles; the table of counts has a row for each tissue.
    """
    counts = coords.groupBy(dataset, "tissue_id").agg(F.count("*").alias("n"))
    in_dataset = Window.partitionBy(dataset).orderBy("tissue_id").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("before", F.coalesce(F.sum("n").over(in_dataset), F.lit(0))).drop("n")
    totals = counts.groupBy(dataset).agg(F.sum("n").alias("n"))
    over = Window.orderBy(dataset).rowsBetween(Window.unboundedPreceding, -1)  # a row for each dataset
    totals = totals.withColumn("base", F.coalesce(F.sum("n").over(over), F.lit(0))).drop("n")
    place = F.row_number().over(Window.partitionBy(dataset, "tissue_id").orderBy("tile_id")) - 1
    numbered = coords.withColumn("place", place).join(starts, [dataset, "tissue_id"]).join(totals, dataset)
    return numbered.withColumn("global_tile_id", F.col("base") + F.col("before") + F.col("place")).drop("base", "before", "place")


def of_dataset(coords: DataFrame, tissues: DataFrame) -> DataFrame:
    """Coordinates of tissues that the dataset has, ids compared as text."""
    ids = tissues.select(F.col("tissue_id").cast("string").alias("id")).distinct()
    return coords.join(ids, F.col("tissue_id").cast("string") == F.col("id"), "left_semi")


def drawn(keys: list, seed: int) -> Column:
    """A reproducible 60-bit number for the keys' values, by a hash that other engines have too."""
    text = F.concat_ws("|", F.lit(str(seed)), *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def sample(index: DataFrame, n: int, seed: int, keys: list[str]) -> DataFrame:
    """n reproducible rows, each drawn with equal chance and without regard to order."""
    return index.orderBy(drawn(keys, seed), *keys).limit(n)


def sample_with_replacement(index: DataFrame, n: int, seed: int, row_id: str) -> DataFrame:
    """n reproducible draws from a table whose row_id is dense from 0; a row may come again."""
    size = index.count()
    draws = index.sparkSession.range(n).select((drawn(["id"], seed) % size).alias(row_id), F.col("id").alias("draw"))
    return draws.join(index, row_id)


def resolution_name(resolution: Column) -> Column:
    """1.0 as 1_0mpp."""
    return F.concat(F.replace(resolution.cast("double").cast("string"), F.lit("."), F.lit("_")), F.lit("mpp"))
