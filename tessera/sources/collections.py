"""The inventory of a folder of datasets: what its folders and small tables say, as DataFrames.

Folders are listed by name, image stores counted without looking into them. Tasks walk the
datasets' folders (walk); where they can't reach them, the driver lists them and Spark reads
the tables, a column or two of each.
"""

from __future__ import annotations

import functools

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import inventory
from tessera.sources import catalog, store, walk
from tessera.sources.walk import COORDINATES

EMPTY_CHANNELS = "dataset string, modality string, channel_index int, channel_name string, uniprot_id string, qc_pass boolean, description string, is_nuclear_marker boolean, channels_path string"
LISTED = "dataset string, modality string, root string, resolution string, stores int, modality_path string"
CROP_FILES = "dataset string, resolution string, tiling_method string, crop_file string, crop_size string, path string"
SPECS = "dataset string, modality string, resolution string, spec string, path string"


def _folders(spark: SparkSession, path: str, end: str = "") -> list[str]:
    return [n for n, is_folder in catalog.children(spark, path) if is_folder and n.endswith(end)]


def _union(parts: list[DataFrame], spark: SparkSession, schema: str) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)


def _stores(spark: SparkSession, folder: str) -> int:
    images = f"{folder}/images"
    return len(_folders(spark, images if catalog.exists(spark, images) else folder, ".zarr"))


def _tissues(spark: SparkSession, root: str, dataset: str) -> DataFrame | None:
    """(dataset, modality, tissue_id) of a readable metadata table; None where there is none."""
    try:
        rows = catalog.tissues(spark, root, dataset)
    except (PySparkException, Py4JJavaError):
        return None
    columns = [(F.col(c).cast("string") if c in rows.columns else F.lit(None).cast("string")).alias(c) for c in ("modality", "tissue_id")]
    return rows.select(F.lit(dataset).alias("dataset"), *columns)


def _spec_folders(spark: SparkSession, folder: str) -> list[str]:
    """Folders with statistics, one or two levels below `standardization`."""

    def holds(path: str) -> bool:
        return any(n.endswith(".parquet") for n, _ in catalog.children(spark, path))

    found = []
    for method in _folders(spark, folder):
        if method.endswith(".parquet"):
            continue
        found += [method] if holds(f"{folder}/{method}") else []
        found += [f"{method}/{s}" for s in _folders(spark, f"{folder}/{method}") if not s.endswith(".parquet") and holds(f"{folder}/{method}/{s}")]
    return found


def _crops(spark: SparkSession, files: list[tuple]) -> DataFrame:
    """Crop files with their tissues and crops; a file that can't be read counts none."""
    parts = []
    for dataset, resolution, method, name, path in files:
        row = spark.createDataFrame([(dataset, resolution, method, name, name.removesuffix(COORDINATES), path)], CROP_FILES)
        try:
            coords = spark.read.parquet(path)
            counts = inventory.crop_file_summary(coords.select("tissue_id")) if "tissue_id" in coords.columns else coords.agg(F.lit(0).cast("long").alias("tissues_with_crops"), F.count("*").alias("num_crops"))
        except (PySparkException, Py4JJavaError):
            counts = spark.createDataFrame([(0, 0)], "tissues_with_crops long, num_crops long")
        parts.append(row.join(counts))  # one row each
    return _union(parts, spark, f"{CROP_FILES}, tissues_with_crops long, num_crops long")


def _wanted(spark: SparkSession, root: str, allow: list[str] | None) -> list[str]:
    return [d for d in _folders(spark, root) if allow is None or d in allow]


def _of_facts(facts: DataFrame, kind: str, schema: str, **columns) -> DataFrame:
    """Facts of a kind with a schema's columns, some of which have other names among the facts."""
    of = F.col("kind") == kind
    names = [c.split() for c in schema.split(", ")]
    return facts.where(of).select(*[(columns[c] if c in columns else F.col(c)).cast(t).alias(c) for c, t in names])


def channels(spark: SparkSession, root: str, allow: list[str] | None = None) -> DataFrame:
    """The channel tables of all multiplex modalities with the derived columns of the channel inventory."""
    wanted = _wanted(spark, root, allow)
    if store.reachable(root):
        return _channels_of(walk.facts(spark, root, wanted, channels_only=True))
    return _channels_by_driver(spark, root, wanted)


def _channels_of(facts: DataFrame) -> DataFrame:
    return inventory.channel_inventory(_of_facts(facts, "channel", EMPTY_CHANNELS, channel_index=F.col("n"), channel_name=F.col("name"), channels_path=F.col("path")))


def _channels_by_driver(spark: SparkSession, root: str, wanted: list[str]) -> DataFrame:
    parts = []
    for dataset in wanted:
        for modality in inventory.MULTIPLEX:
            path = f"{root}/{dataset}/{modality}/channels.parquet"
            if not catalog.exists(spark, path):
                continue
            rows = spark.read.parquet(path)
            if "channel_name" not in rows.columns:
                continue
            place = F.col("index").cast("int") if "index" in rows.columns else F.col("_metadata.row_index").cast("int")
            kinds = {"channel_name": "string", "uniprot_id": "string", "qc_pass": "boolean", "description": "string", "is_nuclear_marker": "boolean"}
            own = [(F.col(c) if c in rows.columns else F.lit(None)).cast(k).alias(c) for c, k in kinds.items()]
            parts.append(rows.select(F.lit(dataset).alias("dataset"), F.lit(modality).alias("modality"), place.alias("channel_index"), *own, F.lit(path).alias("channels_path")))
    return inventory.channel_inventory(_union(parts, spark, EMPTY_CHANNELS))


HEADS = "dataset string, metadata_modalities string, disk_roots string, metadata_path string"
TISSUES = "dataset string, modality string, tissue_id string"


def load(spark: SparkSession, root: str, allow: list[str] | None = None) -> dict[str, DataFrame]:
    """datasets, modalities, crops and specs of a folder of datasets, each in its order.

    Datasets without a readable metadata table are left out; `allow` names those wanted. The
    folders are walked once, by the first action on one of the tables, which share what it found.
    """
    wanted = _wanted(spark, root, allow)
    return _tables(*(_by_tasks if store.reachable(root) else _by_driver)(spark, root, wanted))


def _by_tasks(spark: SparkSession, root: str, wanted: list[str]) -> tuple[DataFrame, ...]:
    found = walk.facts(spark, root, wanted).persist()
    places = _of_facts(found, "level", LISTED, root=F.split("modality", "_")[0], resolution=F.col("level"), stores=F.col("n"), modality_path=F.col("path"))
    crops = _of_facts(found, "crop", f"{CROP_FILES}, tissues_with_crops long, num_crops long", resolution=F.col("level"), tiling_method=F.col("method"), crop_file=F.col("name"), crop_size=F.regexp_replace("name", f"{COORDINATES}$", ""), tissues_with_crops=F.col("n"), num_crops=F.col("m"))
    specs = _of_facts(found, "spec", SPECS, resolution=F.col("level"), spec=F.col("name"))
    heads = _of_facts(found, "head", HEADS, metadata_modalities=F.col("name"), disk_roots=F.col("level"), metadata_path=F.col("path"))
    return _of_facts(found, "tissue", TISSUES, tissue_id=F.col("name")), places, crops, specs, heads, _channels_of(found)


def _by_driver(spark: SparkSession, root: str, wanted: list[str]) -> tuple[DataFrame, ...]:
    tissues, listed, crop_files, specs, heads = [], [], [], [], []
    for dataset in wanted:
        rows = _tissues(spark, root, dataset)
        if rows is None:
            continue
        tissues.append(rows)
        base = f"{root}/{dataset}"
        named = sorted(r["modality"] for r in rows.select("modality").distinct().dropna().collect())
        roots = [n for n in _folders(spark, base) if n in (*catalog.MODALITIES, "ihc", "mif")]
        on_disk = [n for n in roots if n in catalog.MODALITIES] + [n for n in _folders(spark, f"{base}/ihc") if n.startswith("ihc_")]
        known = [m for m in named if m in catalog.MODALITIES or m.startswith("ihc_")]
        heads.append((dataset, ", ".join(named), ", ".join(roots), f"{base}/metadata/tissues.parquet"))
        for modality in sorted({*known, *on_disk}):
            folder = f"{base}/{catalog.modality_dir(modality)}"
            levels = _folders(spark, folder, "mpp")
            listed += [(dataset, modality, modality.split("_")[0], level, _stores(spark, f"{folder}/{level}"), folder) for level in levels] or [(dataset, modality, modality.split("_")[0], None, None, folder)]
            if modality in inventory.MULTIPLEX:
                specs += [(dataset, modality, level, spec, f"{folder}/{level}/standardization/{spec}") for level in levels for spec in _spec_folders(spark, f"{folder}/{level}/standardization")]
        for level in _folders(spark, f"{base}/tiling", "mpp"):
            for method in _folders(spark, f"{base}/tiling/{level}"):
                at = f"{base}/tiling/{level}/{method}"
                crop_files += [(dataset, level, method, n, f"{at}/{n}") for n, _ in catalog.children(spark, at) if n.endswith(COORDINATES)]

    every = _union(tissues, spark, TISSUES)
    places, spec_rows = spark.createDataFrame(listed, LISTED), spark.createDataFrame(specs, SPECS)
    return every, places, _crops(spark, crop_files), spec_rows, spark.createDataFrame(heads, HEADS), _channels_by_driver(spark, root, wanted)


def _tables(every: DataFrame, places: DataFrame, crops: DataFrame, specs: DataFrame, heads: DataFrame, channel_rows: DataFrame) -> dict[str, DataFrame]:
    per_pair = inventory.modality_rows(places, channel_rows, every, crops, specs)
    per_pair = per_pair.join(places.select("dataset", "modality", "modality_path").distinct(), ["dataset", "modality"])
    head = heads.join(every.groupBy("dataset").agg(F.count("*").alias("metadata_rows"), F.count_distinct("tissue_id").alias("unique_metadata_tissues")), "dataset", "left")
    tables = {"datasets": inventory.dataset_summary(head, per_pair, crops, specs), "modalities": per_pair, "crops": crops, "specs": specs}
    return inventory.drill_down(tables)
