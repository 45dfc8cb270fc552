"""Datasets on disk: folder names, modality names, and what the folders hold, as DataFrames.

Listings go through Spark's own file source, so any store that Spark reads will do.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Environment variable with the folder that holds all datasets.
ROOT_VARIABLE = "TESSERA_DATASETS"
#: Canonical modality names, and other names of them (fixed values).
MODALITIES = ["he", "imc", "codex", "cycif", "mibi"]
ALIASES = {"phenocycler": "codex"}


def datasets_root(spark: SparkSession, root: str | None = None) -> str:
    """The folder given, or the session's or environment's."""
    found = root or spark.conf.get("tessera.datasets", None) or os.environ.get(ROOT_VARIABLE)
    if not found:
        raise ValueError(f"give the datasets' folder, or set tessera.datasets or {ROOT_VARIABLE}")
    return found.rstrip("/")


def canonical_modality(name: Column) -> Column:
    """Without regard to case; other names replaced; NULL for unknown ones. ihc_<marker> stays."""
    lower = F.lower(F.trim(name))
    alias = F.create_map(*[F.lit(v) for pair in ALIASES.items() for v in pair])
    known = F.coalesce(F.try_element_at(alias, lower), lower)
    return F.when(known.isin(MODALITIES) | known.startswith("ihc"), known)


def modality_dir(modality: str) -> str:
    """imc for imc, ihc/ihc_cd3 for ihc_cd3 or the marker cd3 of ihc."""
    return f"ihc/{modality}" if modality.startswith("ihc") else modality


def resolution_dir(resolution: float) -> str:
    return str(float(resolution)).replace(".", "_") + "mpp"


def expanded_modalities(spark: SparkSession, root: str, dataset: str, requested: list[str] | None, more: list[str] | None = None) -> list[str]:
    """Modalities of a dataset's folders: what was asked for and is there, in that order; None asks for all.

    `ihc` stands for all of its markers, in order, where it is named; `more` names further modalities.
    """
    every = [*MODALITIES, *(more or [])]
    there = [n for n, is_folder in children(spark, f"{root}/{dataset}") if is_folder and n in every]
    markers = [n for n, is_folder in children(spark, f"{root}/{dataset}/ihc") if is_folder and n.startswith("ihc_")]
    if requested is None:
        return [m for m in every if m in there] + markers
    out = []
    for name in requested:
        key = ALIASES.get(name.strip().lower(), name.strip().lower())
        out += markers if key == "ihc" else [key] if key in there or key in markers else []
    return list(dict.fromkeys(out))


def marker_modality(marker: str) -> str:
    """The modality of an IHC marker, with its prefix once: cd3 and ihc_cd3 are ihc_cd3."""
    return marker if marker.startswith("ihc_") else f"ihc_{marker}"


def spec_dir(method: str, upper: float, lower: float | None, level: str) -> str:
    """quantile_clipping/uq_0.99_lq_0.01_image and the like."""
    low = "" if lower is None else f"_lq_{lower}"
    return f"{method}/uq_{upper}{low}_{level}"


def coords_path(root: str, dataset: str, resolution: float, strategy: str, size: int) -> str:
    return f"{root}/{dataset}/tiling/{resolution_dir(resolution)}/{strategy}/{size}_tile_coordinates.parquet"


def files(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """(path, length) of the files below a folder whose names fit the glob; content isn't read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return found.select("path", "length")


def _path(spark: SparkSession, path: str):
    """(file system, path) as Hadoop has them."""
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), found


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _path(spark, path)
    return fs.exists(at)


def children(spark: SparkSession, path: str) -> list[tuple[str, bool]]:
    """(name, whether it is a folder) of what a folder holds, in order; nothing if there is no such folder.

    One listing, of names only: what is in the folders below isn't looked at.
    """
    fs, at = _path(spark, path)
    if not fs.exists(at):
        return []
    return sorted((s.getPath().getName(), s.isDirectory()) for s in fs.listStatus(at))


def replace(spark: SparkSession, df: DataFrame, path: str) -> None:
    """Write df and put it in the place of what was at the path, once it is complete."""
    fs, at = _path(spark, path)
    made = f"{path}.writing-{uuid.uuid4().hex}"
    df.write.parquet(made)
    aside = _path(spark, f"{made}.before")[1]
    before = fs.exists(at) and fs.rename(at, aside)  # never without one of the two
    if not fs.rename(_path(spark, made)[1], at):
        if before:
            fs.rename(aside, at)
        raise OSError(f"can't put {made} in the place of {path}")
    if before:
        fs.delete(aside, True)


def text_of(spark: SparkSession, path: str) -> str:
    """A small file, hidden ones too, which Spark's readers leave out."""
    fs, at = _path(spark, path)
    stream = fs.open(at)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _part(n: int) -> Column:
    """The n-th folder below the datasets' root."""
    return F.get(F.split(F.col("below"), "/"), F.lit(n))


def below_root(listing: DataFrame, root: str) -> DataFrame:
    """A listing with dataset and what follows it; the root may carry a scheme or none."""
    tail = root.split("://")[-1].rstrip("/")
    return listing.withColumn("below", F.expr(f"substring_index(path, '{tail}/', -1)")).withColumns({"dataset": _part(0), "rest": F.expr("substring(below, length(substring_index(below, '/', 1)) + 2)")})


def modalities_on_disk(listing: DataFrame) -> DataFrame:
    """(dataset, modality) of folders that belong to a modality; ihc only by marker."""
    one = F.when(_part(1) == "ihc", F.when(_part(2).startswith("ihc_"), _part(2))).when(_part(1).isin(MODALITIES), _part(1))
    return listing.select("dataset", one.alias("modality")).where("modality is not null").distinct()


def datasets_of_modality(modalities: DataFrame, modality: str) -> DataFrame:
    wanted = MODALITIES[1:] if modality == "multiplex" else [modality]
    return modalities.where(F.col("modality").isin(wanted)).select("dataset").distinct()


def requested_modalities(available: DataFrame, requested: list[str] | None) -> DataFrame:
    """(dataset, modality, place): what is there of what was asked for, in that order.

    A bare `ihc` stands for every marker that is there; nothing asked for means all.
    """
    if requested is None:
        return available.withColumn("place", F.lit(0))
    order = F.array(*[F.lit(r) for r in requested])
    place = F.array_position(order, F.col("modality"))
    bare = F.when(F.col("modality").startswith("ihc_"), F.array_position(order, F.lit("ihc"))).otherwise(0)
    return available.withColumn("place", F.greatest(place, bare)).where("place > 0")


def image_stores(listing: DataFrame) -> DataFrame:
    """(dataset, stores): image folders that end in .zarr, each once however many files it has."""
    store = F.regexp_extract("below", r"^(.*?\.zarr)(/|$)", 1)
    return listing.withColumn("store", store).where("store <> ''").groupBy("dataset").agg(F.count_distinct("store").alias("stores"))


def standardization_specs(listing: DataFrame) -> DataFrame:
    """(dataset, spec) of folders below standardization that hold statistics, one or two levels deep."""
    spec = F.regexp_extract("below", r"/standardization/(.+)/[^/]+\.parquet", 1)
    return listing.select("dataset", spec.alias("spec")).where("spec <> ''").distinct()


def mask_types(listing: DataFrame) -> DataFrame:
    """Task masks of cells; folders of instance masks aren't tasks."""
    kind = F.regexp_extract("below", r"/cell_masks/([^/]+)/", 1)
    return listing.select("dataset", kind.alias("mask_type")).where("mask_type <> '' and not startswith(mask_type, 'instances')").distinct()


def allow_list(spark: SparkSession, path: str) -> DataFrame:
    """Names of a text file, without blank lines and comments."""
    lines = spark.read.text(path).select(F.trim("value").alias("dataset"))
    return lines.where("dataset <> '' and not startswith(dataset, '#')").distinct()


def tissues(spark: SparkSession, root: str, dataset: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{dataset}/metadata/tissues.parquet")


def placed(rows: DataFrame) -> DataFrame:
    """A table's rows with `pos`, their place in it: (file, row), by its files' names and their rows."""
    return rows.withColumn("pos", F.struct(F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row")))


#: Statistics files by the column that they fill.
STATISTICS = {"upper": "upper_quantiles", "lower": "lower_quantiles", "mean": "means", "std": "stds"}


def statistics(spark: SparkSession, folder: str, level: str, channels: DataFrame) -> DataFrame:
    """All statistics files of one level in long form, aligned to the channels."""
    return statistics_of(spark, folder, level, channels, list(STATISTICS))


def statistics_of(spark: SparkSession, folder: str, level: str, channels: DataFrame, columns: list[str]) -> DataFrame:
    """([tissue_id,] channel and the columns): wide files in long form, missing values NULL.

    The lower quantiles are optional; the other files must be there.
    """
    out = channels.select(F.col("channel_name").alias("channel")).distinct()
    keys = ["tissue_id", "channel"] if level == "image" else ["channel"]
    for column in columns:
        try:
            wide = spark.read.parquet(f"{folder}/{level}_level_{STATISTICS[column]}.parquet")
        except Exception as error:
            if column != "lower" or "PATH_NOT_FOUND" not in str(error):
                raise
            out = out.withColumn(column, F.lit(None).cast("double"))
            continue
        names = [c for c in wide.columns if c != "tissue_id"]
        wide = _first_rows(wide) if level == "image" else wide
        rows = wide.unpivot([c for c in keys if c == "tissue_id"], names, "channel", column).withColumn(column, F.nanvl(column, F.lit(None)))
        out = out.join(rows, [k for k in keys if k in out.columns], "left")
    return out


def _first_rows(wide: DataFrame) -> DataFrame:
    """The first row of each tissue, in order of the files and of their rows."""
    order = Window.partitionBy("tissue_id").orderBy(F.col("_metadata.file_name"), F.col("_metadata.row_index"))
    return wide.withColumn("nth", F.row_number().over(order)).where("nth = 1").drop("nth")


def with_statistics(rows: DataFrame, table: DataFrame, columns: list[str]) -> DataFrame:
    """rows(tissue_id, channel, ...) with the columns of a long statistics table.

    A tissue that the table lacks has no values, unless the table has one tissue only: that
    one then holds for all.
    """
    if "tissue_id" not in table.columns:
        return rows.join(table, "channel", "left")
    joined = rows.join(table, ["tissue_id", "channel"], "left")
    few = table.where("tissue_id is not null").select("tissue_id").distinct().limit(2).collect()
    if len(few) != 1:
        return joined
    only = table.where(F.col("tissue_id") == few[0][0]).select("channel", *[F.col(c).alias(f"only_{c}") for c in columns])
    known = F.col("tissue_id") == few[0][0]
    filled = joined.join(only, "channel", "left").withColumns({c: F.when(known, F.col(c)).otherwise(F.col(f"only_{c}")) for c in columns})
    return filled.drop(*[f"only_{c}" for c in columns])
