"""Which channels of a tissue are measured, pass quality control and are identified."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Six-character accessions of the O, P and Q kind, with an optional isoform (fixed value).
UNIPROT = r"^[OPQ][0-9][A-Z0-9]{3}[0-9](?:-[0-9]+)?$"
#: Accession that stands for nuclear markers (fixed value).
NUCLEAR_UNIPROT = "P68431"
KINDS = ("complete", "qc_filtered", "uniprot_filtered")


def uniprot_ok(uniprot: Column) -> Column:
    return F.coalesce(uniprot.rlike(UNIPROT), F.lit(False))


def replace_nuclear(uniprot: Column, nuclear: Column) -> Column:
    return F.when(F.coalesce(nuclear, F.lit(False)), F.lit(NUCLEAR_UNIPROT)).otherwise(uniprot)


def default_map(tissues: DataFrame, channels: DataFrame) -> DataFrame:
    """Every channel measured in every tissue, for modalities without a map of their own."""
    few = channels.select("channel_pos", "channel_name")
    return tissues.select("tissue_id").distinct().crossJoin(few).withColumn("measured", F.lit(True))


def long_map(wide: DataFrame, tissue: str = "tissue_id") -> DataFrame:
    """A wide 0/1 table as (tissue_id, channel_name, measured); NULL and NaN are not measured."""
    names = [c for c in wide.columns if c != tissue]
    rows = wide.select(tissue, *[F.col(n).cast("double").alias(n) for n in names]).unpivot(tissue, names, "channel_name", "flag")
    return rows.select(F.col(tissue).alias("tissue_id"), "channel_name", F.coalesce(F.nanvl("flag", F.lit(0.0)) != 0, F.lit(False)).alias("measured"))


def select(measured: DataFrame, channels: DataFrame, kind: str = "complete", valid: DataFrame | None = None, nuclear: bool = False) -> DataFrame:
    """(tissue_id, channel_pos, channel_name, uniprot_id, plane): the chosen channels.

    plane is the channel's place among the measured ones, which are the stored planes.
    `valid` (tissue_id, channel_pos) keeps channels with usable statistics only.
    """
    if kind not in KINDS:
        raise ValueError(f"kind must be one of {KINDS}")
    if "qc_pass" not in channels.columns:
        channels = channels.withColumn("qc_pass", F.lit(True))
    if "uniprot_id" not in channels.columns:
        channels = channels.withColumn("uniprot_id", F.lit(None).cast("string"))
    if nuclear and "is_nuclear_marker" in channels.columns:
        channels = channels.withColumn("uniprot_id", replace_nuclear(F.col("uniprot_id"), F.col("is_nuclear_marker")))
    of_tissue = F.row_number().over(Window.partitionBy("tissue_id").orderBy("channel_pos")) - 1
    rows = measured.where("measured").select("tissue_id", "channel_pos").withColumn("plane", of_tissue).join(channels, "channel_pos")
    if kind != "complete":
        rows = rows.where(F.coalesce("qc_pass", F.lit(False)))
    if kind == "uniprot_filtered":
        rows = rows.where(uniprot_ok(F.col("uniprot_id")))
    if valid is not None:
        rows = rows.join(valid, ["tissue_id", "channel_pos"], "left_semi")
    return rows.select("tissue_id", "channel_pos", "channel_name", "uniprot_id", "plane")


def names(selected: DataFrame) -> DataFrame:
    """Per tissue the channel names and accessions in channel order."""
    each = F.array_sort(F.collect_list(F.struct("channel_pos", "channel_name", "uniprot_id")))
    lists = selected.groupBy("tissue_id").agg(each.alias("c"))
    return lists.select("tissue_id", F.col("c.channel_name").alias("channel_names"), F.col("c.uniprot_id").alias("uniprot_ids"))


def kind_for(modality: Column, kind: Column) -> Column:
    """RGB modalities have no channel choice."""
    return F.when((modality == "he") | modality.startswith("ihc_"), "complete").otherwise(kind)
