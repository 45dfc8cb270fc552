"""Role views: imaging tables in canonical long form, filled from the tables at hand.

Each view has the same definition in SQL (VIEWS_SQL), which the DuckDB twins of the
queries begin with.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tissue_id, channel, pix, value, fg): one row for each pixel of a measured channel."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("tissue_id"),
        F.col("event_type").alias("channel"),
        F.col("event_id").alias("pix"),
        "value",
        (F.regexp_extract("props", r'"k": *([0-9]+)', 1).try_cast("int") >= 20).alias("fg"),
    )


def large_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("tissue_id"),
        F.concat("l_returnflag", "l_linestatus").alias("channel"),
        F.col("l_orderkey").alias("pix"),
        F.col("l_extendedprice").alias("value"),
        (F.col("l_tax") > 0).alias("fg"),
    )


def mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tissue_id, y, x): the pixels that are tissue."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("tissue_id"),
        (F.col("l_quantity").cast("int") - 1).alias("y"),
        (F.dayofmonth("l_shipdate") - 1).alias("x"),
    ).distinct()


def tissues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("tissue_id"),
        F.col("o_custkey").alias("patient_id"),
        F.col("o_orderpriority").alias("modality"),
        F.col("o_orderstatus").alias("split"),
        F.col("o_orderkey").alias("pos"),
    )


def channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(channel_pos, channel_name, uniprot_id, qc_pass, is_nuclear_marker, description)."""
    size = F.col("p_size")
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("channel_pos"),
        F.col("p_name").alias("channel_name"),
        F.when(size % 5 == 0, F.lit(None).cast("string"))
        .when(size % 5 == 1, F.concat(F.lit("P"), F.lpad((F.col("p_partkey") % 100000).cast("string"), 5, "0")))
        .when(size % 5 == 2, "Q9Y2X3")
        .when(size % 5 == 3, " EXCLUDED ")
        .otherwise("O15350-2")
        .alias("uniprot_id"),
        F.when(size % 11 == 0, F.lit(None).cast("boolean")).otherwise(size % 7 != 0).alias("qc_pass"),
        (F.col("p_type") == "ECONOMY").alias("is_nuclear_marker"),
        F.concat(F.col("p_brand"), F.lit(" "), F.col("p_type")).alias("description"),
    )


def channels_per_tissue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("tissue_id"), F.col("l_partkey").alias("channel_pos"), F.lit(True).alias("measured")
    ).distinct()


def planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(plane_id, y, x, value): 8 x 8 planes."""
    cells = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("plane_id"), F.posexplode("embedding").alias("pos", "v"))
    return cells.select("plane_id", F.floor(F.col("pos") / 8).cast("int").alias("y"), (F.col("pos") % 8).alias("x"), F.col("v").cast("double").alias("value"))


def marker_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(dataset, modality, channel_index, channel_name, uniprot_id, qc_pass, description, is_nuclear_marker)."""
    names = F.element_at(
        F.array(*[F.lit(n) for n in MARKER_NAMES]), (F.col("channel_pos") % len(MARKER_NAMES) + 1).cast("int")
    )
    return channels(spark, sf_dir).select(
        F.concat(F.lit("cohort_"), (F.col("channel_pos") % 5).cast("string")).alias("dataset"),
        F.element_at(F.array(*[F.lit(m) for m in MULTIPLEX]), (F.floor(F.col("channel_pos") / 5) % 4 + 1).cast("int")).alias("modality"),
        F.col("channel_pos").alias("channel_index"),
        names.alias("channel_name"),
        "uniprot_id",
        "qc_pass",
        "description",
        "is_nuclear_marker",
    )


#: Multiplex modalities in their canonical order, and marker names for the inventory role.
MULTIPLEX = ["imc", "codex", "cycif", "mibi"]
MARKER_NAMES = ["DAPI", "Hoechst 33342", "DNA_1", "dsDNA", "191 Ir", "Histone H3", "nuclear-lamin", "DRAQ5", "CD3", "CD45 (PTPRC)", "Ki-67", "panCK"]

VIEWS_SQL = r"""
    pixels AS (SELECT user_id AS tissue_id, event_type AS channel, event_id AS pix, value,
                      TRY_CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS INT) >= 20 AS fg FROM events),
    mask AS (SELECT DISTINCT l_suppkey AS tissue_id, CAST(l_quantity AS INT) - 1 AS y, CAST(day(l_shipdate) AS INT) - 1 AS x FROM lineitem),
    tissues AS (SELECT o_orderkey AS tissue_id, o_custkey AS patient_id, o_orderpriority AS modality, o_orderstatus AS split, o_orderkey AS pos FROM orders),
    channels AS (SELECT p_partkey AS channel_pos, p_name AS channel_name,
                        CASE p_size % 5 WHEN 0 THEN NULL WHEN 1 THEN 'P' || lpad(CAST(p_partkey % 100000 AS VARCHAR), 5, '0')
                             WHEN 2 THEN 'Q9Y2X3' WHEN 3 THEN ' EXCLUDED ' ELSE 'O15350-2' END AS uniprot_id,
                        CASE WHEN p_size % 11 = 0 THEN NULL ELSE p_size % 7 <> 0 END AS qc_pass,
                        p_type = 'ECONOMY' AS is_nuclear_marker, p_brand || ' ' || p_type AS description FROM part),
    channels_per_tissue AS (SELECT DISTINCT l_suppkey AS tissue_id, l_partkey AS channel_pos, true AS measured FROM lineitem),
    planes AS (SELECT vec_id AS plane_id, CAST((i - 1) // 8 AS INT) AS y, CAST((i - 1) % 8 AS INT) AS x, CAST(embedding[i] AS DOUBLE) AS value
               FROM embeddings, range(1, 65) r(i)),
    marker_channels AS (SELECT 'cohort_' || CAST(channel_pos % 5 AS VARCHAR) AS dataset,
                               (['imc', 'codex', 'cycif', 'mibi'])[CAST((channel_pos // 5) % 4 + 1 AS INT)] AS modality, channel_pos AS channel_index,
                               (['DAPI', 'Hoechst 33342', 'DNA_1', 'dsDNA', '191 Ir', 'Histone H3', 'nuclear-lamin', 'DRAQ5', 'CD3', 'CD45 (PTPRC)', 'Ki-67', 'panCK'])[CAST(channel_pos % 12 + 1 AS INT)] AS channel_name,
                               uniprot_id, qc_pass, description, is_nuclear_marker FROM channels)
"""
