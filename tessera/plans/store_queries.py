"""Queries that write the embeddings as a dataset of images and masks, and read it back by ImagingDataset.

Four embeddings are the channels of an 8 x 8 image; its mask is where the first channel is positive.
The folder lies in spark.checkpoint.dir, and is written once a session and input.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from tessera.dataset import Cohort, ImagingDataset
from tessera.operators import runs
from tessera.sources import roles, writing

CHANNELS = ["DAPI", "CD3", "CD8", "KI67"]
#: Rows and columns of a chunk, and of a tile.
CHUNK, TILE = 5, 4
#: Rows and columns of an image.
SIDE = 8
SPEC = "quantile_clipping/uq_0.99_image"
GROWN = "quantile_clipping/uq_0.9_lq_0.1_global"
_written: dict[tuple[str, str], str] = {}


def _scratch(spark) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="tessera-")


def _tissue(plane_id: str):
    return F.concat(F.lit("t"), F.floor(F.col(plane_id) / len(CHANNELS)).cast("string"))


def _pixels(spark, sf_dir):
    """The pixels that there are; others of the images are 0."""
    planes = roles.planes(spark, sf_dir).where(f"y < {SIDE} and value is not null")
    return planes.select(_tissue("plane_id").alias("tissue_id"), (F.col("plane_id") % len(CHANNELS)).cast("int").alias("plane"), "y", "x", "value")


def _root(spark, sf_dir) -> str:
    """The folder with the dataset, written if it isn't there yet."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key in _written:
        return _written[key]
    root = f"{_scratch(spark)}/images-{uuid.uuid4().hex}"
    base = f"{root}/cohort"
    pixels = _pixels(spark, sf_dir)
    number = F.substring("tissue_id", 2, 20).cast("long")
    # an image has all channels, though the last one may have fewer embeddings
    tissues = roles.table(spark, sf_dir, "embeddings").select(_tissue("vec_id").alias("tissue_id")).distinct().withColumns({"n": number, "modality": F.lit("imc")})
    tissues = tissues.withColumns({"patient_id": F.concat(F.lit("p"), (F.col("n") % 7).cast("string")), "split": F.when(F.col("n") % 3 == 0, "test").otherwise("train"), "grade": F.concat(F.lit("g"), ((F.col("n") * 5 + 2) % 4).cast("string"))})
    tissues.coalesce(1).sortWithinPartitions(F.desc("n")).drop("n").write.parquet(f"{base}/metadata/tissues.parquet")
    spark.createDataFrame(list(enumerate(CHANNELS)), "index int, channel_name string").coalesce(1).write.parquet(f"{base}/imc/channels.parquet")
    extents = tissues.select("tissue_id", F.lit(len(CHANNELS)).alias("c"), F.lit(SIDE).alias("h"), F.lit(SIDE).alias("w"))
    writing.write_images(pixels, f"{base}/imc/1_0mpp/images", CHUNK, extents=extents)
    mask = pixels.where("plane = 0 and value > 0").select("tissue_id", "y", "x")
    writing.write_masks(runs.of_pixels(mask), extents, f"{base}/segmentations/1_0mpp/tissue_masks")
    _written[key] = root
    return root


def _dataset(spark, sf_dir, **more) -> ImagingDataset:
    return ImagingDataset(spark, _root(spark, sf_dir), "cohort", "imc", strategy="grid", tile_size=TILE, **more)


def _valued(rows):
    return rows.withColumn("value", F.round("value", 5))


def store_pixels(spark, sf_dir):
    return _valued(_dataset(spark, sf_dir).pixels().select("tissue_id", "channel_pos", "channel", "y", "x", "value"))


def store_window(spark, sf_dir):
    """A window that begins outside of the images, of all tissues."""
    return _valued(_dataset(spark, sf_dir).pixels(window=(-2, 3, 8, 4)).select("tissue_id", "channel_pos", "y", "x", "value"))


def store_sizes(spark, sf_dir):
    d = _dataset(spark, sf_dir)
    return d.sizes().join(d.extents().toDF("tissue_id", "mask_h", "mask_w"), "tissue_id")


def store_masks(spark, sf_dir):
    return _dataset(spark, sf_dir).mask().select("tissue_id", "y", "x")


def store_masked_pixels(spark, sf_dir):
    return _valued(_dataset(spark, sf_dir).masked_pixels().select("tissue_id", "channel_pos", "y", "x", "value"))


def store_standardized(spark, sf_dir):
    """Statistics of the masked pixels written as files, and all pixels standardized by what the files hold."""
    _dataset(spark, sf_dir).compute_statistics(0.99)
    return _valued(_dataset(spark, sf_dir, spec=SPEC).pixels().select("tissue_id", "channel_pos", "y", "x", "value"))


def store_grown_statistics(spark, sf_dir):
    """Statistics from counts to which the tissues come in two batches, and all pixels standardized by what the files hold."""
    d = _dataset(spark, sf_dir)
    early = [r[0] for r in d.tissues().where("split = 'test'").select("tissue_id").collect()]
    d.pixel_counts.add(d.masked_pixels(early), "early")
    d.update_statistics(0.9, 0.1, quantile_level="global", stats_level="global")
    grown = _dataset(spark, sf_dir, spec=GROWN, quantile_level="global", stats_level="global")
    return _valued(grown.pixels().select("tissue_id", "channel_pos", "y", "x", "value"))


def store_filtered(spark, sf_dir):
    return _valued(_dataset(spark, sf_dir, filters=[("median", {})]).pixels().select("tissue_id", "channel_pos", "y", "x", "value"))


def store_tiles(spark, sf_dir):
    """Coordinates of a grid, written as files and read again, with the share of tissue in each tile."""
    d = _dataset(spark, sf_dir)
    d.compute_tiling()
    found = d.valid_ratios()
    return found.select("tissue_id", "tile_id", "row", "col", F.round("valid_ratio", 6).alias("valid_ratio"), "grade")


def store_tile_stats(spark, sf_dir):
    d = _dataset(spark, sf_dir)
    d.compute_tiling()
    return d.tile_stats().select("tissue_id", "mask_height", "mask_width", "num_tiles", "covered_valid_pixels", "total_valid_pixels", "stop_reason")


def store_patients(spark, sf_dir):
    return _dataset(spark, sf_dir).patients().select("patient_id", F.array_join("tissue_ids", ",").alias("tissue_ids"))


def store_label_codes(spark, sf_dir):
    return _dataset(spark, sf_dir, label="grade", split="train").label_codes()


def store_cohort_index(spark, sf_dir):
    """The tissues of a cohort by number, written as an index and read again."""
    cohort = Cohort(spark, _root(spark, sf_dir), ["cohort"], ["imc"])
    stored = cohort.store_index(f"{_root(spark, sf_dir)}/index")
    return spark.read.parquet(f"{stored.path}/rows").select("global_id", "dataset_name", "tissue_id", F.array_join("modalities", ",").alias("modalities"))


QUERIES = {
    "store_pixels": store_pixels,
    "store_window": store_window,
    "store_sizes": store_sizes,
    "store_masks": store_masks,
    "store_masked_pixels": store_masked_pixels,
    "store_standardized": store_standardized,
    "store_grown_statistics": store_grown_statistics,
    "store_filtered": store_filtered,
    "store_tiles": store_tiles,
    "store_tile_stats": store_tile_stats,
    "store_patients": store_patients,
    "store_label_codes": store_label_codes,
    "store_cohort_index": store_cohort_index,
}


def sql(body: str) -> str:
    return f"""WITH {roles.VIEWS_SQL}, ids AS (SELECT DISTINCT plane_id // 4 AS n FROM planes),
        px AS (SELECT 't' || n AS tissue_id, CAST(c AS INT) AS channel_pos, CAST(i // 8 AS INT) AS y, CAST(i % 8 AS INT) AS x, coalesce(p.value, 0.0) AS value
               FROM ids CROSS JOIN range(4) r(c) CROSS JOIN range(64) s(i) LEFT JOIN planes p ON p.plane_id = n * 4 + c AND p.y = i // 8 AND p.x = i % 8),
        m AS (SELECT tissue_id, y, x FROM px WHERE channel_pos = 0 AND value > 0){body}"""


_COUNTS = """, cells AS (SELECT tissue_id, y // 4 * 4 AS "row", x // 4 * 4 AS "col", count(*) AS valid FROM m GROUP BY ALL),
    tiles AS (SELECT *, row_number() OVER (PARTITION BY tissue_id ORDER BY "row", "col") - 1 AS tile_id FROM cells WHERE valid >= 3)"""

ORACLES = {
    "store_pixels": sql(" SELECT tissue_id, channel_pos, (['DAPI', 'CD3', 'CD8', 'KI67'])[channel_pos + 1] AS channel, y, x, round(value, 5) AS value FROM px"),
    "store_window": sql(" SELECT tissue_id, channel_pos, y, x, round(value, 5) AS value FROM px WHERE y < 6 AND x BETWEEN 3 AND 6"),
    "store_sizes": sql(" SELECT DISTINCT tissue_id, 4 AS c, 8 AS h, 8 AS w, 8 AS mask_h, 8 AS mask_w FROM px"),
    "store_masks": sql(" SELECT * FROM m"),
    "store_masked_pixels": sql(" SELECT tissue_id, channel_pos, y, x, round(value, 5) AS value FROM px SEMI JOIN m USING (tissue_id, y, x)"),
    "store_standardized": sql(
        ", fg AS (SELECT * FROM px SEMI JOIN m USING (tissue_id, y, x)),"
        " q AS (SELECT tissue_id, channel_pos, quantile_cont(value, 0.99) AS upper FROM fg GROUP BY ALL),"
        " s AS (SELECT tissue_id, channel_pos, upper, avg(least(greatest(value, 0.0), upper) / (upper + 1e-8)) AS mean, stddev_pop(least(greatest(value, 0.0), upper) / (upper + 1e-8)) AS std"
        " FROM fg JOIN q USING (tissue_id, channel_pos) GROUP BY ALL)"
        " SELECT tissue_id, channel_pos, y, x, round((least(greatest(value, 0.0), upper) / (upper + 1e-8) - mean) / (std + 1e-8), 5) AS value FROM px JOIN s USING (tissue_id, channel_pos) WHERE upper > 0 AND std > 0"
    ),
    "store_grown_statistics": sql(
        ", fg AS (SELECT * FROM px SEMI JOIN m USING (tissue_id, y, x)),"
        " q AS (SELECT channel_pos, quantile_cont(value, 0.9) AS upper, quantile_cont(value, 0.1) AS lower FROM fg GROUP BY ALL),"
        " s AS (SELECT channel_pos, upper, lower, avg((least(greatest(value, lower), upper) - lower) / (upper - lower + 1e-8)) AS mean, stddev_pop((least(greatest(value, lower), upper) - lower) / (upper - lower + 1e-8)) AS std"
        " FROM fg JOIN q USING (channel_pos) GROUP BY ALL)"
        " SELECT tissue_id, channel_pos, y, x, round(((least(greatest(value, lower), upper) - lower) / (upper - lower + 1e-8) - mean) / (std + 1e-8), 5) AS value FROM px JOIN s USING (channel_pos)"
    ),
    "store_filtered": sql(
        " SELECT f.tissue_id, f.channel_pos, f.y, f.x, round(quantile_cont(p.value, 0.5), 5) AS value FROM px f, (VALUES (-1), (0), (1)) d(dy), (VALUES (-1), (0), (1)) e(dx), px p"
        " WHERE p.tissue_id = f.tissue_id AND p.channel_pos = f.channel_pos AND p.y = 7 - abs(7 - abs(f.y + dy)) AND p.x = 7 - abs(7 - abs(f.x + dx)) GROUP BY f.tissue_id, f.channel_pos, f.y, f.x"
    ),
    "store_tiles": sql(_COUNTS + """ SELECT tissue_id, CAST(tile_id AS INT) AS tile_id, CAST("row" AS INT) AS "row", CAST("col" AS INT) AS "col", round(valid / 16.0, 6) AS valid_ratio,
        CASE WHEN valid >= 8 THEN 'good' WHEN valid >= 3.2 THEN 'warn' ELSE 'none' END AS grade FROM tiles"""),
    "store_tile_stats": sql(_COUNTS + """, per AS (SELECT tissue_id, count(*) AS tiles, sum(valid) AS covered FROM tiles GROUP BY tissue_id), total AS (SELECT tissue_id, count(*) AS total FROM m GROUP BY tissue_id)
        SELECT 't' || n AS tissue_id, 8 AS mask_height, 8 AS mask_width, coalesce(tiles, 0) AS num_tiles, CAST(coalesce(covered, 0) AS BIGINT) AS covered_valid_pixels, coalesce(total, 0) AS total_valid_pixels,
               CASE WHEN total IS NULL THEN 'empty_mask' ELSE 'fixed_grid_complete' END AS stop_reason
        FROM ids LEFT JOIN per ON per.tissue_id = 't' || n LEFT JOIN total ON total.tissue_id = 't' || n"""),
    "store_patients": sql(" SELECT 'p' || (n % 7) AS patient_id, string_agg('t' || n, ',' ORDER BY n DESC) AS tissue_ids FROM ids GROUP BY 1"),
    "store_label_codes": sql(" SELECT grade, CAST(row_number() OVER (ORDER BY last DESC) - 1 AS INT) AS code FROM (SELECT 'g' || ((n * 5 + 2) % 4) AS grade, max(n) AS last FROM ids WHERE n % 3 <> 0 GROUP BY 1)"),
    "store_cohort_index": sql(" SELECT row_number() OVER (ORDER BY n DESC) - 1 AS global_id, 'cohort' AS dataset_name, 't' || n AS tissue_id, 'imc' AS modalities FROM ids"),
}
