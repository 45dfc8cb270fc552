"""Queries over pixels and channels: statistics, standardization, channel choice, filters."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import user
from tessera.operators import channels as ch
from tessera.operators import kernels, metadata, states, stats, stencil
from tessera.sources import roles

SPEC = {"clip": "quantile_clipping", "log1p": "quantile_clipping_log1p"}
#: Event types, which play the channels of the pixels.
CHANNELS = ["click", "login", "logout", "purchase", "view"]


def r6(name: str) -> Column:
    return F.round(name, 6).alias(name)


def foreground(spark, sf_dir) -> DataFrame:
    return roles.pixels(spark, sf_dir).where("fg")


def image_quantiles(spark, sf_dir):
    q = stats.quantiles(foreground(spark, sf_dir), "image", 0.99, 0.01)
    return q.select("tissue_id", "channel", r6("upper"), r6("lower"))


def global_quantiles(spark, sf_dir):
    return stats.quantiles(foreground(spark, sf_dir), "global", 0.99, 0.01).select("channel", r6("upper"), r6("lower"))


def _moments(quantile_level: str, stats_level: str, how: str):
    def query(spark, sf_dir):
        px = foreground(spark, sf_dir)
        m = stats.moments(px, stats.quantiles(px, quantile_level), quantile_level, stats_level, SPEC[how])
        return m.select(*stats.LEVELS[stats_level], r6("mean"), r6("std"), "n")

    return query


def stats_4way_levels(spark, sf_dir):
    px = foreground(spark, sf_dir)
    parts = []
    for q in stats.LEVELS:
        for s, m in stats.moments_by_level(px, stats.quantiles(px, q), q).items():
            tissue = F.col("tissue_id") if s == "image" else F.lit(None).cast("long")
            parts.append(m.select(F.lit(q).alias("quantile_level"), F.lit(s).alias("stats_level"), tissue.alias("tissue_id"), "channel", r6("mean"), r6("std"), "n"))
    return reduce(DataFrame.unionByName, parts)


def counted_stats_levels(spark, sf_dir):
    """Statistics of all levels from counts of values: one scan of the pixels, whose counts all of them share."""
    counts = states.counted(foreground(spark, sf_dir))
    parts = []
    for q in stats.LEVELS:
        bounds = states.quantiles(counts, q)
        for s in stats.LEVELS:
            m = states.moments(counts, bounds, q, s)
            tissue = F.col("tissue_id") if s == "image" else F.lit(None).cast("string")
            parts.append(m.select(F.lit(q).alias("quantile_level"), F.lit(s).alias("stats_level"), tissue.cast("long").alias("tissue_id"), "channel", r6("mean"), r6("std"), "n"))
    return reduce(DataFrame.unionByName, parts)


def _standardized(how: str):
    def query(spark, sf_dir):
        px = foreground(spark, sf_dir)
        bounds = stats.quantiles(px, "image")
        m = stats.moments(px, bounds, "image", "global", SPEC[how])
        return stats.standardize(px, bounds, m, "image", "global", SPEC[how]).select("pix", "tissue_id", "channel", r6("standardized"))

    return query


def own_transform(spark, sf_dir):
    """Pixels standardized by a Python function of arrays, registered under a name of its own."""
    user.register_transform("arcsinh_5", lambda value, lower, upper: np.arcsinh(np.minimum(value, upper) / 5))
    px = foreground(spark, sf_dir)
    bounds = stats.quantiles(px, "image")
    m = stats.moments(px, bounds, "image", "global", "arcsinh_5")
    return stats.standardize(px, bounds, m, "image", "global", "arcsinh_5").select("pix", "tissue_id", "channel", r6("standardized"))


def own_labels(spark, sf_dir):
    """Tissues whose labels a Python function of a value changes, and the codes of the new labels."""
    change = user.of_values(lambda modality: modality.split("-")[-1].lower())
    rows = metadata.filtered(roles.tissues(spark, sf_dir), label="modality", change=change)
    return rows.join(metadata.label_codes(rows, "modality"), "modality").select("tissue_id", "modality", "code")


def large_image_stats(spark, sf_dir):
    px = roles.large_pixels(spark, sf_dir).where("fg")
    m = stats.moments(px, stats.quantiles(px, "image"), "image", "image")
    return m.select("tissue_id", "channel", F.round("mean", 5).alias("mean"), F.round("std", 5).alias("std"), "n")


def valid_stats_mask(spark, sf_dir):
    px = foreground(spark, sf_dir)
    bounds = stats.quantiles(px, "image", 0.99, 0.01)
    both = bounds.join(stats.moments(px, bounds, "image", "image"), ["tissue_id", "channel"], "left")
    return both.select("tissue_id", "channel", stats.valid_stats(F.col("upper"), F.col("lower"), F.col("mean"), F.col("std")).alias("valid"))


def quantiles_wide_pivot(spark, sf_dir):
    q = stats.quantiles(foreground(spark, sf_dir), "image", 0.99)
    wide = stats.wide(q, "upper", CHANNELS)
    return wide.select("tissue_id", *[r6(c) for c in CHANNELS])


def _usable(spark, sf_dir) -> DataFrame:
    """(tissue_id, channel_pos) of channels whose pixels, the prices of a part from a supplier, have usable statistics."""
    px = roles.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("tissue_id"), F.col("l_partkey").alias("channel"), F.col("l_extendedprice").alias("value"))
    bounds = stats.quantiles(px, "image", 0.99, 0.01)
    both = bounds.join(stats.moments(px, bounds, "image", "image"), ["tissue_id", "channel"])
    usable = stats.valid_stats(F.col("upper"), F.col("lower"), F.col("mean"), F.col("std"))
    return both.where(usable).select("tissue_id", F.col("channel").alias("channel_pos"))


def _channels(kind: str, valid: bool = False):
    def query(spark, sf_dir):
        measured = roles.channels_per_tissue(spark, sf_dir)
        return ch.select(measured, roles.channels(spark, sf_dir), kind, _usable(spark, sf_dir) if valid else None)

    return query


def channel_lists(spark, sf_dir):
    chosen = ch.select(roles.channels_per_tissue(spark, sf_dir), roles.channels(spark, sf_dir), "uniprot_filtered")
    lists = ch.names(chosen)
    return lists.select("tissue_id", F.array_join("channel_names", "|").alias("channel_names"), F.array_join("uniprot_ids", "|").alias("uniprot_ids"))


def nuclear_uniprot_replace(spark, sf_dir):
    return roles.channels(spark, sf_dir).select("channel_pos", ch.replace_nuclear(F.col("uniprot_id"), F.col("is_nuclear_marker")).alias("uniprot_id"))


def channel_map_default(spark, sf_dir):
    regions = roles.table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("tissue_id"))
    return ch.default_map(regions, roles.channels(spark, sf_dir))


def kind_override(spark, sf_dir):
    tissues = roles.tissues(spark, sf_dir)
    modality = F.when(F.col("modality").startswith("1"), "he").when(F.col("modality").startswith("2"), "ihc_cd3").otherwise("codex")
    return tissues.select("tissue_id", ch.kind_for(modality, F.lit("qc_filtered")).alias("kind"))


def rgb_preprocess(spark, sf_dir):
    px = roles.planes(spark, sf_dir).withColumn("c", (F.col("plane_id") % 3).cast("int"))
    return px.select("plane_id", "y", "x", *[F.round(stats.rgb_preprocess(F.col("value") * 255, F.col("c"), p), 6).alias(p) for p in ("imagenet", "hibou")])


def _filtered(name: str, **more):
    def query(spark, sf_dir):
        planes = roles.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("plane_id"), F.col("embedding").cast("array<double>").alias("values"))
        cells = kernels.apply_filters(planes, [(name, more)], 8, 8).select("plane_id", F.posexplode("values").alias("pos", "value"))
        return cells.select("plane_id", F.floor(F.col("pos") / 8).cast("int").alias("y"), (F.col("pos") % 8).alias("x"), F.round("value", 5).alias("value"))

    return query


def percentile_stretch(spark, sf_dir):
    return kernels.stretch(roles.planes(spark, sf_dir), ["plane_id"]).select("plane_id", "y", "x", "level")


def marker_overlay(spark, sf_dir):
    levels = kernels.stretch(roles.planes(spark, sf_dir), ["plane_id"])
    levels = levels.select(F.floor(F.col("plane_id") / 3).cast("long").alias("image_id"), (F.col("plane_id") % 3).cast("int").alias("marker"), "y", "x", "level")
    return kernels.overlay(levels, "image_id", "marker", [0, 2, 1])


def single_marker(spark, sf_dir):
    levels = kernels.stretch(roles.planes(spark, sf_dir), ["plane_id"])
    levels = levels.select(F.floor(F.col("plane_id") / 3).cast("long").alias("image_id"), (F.col("plane_id") % 3).cast("int").alias("marker"), "y", "x", "level")
    return kernels.overlay(levels, "image_id", "marker", [1])


def rgb_composite(spark, sf_dir):
    levels = kernels.stretch(roles.planes(spark, sf_dir), ["plane_id"])
    levels = levels.select(F.floor(F.col("plane_id") / 2).cast("long").alias("image_id"), (F.col("plane_id") % 2).cast("int").alias("c"), "y", "x", "level")
    return kernels.rgb_composite(levels, "image_id", "c", 2)


def planes_and_back(spark, sf_dir):
    """Planes that begin at offsets of their own, as rectangles, their medians, and as pixels again."""
    moved = roles.planes(spark, sf_dir).select("plane_id", (F.col("y") + F.col("plane_id") % 5).cast("int").alias("y"), (F.col("x") + 20).alias("x"), "value")
    medians = kernels.apply_filters(kernels.as_planes(moved, ["plane_id"]), [("median", {})], "h", "w")
    return kernels.as_pixels(medians, ["plane_id"]).withColumn("value", F.round("value", 5))


def _chunked(name: str, **more):
    def query(spark, sf_dir):
        """Planes cut into chunks of 4 x 4 that are filtered with their halos."""
        made = stencil.filter_pixels(roles.planes(spark, sf_dir), ["plane_id"], [(name, more)], chunk=4)
        return made.withColumn("value", F.round("value", 5))

    return query


QUERIES = {
    "single_marker": single_marker,
    "rgb_composite": rgb_composite,
    "planes_and_back": planes_and_back,
    "image_quantiles": image_quantiles,
    "global_quantiles": global_quantiles,
    "image_stats_clip": _moments("image", "image", "clip"),
    "image_quantile_global_stats": _moments("image", "global", "clip"),
    "global_stats_clip": _moments("global", "global", "clip"),
    "global_stats_log1p": _moments("global", "global", "log1p"),
    "stats_4way_levels": stats_4way_levels,
    "counted_stats_levels": counted_stats_levels,
    "standardize_pixels": _standardized("clip"),
    "standardize_log1p": _standardized("log1p"),
    "own_transform": own_transform,
    "own_labels": own_labels,
    "large_image_stats": large_image_stats,
    "valid_stats_mask": valid_stats_mask,
    "quantiles_wide_pivot": quantiles_wide_pivot,
    "channels_complete": _channels("complete"),
    "channels_qc_filtered": _channels("qc_filtered"),
    "channels_uniprot_filtered": _channels("uniprot_filtered"),
    "channels_refined": _channels("uniprot_filtered", valid=True),
    "channel_lists": channel_lists,
    "nuclear_uniprot_replace": nuclear_uniprot_replace,
    "channel_map_default": channel_map_default,
    "kind_override": kind_override,
    "rgb_preprocess": rgb_preprocess,
    "median_3x3": _filtered("median"),
    "gaussian_3x3": _filtered("gaussian"),
    "median_3x3_chunks": _chunked("median"),
    "gaussian_3x3_chunks": _chunked("gaussian"),
    "percentile_stretch": percentile_stretch,
    "marker_overlay": marker_overlay,
}


def sql(body: str) -> str:
    return f"WITH {roles.VIEWS_SQL}, fg AS (SELECT * FROM pixels WHERE fg){body}"


def _q(level: str) -> str:
    keys = ", ".join(stats.LEVELS[level])
    return f", q_{level} AS (SELECT {keys}, quantile_cont(value, 0.99) AS upper, quantile_cont(value, 0.01) AS lower FROM fg GROUP BY {keys})"


def _z(level: str, how: str, name: str = "z") -> str:
    clipped = "least(greatest(value, 0.0), upper)"
    z = f"{clipped} / (upper + 1e-8)" if how == "clip" else f"ln(1 + {clipped})"
    on = " AND ".join(f"f.{k} = q.{k}" for k in stats.LEVELS[level])
    return f", {name} AS (SELECT f.*, {z} AS z FROM fg f JOIN q_{level} q ON {on})"


def _m(level: str, z: str = "z") -> str:
    keys = ", ".join(stats.LEVELS[level])
    return f" SELECT {keys}, round(avg(z), 6) AS mean, round(stddev_pop(z), 6) AS std, count(z) AS n FROM {z} GROUP BY {keys}"


def _standard_sql(how: str) -> str:
    return sql(
        _q("image") + _z("image", how) + ", m AS (SELECT channel, avg(z) AS mean, stddev_pop(z) AS std FROM z GROUP BY channel)"
        " SELECT z.pix, z.tissue_id, z.channel, round((z.z - m.mean) / (m.std + 1e-8), 6) AS standardized FROM z JOIN m USING (channel)"
        " JOIN q_image q ON q.tissue_id = z.tissue_id AND q.channel = z.channel WHERE q.upper > 0 AND m.std > 0"
    )


_MEASURED = "m AS (SELECT tissue_id, channel_pos, row_number() OVER (PARTITION BY tissue_id ORDER BY channel_pos) - 1 AS plane FROM channels_per_tissue)"
_CHOSEN = f", {_MEASURED} SELECT m.tissue_id, m.channel_pos, c.channel_name, c.uniprot_id, CAST(m.plane AS INT) AS plane FROM m JOIN channels c USING (channel_pos)"
_UNIPROT = r"coalesce(regexp_matches(c.uniprot_id, '^[OPQ][0-9][A-Z0-9]{3}[0-9](?:-[0-9]+)?$'), false)"
_NEAR = """, full_planes AS (SELECT p.plane_id, p.y, p.x, d.dy, e.dx,
        CASE WHEN p.y + d.dy < 0 THEN 1 WHEN p.y + d.dy > 7 THEN 6 ELSE p.y + d.dy END AS ny,
        CASE WHEN p.x + e.dx < 0 THEN 1 WHEN p.x + e.dx > 7 THEN 6 ELSE p.x + e.dx END AS nx
        FROM planes p, (VALUES (-1), (0), (1)) d(dy), (VALUES (-1), (0), (1)) e(dx))"""
_LEVELS = """, b AS (SELECT plane_id, quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.99) AS hi FROM planes GROUP BY plane_id),
    levels AS (SELECT plane_id, y, x, CAST(CASE WHEN hi > lo THEN floor(least(greatest((value - lo) / (hi - lo), 0.0), 1.0) * 255) ELSE 0 END AS INT) AS level FROM planes JOIN b USING (plane_id))"""


def _color(k: int) -> str:
    chosen = dict(zip([0, 2, 1], kernels.MARKER_COLORS, strict=False))
    color = " ".join(f"WHEN {m} THEN CAST({c[k]} AS DOUBLE)" for m, c in chosen.items())
    return f"CAST(floor(least(round(sum(level / 255.0 * CASE plane_id % 3 {color} END), 9), 1.0) * 255) AS INT)"


def _rgb(preset: str) -> str:
    mean, std = stats.RGB_PRESETS[preset]
    pick = lambda v: "(" + str([float(x) for x in v]) + ")[CAST(plane_id % 3 + 1 AS INT)]"
    return f"round((value - {pick(mean)}) / {pick(std)}, 6) AS {preset}"


ORACLES = {
    "image_quantiles": sql(_q("image") + " SELECT tissue_id, channel, round(upper, 6) AS upper, round(lower, 6) AS lower FROM q_image"),
    "global_quantiles": sql(_q("global") + " SELECT channel, round(upper, 6) AS upper, round(lower, 6) AS lower FROM q_global"),
    "image_stats_clip": sql(_q("image") + _z("image", "clip") + _m("image")),
    "image_quantile_global_stats": sql(_q("image") + _z("image", "clip") + _m("global")),
    "global_stats_clip": sql(_q("global") + _z("global", "clip") + _m("global")),
    "global_stats_log1p": sql(_q("global") + _z("global", "log1p") + _m("global")),
    "stats_4way_levels": sql(
        _q("image") + _q("global") + _z("image", "clip", "zi") + _z("global", "clip", "zg")
        + " UNION ALL ".join(
            f" SELECT '{q}' AS quantile_level, '{s}' AS stats_level, {'tissue_id' if s == 'image' else 'CAST(NULL AS BIGINT) AS tissue_id'}, channel,"
            f" round(avg(z), 6) AS mean, round(stddev_pop(z), 6) AS std, count(z) AS n FROM z{q[0]} GROUP BY {', '.join(stats.LEVELS[s])}"
            for q in stats.LEVELS for s in stats.LEVELS
        )
    ),
    "standardize_pixels": _standard_sql("clip"),
    "standardize_log1p": _standard_sql("log1p"),
    "own_transform": sql(
        _q("image") + ", z AS (SELECT f.*, q.upper, ln(least(value, upper) / 5 + sqrt(pow(least(value, upper) / 5, 2) + 1)) AS z FROM fg f JOIN q_image q ON f.tissue_id = q.tissue_id AND f.channel = q.channel),"
        " m AS (SELECT channel, avg(z) AS mean, stddev_pop(z) AS std FROM z GROUP BY channel)"
        " SELECT z.pix, z.tissue_id, z.channel, round((z.z - m.mean) / (m.std + 1e-8), 6) AS standardized FROM z JOIN m USING (channel) WHERE upper > 0 AND std > 0"
    ),
    "own_labels": sql(
        ", l AS (SELECT tissue_id, lower(regexp_extract(modality, '[^-]*$')) AS modality FROM tissues),"
        " c AS (SELECT modality, CAST(row_number() OVER (ORDER BY min(tissue_id)) - 1 AS INT) AS code FROM l GROUP BY modality)"
        " SELECT tissue_id, modality, code FROM l JOIN c USING (modality)"
    ),
    "large_image_stats": """WITH px AS (SELECT l_suppkey AS tissue_id, l_returnflag || l_linestatus AS channel, l_extendedprice AS value FROM lineitem WHERE l_tax > 0),
        q AS (SELECT tissue_id, channel, quantile_cont(value, 0.99) AS upper FROM px GROUP BY ALL),
        z AS (SELECT tissue_id, channel, least(greatest(value, 0.0), upper) / (upper + 1e-8) AS z FROM px JOIN q USING (tissue_id, channel))
        SELECT tissue_id, channel, round(avg(z), 5) AS mean, round(stddev_pop(z), 5) AS std, count(z) AS n FROM z GROUP BY ALL""",
    "valid_stats_mask": sql(
        _q("image") + ", z AS (SELECT f.tissue_id, f.channel, (least(greatest(value, lower), upper) - lower) / (upper - lower + 1e-8) AS z FROM fg f JOIN q_image USING (tissue_id, channel)),"
        " m AS (SELECT tissue_id, channel, avg(z) AS mean, stddev_pop(z) AS std FROM z GROUP BY ALL)"
        " SELECT tissue_id, channel, upper > 0 AND std > 1e-12 AS valid FROM q_image JOIN m USING (tissue_id, channel)"
    ),
    "quantiles_wide_pivot": sql(
        _q("image") + " SELECT tissue_id, " + ", ".join(f"round(max(upper) FILTER (channel = '{c}'), 6) AS \"{c}\"" for c in CHANNELS) + " FROM q_image GROUP BY tissue_id"
    ),
    "channels_complete": sql(_CHOSEN),
    "channels_qc_filtered": sql(_CHOSEN + " WHERE coalesce(c.qc_pass, false)"),
    "channels_uniprot_filtered": sql(_CHOSEN + f" WHERE coalesce(c.qc_pass, false) AND {_UNIPROT}"),
    "channels_refined": sql(
        ", px AS (SELECT l_suppkey AS tissue_id, l_partkey AS channel_pos, l_extendedprice AS value FROM lineitem),"
        " pq AS (SELECT tissue_id, channel_pos, quantile_cont(value, 0.99) AS upper, quantile_cont(value, 0.01) AS lower FROM px GROUP BY ALL),"
        " pz AS (SELECT tissue_id, channel_pos, upper, (least(greatest(value, lower), upper) - lower) / (upper - lower + 1e-8) AS z FROM px JOIN pq USING (tissue_id, channel_pos)),"
        " good AS (SELECT tissue_id, channel_pos FROM pz GROUP BY tissue_id, channel_pos HAVING max(upper) > 0 AND stddev_pop(z) > 0)"
        + _CHOSEN + f" JOIN good g ON g.tissue_id = m.tissue_id AND g.channel_pos = m.channel_pos WHERE coalesce(c.qc_pass, false) AND {_UNIPROT}"
    ),
    "channel_lists": sql(
        ", chosen AS (SELECT t.tissue_id, c.* FROM channels_per_tissue t JOIN channels c USING (channel_pos) WHERE coalesce(c.qc_pass, false) AND " + _UNIPROT + ")"
        " SELECT tissue_id, string_agg(channel_name, '|' ORDER BY channel_pos) AS channel_names, string_agg(uniprot_id, '|' ORDER BY channel_pos) AS uniprot_ids FROM chosen GROUP BY tissue_id"
    ),
    "nuclear_uniprot_replace": sql(" SELECT channel_pos, CASE WHEN coalesce(is_nuclear_marker, false) THEN 'P68431' ELSE uniprot_id END AS uniprot_id FROM channels"),
    "channel_map_default": sql(" SELECT r_regionkey AS tissue_id, channel_pos, channel_name, true AS measured FROM region CROSS JOIN channels"),
    "kind_override": sql(" SELECT tissue_id, CASE WHEN modality[1] IN ('1', '2') THEN 'complete' ELSE 'qc_filtered' END AS kind FROM tissues"),
    "rgb_preprocess": sql(f" SELECT plane_id, y, x, {_rgb('imagenet')}, {_rgb('hibou')} FROM planes"),
    "median_3x3": sql(_NEAR + " SELECT f.plane_id, f.y, f.x, round(quantile_cont(p.value, 0.5), 5) AS value FROM full_planes f JOIN planes p ON p.plane_id = f.plane_id AND p.y = f.ny AND p.x = f.nx GROUP BY ALL"),
    "gaussian_3x3": sql(
        _NEAR + ", g AS (SELECT exp(-0.5) AS s), w AS (SELECT 1 / (1 + 2 * s) AS centre, s / (1 + 2 * s) AS side FROM g)"
        " SELECT f.plane_id, f.y, f.x, round(sum(p.value * CASE dy WHEN 0 THEN centre ELSE side END * CASE dx WHEN 0 THEN centre ELSE side END), 5) AS value"
        " FROM full_planes f JOIN planes p ON p.plane_id = f.plane_id AND p.y = f.ny AND p.x = f.nx, w GROUP BY f.plane_id, f.y, f.x"
    ),
    "percentile_stretch": sql(_LEVELS + " SELECT plane_id, y, x, level FROM levels"),
    "single_marker": sql(_LEVELS + " SELECT plane_id // 3 AS image_id, y, x, level AS red, level AS green, level AS blue FROM levels WHERE plane_id % 3 = 1"),
    "rgb_composite": sql(_LEVELS + " SELECT plane_id // 2 AS image_id, y, x, max(level) FILTER (plane_id % 2 = 0) AS red, max(level) FILTER (plane_id % 2 = 1) AS green, max(level) FILTER (plane_id % 2 = 1) AS blue FROM levels GROUP BY ALL"),
    "planes_and_back": sql(
        _NEAR + " SELECT f.plane_id, CAST(f.y + f.plane_id % 5 AS INT) AS y, CAST(f.x + 20 AS INT) AS x, round(quantile_cont(p.value, 0.5), 5) AS value"
        " FROM full_planes f JOIN planes p ON p.plane_id = f.plane_id AND p.y = f.ny AND p.x = f.nx GROUP BY f.plane_id, f.y, f.x"
    ),
    "marker_overlay": sql(_LEVELS + f" SELECT plane_id // 3 AS image_id, y, x, {_color(0)} AS red, {_color(1)} AS green, {_color(2)} AS blue FROM levels GROUP BY ALL"),
}
ORACLES |= {f"{name}_chunks": ORACLES[name] for name in ("median_3x3", "gaussian_3x3")}
ORACLES["counted_stats_levels"] = ORACLES["stats_4way_levels"]
