"""Queries over metadata, cohorts and inventories."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import inventory as inv
from tessera.operators import kernels, metadata
from tessera.plans.tile_queries import drawn_sql
from tessera.sources import catalog, roles

MODALITIES = ["5-LOW", "1-URGENT", "3-MEDIUM"]
PAIRS = ["cohort_0 / imc", "cohort_1 / codex", "cohort_2 / mibi", "cohort_9 / imc"]


def split_filter(spark, sf_dir):
    return metadata.filtered(roles.tissues(spark, sf_dir), split="O").select("tissue_id", "patient_id", "modality")


def label_filter_encode(spark, sf_dir):
    tissues = metadata.filtered(roles.tissues(spark, sf_dir), label="modality", keep=["1-URGENT", "2-HIGH", "5-LOW"], change=lambda c: F.lower(c))
    return tissues.join(metadata.label_codes(tissues, "modality"), "modality").select("tissue_id", "modality", "code")


def patient_tissues(spark, sf_dir):
    return metadata.patients(roles.tissues(spark, sf_dir)).select("patient_id", F.array_join("tissue_ids", ",").alias("tissue_ids"))


def patient_lookup(spark, sf_dir):
    return metadata.of_patient(roles.tissues(spark, sf_dir), 7).select("tissue_id", "split")


def tissue_modalities(spark, sf_dir):
    by_patient = roles.tissues(spark, sf_dir).withColumn("tissue_id", F.col("patient_id"))
    return metadata.modalities(by_patient, MODALITIES).select("tissue_id", F.array_join("modalities", ",").alias("modalities"))


def composed_sample(spark, sf_dir):
    rows = roles.tissues(spark, sf_dir).groupBy(F.col("patient_id").alias("tissue_id"), "modality").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    both = metadata.composed(rows, ["tissue_id"])
    return both.select("tissue_id", F.size("samples").alias("modalities"), F.try_element_at("samples", F.lit("5-LOW"))["n"].alias("low_n"), F.try_element_at("samples", F.lit("2-HIGH"))["first"].alias("high_first"))


def tissue_index_union(spark, sf_dir):
    by_patient = roles.tissues(spark, sf_dir).withColumn("tissue_id", F.col("patient_id"))
    parts = {s: metadata.modalities(by_patient.where(F.col("split") == s), MODALITIES) for s in ("F", "O", "P")}
    return metadata.tissue_index(parts).select("dataset_name", "tissue_id", F.array_join("modalities", ",").alias("modalities"))


def tissues_per_dataset(spark, sf_dir):
    return roles.tissues(spark, sf_dir).groupBy("split", "modality").agg(F.count("*").alias("n"), F.count_distinct("patient_id").alias("patients"))


def coords_of_dataset(spark, sf_dir):
    coords = roles.mask(spark, sf_dir)
    few = roles.table(spark, sf_dir, "supplier").where("s_nationkey < 8").select(F.col("s_suppkey").alias("tissue_id"))
    return metadata.of_dataset(coords, few).select("tissue_id", "x")


def sample_tissues(spark, sf_dir):
    return metadata.sample(roles.tissues(spark, sf_dir), 40, 11, ["tissue_id"]).select("tissue_id", "split")


def resolution_string(spark, sf_dir):
    r = F.col("p_size") / 4
    return roles.table(spark, sf_dir, "part").select("p_partkey", metadata.resolution_name(r).alias("resolution"))


def _inventory(spark, sf_dir):
    return inv.channel_inventory(roles.marker_channels(spark, sf_dir))


def nuclear_rules(spark, sf_dir):
    return _inventory(spark, sf_dir).select("channel_index", "channel_name", "is_nuclear", "nuclear_reason", "has_uniprot", "qc_display", "uni_display", "dm")


def pair_summary(spark, sf_dir):
    return inv.pair_summary(_inventory(spark, sf_dir))


def summary_pairs_join(spark, sf_dir):
    every = _inventory(spark, sf_dir)
    visible = inv.filtered(every, qc="fail", search="BRAND#1").select("dataset", "modality").distinct()
    return inv.pair_summary(every).join(visible, ["dataset", "modality"])


def kpi_strip(spark, sf_dir):
    return inv.kpis(_inventory(spark, sf_dir))


def nuclear_rollup(spark, sf_dir):
    return inv.nuclear_rollup(_inventory(spark, sf_dir))


def qc_tristate(spark, sf_dir):
    return _inventory(spark, sf_dir).groupBy("dataset", "qc_display").agg(F.count("*").alias("n"))


def literal_search(spark, sf_dir):
    return inv.filtered(_inventory(spark, sf_dir), search=" (ptprc)").select("channel_index", "channel_name")


def filtered_channels(spark, sf_dir):
    some = inv.filtered(_inventory(spark, sf_dir), ["cohort_1", "cohort_3"], ["imc", "mibi"], qc="pass", nuclear_only=True, mapped_only=True)
    return some.select("dataset", "modality", "channel_index", "uni_display")


def regex_search(spark, sf_dir):
    return inv.regex_search(roles.marker_channels(spark, sf_dir).select("channel_index", "channel_name", "uniprot_id"), "^ki-6|q9y2.3$").select("channel_index")


def marker_heatmap(spark, sf_dir):
    return inv.heatmap(_inventory(spark, sf_dir), PAIRS, "both")


def marker_prevalence_topn(spark, sf_dir):
    top = inv.top_markers(inv.heatmap(_inventory(spark, sf_dir), PAIRS, "both"), 25)
    return top.select("label", inv.short_label(F.col("label")).alias("short"), "prevalence")


def heatmap_fill_rate(spark, sf_dir):
    return inv.fill_rate(inv.heatmap(_inventory(spark, sf_dir), PAIRS, "uniprot"), len(PAIRS))


def _listed(spark, sf_dir):
    """Image stores by resolution of each modality."""
    rows = roles.marker_channels(spark, sf_dir)
    resolution = metadata.resolution_name(F.col("channel_index") % 3 / 2).alias("resolution")
    return rows.groupBy("dataset", "modality", F.col("modality").alias("root"), resolution).agg(F.sum(F.col("channel_index") % 7).alias("stores"))


def _tissue_rows(spark, sf_dir):
    key = F.col("o_orderkey")
    modality = F.element_at(F.array(*[F.lit(m) for m in roles.MULTIPLEX]), (F.col("o_custkey") % 4 + 1).cast("int"))
    return roles.table(spark, sf_dir, "orders").select(F.concat(F.lit("cohort_"), (key % 3).cast("string")).alias("dataset"), modality.alias("modality"), (key % 50).alias("tissue_id"))


def _crops(spark, sf_dir):
    part = roles.table(spark, sf_dir, "part")
    rows = part.select(
        F.concat(F.lit("cohort_"), (F.col("p_partkey") % 6).cast("string")).alias("dataset"),
        metadata.resolution_name(F.col("p_partkey") % 2 + 0.5).alias("resolution"),
        F.when(F.col("p_partkey") % 3 == 0, "grid").otherwise("greedy").alias("tiling_method"),
        (F.col("p_size") * 8 % 96 + 64).cast("string").alias("crop_size"),
    )
    return rows.groupBy("dataset", "resolution", "tiling_method", "crop_size").agg(F.count("*").alias("num_crops"))


def _specs(spark, sf_dir):
    part = roles.table(spark, sf_dir, "part")
    return part.select(
        F.concat(F.lit("cohort_"), (F.col("p_partkey") % 7).cast("string")).alias("dataset"),
        F.element_at(F.array(*[F.lit(m) for m in roles.MULTIPLEX]), (F.col("p_partkey") % 4 + 1).cast("int")).alias("modality"),
        metadata.resolution_name(F.col("p_partkey") % 2 + 0.5).alias("resolution"),
        F.concat(F.lit("uq_"), (F.col("p_size") % 4).cast("string")).alias("spec"),
    ).distinct()


def modality_inventory(spark, sf_dir):
    return inv.modality_rows(_listed(spark, sf_dir), roles.marker_channels(spark, sf_dir), _tissue_rows(spark, sf_dir), _crops(spark, sf_dir), _specs(spark, sf_dir))


def crop_counts_string(spark, sf_dir):
    return inv.sized(["dataset"], _crops(spark, sf_dir))


def _datasets(spark, sf_dir):
    return _crops(spark, sf_dir).select("dataset").distinct()


def dataset_summary(spark, sf_dir):
    modalities = modality_inventory(spark, sf_dir)
    return inv.dataset_summary(_datasets(spark, sf_dir), modalities, _crops(spark, sf_dir), inv.of_pairs(_specs(spark, sf_dir), modalities))


def inventory_kpis(spark, sf_dir):
    return inv.inventory_kpis(_datasets(spark, sf_dir), modality_inventory(spark, sf_dir), _crops(spark, sf_dir), _specs(spark, sf_dir))


def crop_sizes(spark, sf_dir):
    sizes = inv.by_size(_crops(spark, sf_dir).select("crop_size").distinct())
    return sizes.agg(F.lit("all").alias("which"), F.array_join(F.collect_list("crop_size"), ",").alias("sizes"))


def inventory_drill_down(spark, sf_dir):
    tables = {"modalities": modality_inventory(spark, sf_dir), "crops": _crops(spark, sf_dir), "specs": _specs(spark, sf_dir)}
    some = inv.drill_down(tables, "cohort_1", "imc")
    each = [t.agg(F.lit(name).alias("name"), F.count("*").alias("n")) for name, t in some.items()]
    return functools.reduce(DataFrame.unionByName, each)


def heatmap_truncation(spark, sf_dir):
    heat = inv.heatmap(_inventory(spark, sf_dir), PAIRS, "both")
    return inv.truncated(heat, 25).select(F.lit(25).alias("n"), "*").union(inv.truncated(heat, 100_000).select(F.lit(100_000).alias("n"), "*"))


def pair_channels(spark, sf_dir):
    return inv.pair_channels(_inventory(spark, sf_dir), "cohort_1 / codex").select("channel_index", "channel_name", "qc_display")


def first_pairs_heatmap(spark, sf_dir):
    rows = _inventory(spark, sf_dir)
    heat = inv.heatmap(rows, inv.first_pairs(rows))
    return heat.agg(F.count("*").alias("markers"), F.sum("prevalence").alias("filled"), F.lit(len(heat.columns) - 2).alias("pairs"))


def std_spec_semijoin(spark, sf_dir):
    return inv.of_pairs(_specs(spark, sf_dir), roles.marker_channels(spark, sf_dir)).select("dataset", "modality", "resolution", "spec")


def modality_groups(spark, sf_dir):
    rows = roles.marker_channels(spark, sf_dir).select("channel_index", F.when(F.col("channel_index") % 6 == 0, "he").when(F.col("channel_index") % 6 == 1, "ihc_cd3").otherwise(F.col("modality")).alias("modality"))
    return inv.group_filter(rows, "__multiplex__").union(inv.group_filter(rows, "__ihc__")).withColumn("root", inv.expected_root(F.col("modality")))


def modality_alias(spark, sf_dir):
    name = F.when(F.col("channel_index") % 5 == 0, "PhenoCycler").when(F.col("channel_index") % 5 == 1, "IHC_cd3").otherwise(F.upper("modality"))
    return roles.marker_channels(spark, sf_dir).select("channel_index", catalog.canonical_modality(name).alias("modality"))


def parsed_crop_counts(spark, sf_dir):
    text = F.concat(F.lit("64:"), F.col("p_size").cast("string"), F.lit(", bad, 128: 7 , x:y,128:99999999999,a:1:2"))
    counts = inv.parsed_counts(text)
    return roles.table(spark, sf_dir, "part").select("p_partkey", F.element_at(counts, "64").alias("c64"), F.element_at(counts, "128").alias("c128"), F.size(counts).alias("n"))


def picked_markers(spark, sf_dir):
    text = F.concat(F.lit("3, x,"), F.col("p_size").cast("string"), F.lit(",,-4,0,9,9"))
    return roles.table(spark, sf_dir, "part").select("p_partkey", F.array_join(kernels.picked_markers(text, 10), ",").alias("markers"))


def task_mask_labels(spark, sf_dir):
    encoder = roles.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    masks = roles.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("cell_id"), F.col("c_nationkey").alias("id"))
    return masks.join(encoder, "id").groupBy("name").agg(F.count("*").alias("cells"))


QUERIES = {
    f.__name__: f
    for f in (
        split_filter, label_filter_encode, patient_tissues, patient_lookup, tissue_modalities, composed_sample, tissue_index_union, tissues_per_dataset, coords_of_dataset,
        sample_tissues, resolution_string, nuclear_rules, pair_summary, summary_pairs_join, kpi_strip, nuclear_rollup, qc_tristate, literal_search, filtered_channels,
        regex_search, marker_heatmap, marker_prevalence_topn, heatmap_fill_rate, modality_inventory, crop_counts_string, dataset_summary, std_spec_semijoin,
        inventory_kpis, crop_sizes, inventory_drill_down, heatmap_truncation, pair_channels, first_pairs_heatmap,
        modality_groups, modality_alias, parsed_crop_counts, picked_markers, task_mask_labels,
    )
}

_REASON = "CASE " + " ".join(f"WHEN regexp_matches(upper(channel_name), '{p}') THEN '{label}'" for p, label in inv.NUCLEAR_RULES) + " ELSE '' END"
_INVENTORY = f""", named AS (SELECT *, {_REASON} AS found FROM marker_channels),
    inventory AS (SELECT *, CASE WHEN found = '' AND is_nuclear_marker THEN 'Flagged in metadata' ELSE found END AS nuclear_reason, found <> '' OR is_nuclear_marker AS is_nuclear,
        uniprot_id IS NOT NULL AND lower(trim(uniprot_id)) NOT IN ('', 'exclude', 'excluded', 'none', 'nan') AS has_uniprot,
        CASE WHEN qc_pass IS NULL THEN 'unknown' WHEN qc_pass THEN 'pass' ELSE 'fail' END AS qc_display, dataset || ' / ' || modality AS dm FROM named),
    inv AS (SELECT *, CASE WHEN has_uniprot THEN trim(uniprot_id) ELSE '' END AS uni_display FROM inventory),
    pairs AS (SELECT dataset, modality, count(*) AS n_channels, count(*) FILTER (is_nuclear) AS n_nuclear, count(*) FILTER (has_uniprot) AS n_uniprot, count(*) FILTER (coalesce(qc_pass, false)) AS n_qc_pass FROM inv GROUP BY ALL)"""
_RES = "replace(CAST(CAST({} AS DOUBLE) AS VARCHAR), '.', '_') || 'mpp'"
_MULTI = "(['imc', 'codex', 'cycif', 'mibi'])[CAST({} % 4 + 1 AS INT)]"
_MODALITY = f""", listed AS (SELECT dataset, modality, {_RES.format('channel_index % 3 / 2')} AS resolution, CAST(sum(channel_index % 7) AS BIGINT) AS stores FROM marker_channels GROUP BY ALL),
    image AS (SELECT dataset, modality, modality AS root, string_agg(resolution, ', ' ORDER BY resolution) AS resolutions, count(*) AS num_resolutions, max(stores) AS images_best_resolution,
        CAST(sum(stores) AS BIGINT) AS images_total_files, string_agg(resolution || ':' || stores, ', ' ORDER BY resolution) AS image_counts_by_resolution FROM listed GROUP BY ALL),
    chans AS (SELECT dataset, modality, count(*) AS channel_count, count(*) FILTER (coalesce(qc_pass, false)) AS qc_pass_count FROM marker_channels GROUP BY ALL),
    meta AS (SELECT 'cohort_' || o_orderkey % 3 AS dataset, {_MULTI.format('o_custkey')} AS modality, count(*) AS metadata_rows, count(DISTINCT o_orderkey % 50) AS unique_tissues FROM orders GROUP BY ALL),
    crops AS (SELECT 'cohort_' || p_partkey % 6 AS dataset, {_RES.format('p_partkey % 2 + 0.5')} AS resolution, CASE p_partkey % 3 WHEN 0 THEN 'grid' ELSE 'greedy' END AS tiling_method,
        CAST(p_size * 8 % 96 + 64 AS VARCHAR) AS crop_size, count(*) AS num_crops FROM part GROUP BY ALL),
    crop_n AS (SELECT dataset, crop_size, CAST(sum(num_crops) AS BIGINT) AS n FROM crops GROUP BY ALL),
    crop_text AS (SELECT dataset, CAST(sum(n) AS BIGINT) AS total_crops, string_agg(crop_size || ':' || n, ', ' ORDER BY crop_size) AS crop_counts_by_size FROM crop_n GROUP BY dataset),
    crop_file AS (SELECT dataset, count(*) AS num_crop_specs, string_agg(concat_ws('/', resolution, tiling_method, crop_size), ', ' ORDER BY concat_ws('/', resolution, tiling_method, crop_size)) AS crop_specs FROM crops GROUP BY dataset),
    specs AS (SELECT DISTINCT 'cohort_' || p_partkey % 7 AS dataset, {_MULTI.format('p_partkey')} AS modality, {_RES.format('p_partkey % 2 + 0.5')} AS resolution, 'uq_' || p_size % 4 AS spec FROM part),
    spec_text AS (SELECT dataset, modality, count(*) AS num_standardization_specs, string_agg(resolution || '/' || spec, ', ' ORDER BY resolution || '/' || spec) AS standardization_specs FROM specs GROUP BY ALL),
    mods AS (SELECT i.*, coalesce(metadata_rows, 0) AS metadata_rows, coalesce(unique_tissues, 0) AS unique_tissues, channel_count, qc_pass_count, coalesce(num_crop_specs, 0) AS num_crop_specs, coalesce(crop_specs, '') AS crop_specs,
        coalesce(total_crops, 0) AS total_crops, coalesce(crop_counts_by_size, '-') AS crop_counts_by_size, coalesce(num_standardization_specs, 0) AS num_standardization_specs, coalesce(standardization_specs, '') AS standardization_specs
        FROM image i LEFT JOIN meta USING (dataset, modality) LEFT JOIN chans USING (dataset, modality) LEFT JOIN crop_file USING (dataset) LEFT JOIN crop_text USING (dataset) LEFT JOIN spec_text USING (dataset, modality)),
    kept_specs AS (SELECT * FROM specs SEMI JOIN mods USING (dataset, modality))"""


def sql(body: str) -> str:
    return f"WITH {roles.VIEWS_SQL}{body}"


def _heat(label: str) -> str:
    cells = ", ".join(f"CAST(coalesce(max(1) FILTER (dm = '{p}'), 0) AS INT) AS \"{p}\"" for p in PAIRS)
    some = ", ".join(f"'{p}'" for p in PAIRS)
    total = " + ".join(f'"{p}"' for p in PAIRS)
    return f"{_INVENTORY}, cells AS (SELECT DISTINCT {label} AS label, dm FROM inv WHERE dm IN ({some})), heat AS (SELECT label, {cells} FROM cells GROUP BY label), wide AS (SELECT *, {total} AS prevalence FROM heat)"


_BOTH = "CASE WHEN uni_display <> '' THEN channel_name || ' (' || uni_display || ')' ELSE channel_name END"
_LIST = "(['5-LOW', '1-URGENT', '3-MEDIUM'])"


def _ordered(where: str, cols: str) -> str:
    return f"SELECT {cols}, string_agg(modality, ',' ORDER BY list_position({_LIST}, modality)) AS modalities FROM (SELECT DISTINCT patient_id, split, modality FROM tissues WHERE modality IN ('5-LOW', '1-URGENT', '3-MEDIUM'){where}) GROUP BY ALL"


ORACLES = {
    "split_filter": sql(" SELECT tissue_id, patient_id, modality FROM tissues WHERE split = 'O'"),
    "label_filter_encode": sql(
        ", t AS (SELECT tissue_id, pos, lower(modality) AS modality FROM tissues WHERE modality IN ('1-URGENT', '2-HIGH', '5-LOW')), f AS (SELECT modality, min(pos) AS first FROM t GROUP BY 1),"
        " codes AS (SELECT modality, CAST(row_number() OVER (ORDER BY first) - 1 AS INT) AS code FROM f) SELECT tissue_id, modality, code FROM t JOIN codes USING (modality)"
    ),
    "patient_tissues": sql(" SELECT patient_id, string_agg(tissue_id, ',' ORDER BY pos) AS tissue_ids FROM tissues WHERE patient_id IS NOT NULL GROUP BY patient_id"),
    "patient_lookup": sql(" SELECT tissue_id, split FROM tissues WHERE patient_id = 7"),
    "tissue_modalities": sql(f" SELECT patient_id AS tissue_id, string_agg(modality, ',' ORDER BY list_position({_LIST}, modality)) AS modalities FROM (SELECT DISTINCT patient_id, modality FROM tissues WHERE modality IN ('5-LOW', '1-URGENT', '3-MEDIUM')) GROUP BY 1"),
    "composed_sample": sql(
        " , r AS (SELECT patient_id AS tissue_id, modality, count(*) AS n, min(pos) AS first FROM tissues GROUP BY ALL)"
        " SELECT tissue_id, CAST(count(*) AS INT) AS modalities, max(n) FILTER (modality = '5-LOW') AS low_n, max(first) FILTER (modality = '2-HIGH') AS high_first FROM r GROUP BY tissue_id"
    ),
    "tissue_index_union": sql(" " + _ordered(" AND split IN ('F', 'O', 'P')", "split AS dataset_name, CAST(patient_id AS VARCHAR) AS tissue_id")),
    "tissues_per_dataset": sql(" SELECT split, modality, count(*) AS n, count(DISTINCT patient_id) AS patients FROM tissues GROUP BY ALL"),
    "coords_of_dataset": sql(" SELECT tissue_id, x FROM mask WHERE tissue_id IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 8)"),
    "sample_tissues": sql(f" SELECT tissue_id, split FROM tissues ORDER BY {drawn_sql(11, 'tissue_id')}, tissue_id LIMIT 40"),
    "resolution_string": "SELECT p_partkey, replace(CAST(CAST(p_size AS DOUBLE) / 4 AS VARCHAR), '.', '_') || 'mpp' AS resolution FROM part",
    "nuclear_rules": sql(_INVENTORY + " SELECT channel_index, channel_name, is_nuclear, nuclear_reason, has_uniprot, qc_display, uni_display, dm FROM inv"),
    "pair_summary": sql(_INVENTORY + " SELECT * FROM pairs"),
    "summary_pairs_join": sql(_INVENTORY + " SELECT * FROM pairs SEMI JOIN (SELECT dataset, modality FROM inv WHERE qc_display = 'fail' AND contains(lower(concat_ws(chr(1), channel_name, uniprot_id, description)), 'brand#1')) USING (dataset, modality)"),
    "kpi_strip": sql(_INVENTORY + " SELECT count(DISTINCT dm) AS pairs, count(DISTINCT dataset) AS datasets, count(*) AS channels, count(*) FILTER (is_nuclear) AS nuclear, count(*) FILTER (has_uniprot) AS mapped FROM inv"),
    "nuclear_rollup": sql(
        _INVENTORY + ", r AS (SELECT dataset, modality, nuclear_reason, min(channel_index) AS place FROM inv WHERE is_nuclear GROUP BY ALL),"
        " rr AS (SELECT dataset, modality, string_agg(nuclear_reason, ', ' ORDER BY place) AS reasons FROM r GROUP BY ALL),"
        " n AS (SELECT dataset, modality, string_agg(channel_name, ', ' ORDER BY channel_index) AS channels, count(*) AS count FROM inv WHERE is_nuclear GROUP BY ALL) SELECT * FROM n JOIN rr USING (dataset, modality)"
    ),
    "qc_tristate": sql(_INVENTORY + " SELECT dataset, qc_display, count(*) AS n FROM inv GROUP BY ALL"),
    "literal_search": sql(_INVENTORY + " SELECT channel_index, channel_name FROM inv WHERE contains(lower(concat_ws(chr(1), channel_name, uniprot_id, description)), '(ptprc)')"),
    "filtered_channels": sql(_INVENTORY + " SELECT dataset, modality, channel_index, uni_display FROM inv WHERE dataset IN ('cohort_1', 'cohort_3') AND modality IN ('imc', 'mibi') AND qc_display = 'pass' AND is_nuclear AND has_uniprot"),
    "regex_search": sql(" SELECT channel_index FROM marker_channels WHERE regexp_matches(channel_name, '(?i)^ki-6|q9y2.3$') OR coalesce(regexp_matches(uniprot_id, '(?i)^ki-6|q9y2.3$'), false)"),
    "marker_heatmap": sql(_heat(_BOTH) + " SELECT * FROM wide"),
    "marker_prevalence_topn": sql(_heat(_BOTH) + " SELECT label, CASE WHEN length(label) > 18 THEN left(label, 15) || '…' ELSE label END AS short, prevalence FROM wide ORDER BY prevalence DESC, label LIMIT 25"),
    "heatmap_fill_rate": sql(_heat("CASE WHEN uni_display <> '' THEN uni_display ELSE channel_name END") + f" SELECT count(*) AS markers, CAST(sum(prevalence) AS BIGINT) AS filled, CAST(floor(sum(prevalence) * 100 / (count(*) * {len(PAIRS)})) AS INT) AS percent FROM wide"),
    "modality_inventory": sql(_MODALITY + " SELECT * FROM mods"),
    "crop_counts_string": sql(_MODALITY + " SELECT * FROM crop_text"),
    "dataset_summary": sql(
        _MODALITY + """, m AS (SELECT dataset, count(*) AS num_modalities, string_agg(modality, ', ' ORDER BY modality) AS loader_modalities, CAST(sum(images_best_resolution) AS BIGINT) AS images_best_resolution_total FROM mods GROUP BY dataset),
        r AS (SELECT dataset, string_agg(DISTINCT resolution, ', ' ORDER BY resolution) AS resolutions FROM listed GROUP BY dataset), s AS (SELECT dataset, count(*) AS n FROM kept_specs GROUP BY dataset)
        SELECT dataset, num_modalities, loader_modalities, images_best_resolution_total, resolutions, num_crop_specs, total_crops, crop_counts_by_size, coalesce(n, 0) AS num_standardization_specs
        FROM crop_text JOIN crop_file USING (dataset) JOIN m USING (dataset) JOIN r USING (dataset) LEFT JOIN s USING (dataset)"""
    ),
    "std_spec_semijoin": sql(_MODALITY + " SELECT * FROM kept_specs"),
    "inventory_kpis": sql(_MODALITY + """ SELECT (SELECT count(DISTINCT dataset) FROM crops) AS datasets, (SELECT count(*) FROM mods) AS modalities, (SELECT CAST(sum(images_best_resolution) AS BIGINT) FROM mods) AS images,
        (SELECT count(*) FROM crops) AS tile_files, (SELECT count(*) FROM specs) AS specs,
        (SELECT string_agg(crop_size || ':' || n, ', ' ORDER BY length(crop_size), crop_size) FROM (SELECT crop_size, CAST(sum(n) AS BIGINT) AS n FROM crop_n GROUP BY crop_size)) AS crops"""),
    "crop_sizes": sql(_MODALITY + " SELECT 'all' AS which, string_agg(crop_size, ',' ORDER BY length(crop_size), crop_size) AS sizes FROM (SELECT DISTINCT crop_size FROM crops)"),
    "inventory_drill_down": sql(_MODALITY + """ SELECT 'modalities' AS name, count(*) AS n FROM mods WHERE dataset = 'cohort_1' AND modality = 'imc' UNION ALL SELECT 'crops', count(*) FROM crops WHERE dataset = 'cohort_1'
        UNION ALL SELECT 'specs', count(*) FROM specs WHERE dataset = 'cohort_1' AND modality = 'imc'"""),
    "heatmap_truncation": sql(_heat(_BOTH) + " SELECT n, count(*) AS markers, least(count(*), n) AS shown, count(*) > n AS truncated FROM wide, (VALUES (25), (100000)) v(n) GROUP BY n"),
    "pair_channels": sql(_INVENTORY + " SELECT channel_index, channel_name, qc_display FROM inv WHERE dm = 'cohort_1 / codex'"),
    "first_pairs_heatmap": sql(_INVENTORY + """, p AS (SELECT DISTINCT dataset, modality, dm FROM inv ORDER BY dataset, modality LIMIT 6), c AS (SELECT DISTINCT channel_name, dm FROM inv SEMI JOIN p USING (dm))
        SELECT count(DISTINCT channel_name) AS markers, count(*) AS filled, CAST((SELECT count(*) FROM p) AS INT) AS pairs FROM c"""),
    "modality_groups": sql(
        ", r AS (SELECT channel_index, CASE channel_index % 6 WHEN 0 THEN 'he' WHEN 1 THEN 'ihc_cd3' ELSE modality END AS modality FROM marker_channels)"
        " SELECT channel_index, modality, CASE WHEN modality = 'ihc_cd3' THEN 'ihc' ELSE modality END AS root FROM r WHERE modality <> 'he'"
    ),
    "modality_alias": sql(" SELECT channel_index, CASE channel_index % 5 WHEN 0 THEN 'codex' WHEN 1 THEN 'ihc_cd3' ELSE modality END AS modality FROM marker_channels"),
    "parsed_crop_counts": "SELECT p_partkey, CAST(p_size AS BIGINT) AS c64, CAST(99999999999 AS BIGINT) AS c128, 2 AS n FROM part",
    "picked_markers": "SELECT p_partkey, '3,' || least(9, p_size) || ',0,0,9' AS markers FROM part",
    "task_mask_labels": "SELECT n_name AS name, count(*) AS cells FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1",
}
