"""Inventories of datasets and channels: rules, summaries, pivots and searches."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Patterns that tell nuclear channels from upper-cased names, first one wins (fixed values).
NUCLEAR_RULES = [
    (r"\bDAPI\b", "DAPI stain"),
    (r"HOECHST", "Hoechst stain"),
    (r"\bDNA[ _-]?\d*\b", "DNA stain"),
    (r"DSDNA", "dsDNA marker"),
    (r"191\s*IR|193\s*IR|IR191|IR193|IRIDIUM", "Iridium DNA intercalator"),
    (r"HISTONE\s*-?\s*H3|HISTONEH3|\bH3\b", "Histone H3 marker"),
    (r"NUCLEAR", "Explicit nuclear label"),
    (r"DRAQ5", "DRAQ5 DNA stain"),
]
#: Values of uniprot_id that mean none (fixed values).
NO_UNIPROT = ["", "exclude", "excluded", "none", "nan"]
MULTIPLEX = ["imc", "codex", "cycif", "mibi"]


def nuclear_reason(name: Column) -> Column:
    upper = F.upper(F.coalesce(name, F.lit("")))
    return F.coalesce(*[F.when(upper.rlike(p), label) for p, label in NUCLEAR_RULES], F.lit(""))


def real_uniprot(uniprot: Column) -> Column:
    return uniprot.isNotNull() & ~F.lower(F.trim(uniprot)).isin(NO_UNIPROT)


def uniprot_text(uniprot: Column) -> Column:
    return F.when(real_uniprot(uniprot), F.trim(uniprot)).otherwise("")


def qc_text(qc: Column) -> Column:
    return F.when(qc.isNull(), "unknown").when(qc, "pass").otherwise("fail")


def channel_inventory(channels: DataFrame) -> DataFrame:
    """Channels with the derived columns of the inventory."""
    for name, kind in (("uniprot_id", "string"), ("qc_pass", "boolean"), ("description", "string"), ("is_nuclear_marker", "boolean")):
        if name not in channels.columns:
            channels = channels.withColumn(name, F.lit(None).cast(kind))
    found = nuclear_reason(F.col("channel_name"))
    flagged = F.coalesce("is_nuclear_marker", F.lit(False))
    return channels.withColumns({
        "nuclear_reason": F.when((found == "") & flagged, "Flagged in metadata").otherwise(found),
        "is_nuclear": (found != "") | flagged,
        "has_uniprot": real_uniprot(F.col("uniprot_id")),
        "qc_display": qc_text(F.col("qc_pass")),
        "uni_display": uniprot_text(F.col("uniprot_id")),
        "dm": F.concat_ws(" / ", "dataset", "modality"),
    })


def filtered(inventory: DataFrame, datasets: list[str] | None = None, modalities: list[str] | None = None, qc: str = "all", nuclear_only: bool = False, mapped_only: bool = False, search: str = "") -> DataFrame:
    """Filters that users combine; the search is literal and looks at name, accession and description."""
    if datasets is not None:
        inventory = inventory.where(F.col("dataset").isin(datasets))
    if modalities is not None:
        inventory = inventory.where(F.col("modality").isin(modalities))
    if qc != "all":
        inventory = inventory.where(F.col("qc_display") == qc)
    if nuclear_only:
        inventory = inventory.where("is_nuclear")
    if mapped_only:
        inventory = inventory.where("has_uniprot")
    if search.strip():
        wanted = F.lit(search.strip().lower())
        inventory = inventory.where(functools.reduce(Column.__or__, [F.coalesce(F.contains(F.lower(c), wanted), F.lit(False)) for c in ("channel_name", "uniprot_id", "description")]))
    return inventory


def regex_search(df: DataFrame, pattern: str) -> DataFrame:
    """Rows with a column, as text, that the pattern fits somewhere, without regard to case."""
    fits = [F.coalesce(F.col(f"`{c}`").cast("string").rlike(f"(?i){pattern}"), F.lit(False)) for c in df.columns]
    return df.where(functools.reduce(Column.__or__, fits))


def pair_summary(inventory: DataFrame) -> DataFrame:
    return inventory.groupBy("dataset", "modality").agg(
        F.count("*").alias("n_channels"),
        F.count_if("is_nuclear").alias("n_nuclear"),
        F.count_if("has_uniprot").alias("n_uniprot"),
        F.count_if(F.coalesce("qc_pass", F.lit(False))).alias("n_qc_pass"),
    )


def kpis(inventory: DataFrame) -> DataFrame:
    return inventory.agg(
        F.count_distinct("dataset", "modality").alias("pairs"),
        F.count_distinct("dataset").alias("datasets"),
        F.count("*").alias("channels"),
        F.count_if("is_nuclear").alias("nuclear"),
        F.count_if("has_uniprot").alias("mapped"),
    )


def nuclear_rollup(inventory: DataFrame) -> DataFrame:
    """Per pair its nuclear channels in order, and the reasons in order of appearance."""
    rows = inventory.where("is_nuclear")
    names = rows.groupBy("dataset", "modality").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("channel_index", "channel_name"))), lambda c: c["channel_name"]), ", ").alias("channels"),
        F.count("*").alias("count"),
    )
    first = rows.groupBy("dataset", "modality", "nuclear_reason").agg(F.min("channel_index").alias("at"))
    reasons = first.groupBy("dataset", "modality").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "nuclear_reason"))), lambda c: c["nuclear_reason"]), ", ").alias("reasons"))
    return names.join(reasons, ["dataset", "modality"])


def marker_label(name: Column, uniprot: Column, mode: str) -> Column:
    """A marker's label by name, by accession (name where there is none), or by both."""
    text = uniprot_text(uniprot)
    if mode == "name":
        return name
    if mode == "uniprot":
        return F.when(text != "", text).otherwise(name)
    return F.when(text != "", F.concat(name, F.lit(" ("), text, F.lit(")"))).otherwise(name)


def heatmap(inventory: DataFrame, pairs: list[str], mode: str = "name") -> DataFrame:
    """One row for each marker, a 0/1 column for each pair, and its prevalence."""
    rows = inventory.select("dm", marker_label(F.col("channel_name"), F.col("uniprot_id"), mode).alias("label")).where(F.col("dm").isin(pairs)).dropDuplicates()
    wide = rows.groupBy("label").pivot("dm", pairs).agg(F.max(F.lit(1))).na.fill(0)
    return wide.withColumn("prevalence", functools.reduce(Column.__add__, [F.col(f"`{p}`") for p in pairs]))


def truncated(heat: DataFrame, n: int | None) -> DataFrame:
    """One row: how many markers there are, how many a list of n shows, and whether that leaves some out."""
    shown = F.col("markers") if n is None else F.least(F.col("markers"), F.lit(n))
    return heat.agg(F.count("*").alias("markers")).select("markers", shown.alias("shown"), (F.col("markers") > shown).alias("truncated"))


def top_markers(heat: DataFrame, n: int | None, by: str = "prevalence") -> DataFrame:
    ordered = heat.orderBy(F.desc("prevalence"), "label") if by == "prevalence" else heat.orderBy("label")
    return ordered if n is None else ordered.limit(n)


def fill_rate(heat: DataFrame, pairs: int) -> DataFrame:
    """Markers, filled cells and the whole percentage of cells that are filled."""
    return heat.agg(F.count("*").alias("markers"), F.sum("prevalence").alias("filled")).withColumn(
        "percent", F.coalesce(F.try_divide(F.col("filled") * 100, F.col("markers") * pairs), F.lit(0)).cast("int")
    )


def short_label(label: Column) -> Column:
    return F.when(F.length(label) > 18, F.concat(F.left(label, F.lit(15)), F.lit("…"))).otherwise(label)


def joined_text(values: Column, sep: str = ", ") -> Column:
    """Distinct values in order, as one text."""
    return F.array_join(F.array_sort(F.collect_set(values)), sep)


def expected_root(modality: Column) -> Column:
    """The folder of a modality; NULL for unknown ones."""
    return F.when(modality.isin(["he", *MULTIPLEX]), modality).when(modality.startswith("ihc"), F.lit("ihc"))


def group_filter(df: DataFrame, value: str) -> DataFrame:
    """Rows of a modality, or of a group of them: __all__, __multiplex__, __he__ or __ihc__."""
    chosen = {
        "__all__": F.lit(True),
        "__multiplex__": F.col("modality").isin(MULTIPLEX),
        "__he__": F.col("modality") == "he",
        "__ihc__": F.col("modality").startswith("ihc"),
    }
    return df.where(chosen.get(value, F.col("modality") == value))


def of_pairs(df: DataFrame, modalities: DataFrame) -> DataFrame:
    """Rows of (dataset, modality) pairs that are in the modality table."""
    return df.join(modalities.select("dataset", "modality").distinct(), ["dataset", "modality"], "left_semi")


def sized(groups: list[str], crops: DataFrame) -> DataFrame:
    """(groups, total_crops, crop_counts_by_size): sizes are texts and sorted as such."""
    sizes = crops.groupBy(*groups, "crop_size").agg(F.sum("num_crops").alias("n"))
    text = F.concat_ws(":", "crop_size", F.col("n").cast("string"))
    each = F.array_sort(F.collect_list(F.struct("crop_size", text.alias("t"))))
    return sizes.groupBy(*groups).agg(F.sum("n").alias("total_crops"), F.array_join(F.transform(each, lambda c: c["t"]), ", ").alias("crop_counts_by_size"))


def dataset_summary(datasets: DataFrame, modalities: DataFrame, crops: DataFrame, specs: DataFrame) -> DataFrame:
    """Per dataset what its filtered modalities, crops and specs add up to; datasets without a modality go.

    datasets(dataset, ...), modalities(dataset, modality, resolutions, images_best_resolution),
    crops(dataset, crop_size, num_crops), specs(dataset). Counts are of rows.
    """
    derived = ["num_modalities", "loader_modalities", "images_best_resolution_total", "resolutions", "num_crop_specs", "total_crops", "crop_counts_by_size", "num_standardization_specs"]
    tokens = modalities.select("dataset", F.explode(F.split("resolutions", ",")).alias("r")).select("dataset", F.trim("r").alias("r")).where("r <> ''")
    by_modality = modalities.groupBy("dataset").agg(
        F.count("*").alias("num_modalities"),
        F.array_join(F.array_sort(F.collect_list("modality")), ", ").alias("loader_modalities"),
        F.coalesce(F.sum("images_best_resolution"), F.lit(0)).alias("images_best_resolution_total"),
    )
    resolutions = tokens.groupBy("dataset").agg(joined_text(F.col("r")).alias("resolutions"))
    files = crops.groupBy("dataset").agg(F.count("*").alias("num_crop_specs"))
    by_spec = specs.groupBy("dataset").agg(F.count("*").alias("num_standardization_specs"))
    out = datasets.drop(*derived).join(by_modality, "dataset")
    for part in (resolutions, files, sized(["dataset"], crops), by_spec):
        out = out.join(part, "dataset", "left")
    return out.na.fill(0, ["num_crop_specs", "total_crops", "num_standardization_specs"]).na.fill("", ["resolutions"]).na.fill("-", ["crop_counts_by_size"])


def modality_rows(listed: DataFrame, channels: DataFrame, tissues: DataFrame, crops: DataFrame, specs: DataFrame) -> DataFrame:
    """One row for each (dataset, modality) with all that the inventory tells of it.

    listed(dataset, modality, root, resolution, stores): image stores by resolution, a NULL
    resolution where there is none; channels(dataset, modality, qc_pass), one row a channel;
    tissues(dataset, modality, tissue_id); crops(dataset, resolution, tiling_method,
    crop_size, num_crops), shared by a dataset's modalities; specs(dataset, modality,
    resolution, spec).
    """
    pair = ["dataset", "modality"]
    there = F.col("resolution").isNotNull()
    per_resolution = F.array_sort(F.collect_list(F.when(there, F.struct("resolution", F.concat_ws(":", "resolution", F.col("stores").cast("string")).alias("t")))))
    rows = listed.groupBy(*pair, "root").agg(
        F.array_join(F.transform(per_resolution, lambda r: r["resolution"]), ", ").alias("resolutions"),
        F.count_if(there).alias("num_resolutions"),
        F.coalesce(F.max("stores"), F.lit(0)).alias("images_best_resolution"),
        F.coalesce(F.sum("stores"), F.lit(0)).alias("images_total_files"),
        F.array_join(F.transform(per_resolution, lambda r: r["t"]), ", ").alias("image_counts_by_resolution"),
    )
    by_tissue = tissues.groupBy(*pair).agg(F.count("*").alias("metadata_rows"), F.count_distinct("tissue_id").alias("unique_tissues"))
    by_channel = channels.groupBy(*pair).agg(F.count("*").alias("channel_count"), F.count_if(F.coalesce("qc_pass", F.lit(False))).alias("qc_pass_count"))
    name = F.concat_ws("/", "resolution", "tiling_method", "crop_size")
    by_crop = crops.groupBy("dataset").agg(F.count("*").alias("num_crop_specs"), F.array_join(F.array_sort(F.collect_list(name)), ", ").alias("crop_specs"))
    each = F.array_sort(F.collect_list(F.concat_ws("/", "resolution", "spec")))
    by_spec = specs.groupBy(*pair).agg(F.count("*").alias("num_standardization_specs"), F.array_join(each, ", ").alias("standardization_specs"))
    out = rows.join(by_tissue, pair, "left").join(by_channel, pair, "left").join(by_crop, "dataset", "left").join(sized(["dataset"], crops), "dataset", "left").join(by_spec, pair, "left")
    out = out.na.fill(0, ["metadata_rows", "unique_tissues", "num_crop_specs", "total_crops", "num_standardization_specs"])
    return out.na.fill("", ["crop_specs", "standardization_specs"]).na.fill("-", ["crop_counts_by_size"])


def inventory_kpis(datasets: DataFrame, modalities: DataFrame, crops: DataFrame, specs: DataFrame) -> DataFrame:
    """One row: datasets, modalities, images, tile files, standardization specs, and crops by size."""
    by_size = crops.agg(F.lit(1).alias("one"), F.count("*").alias("tile_files"))
    sizes = crops.groupBy("crop_size").agg(F.sum("num_crops").alias("n")).agg(F.lit(1).alias("one"), F.collect_list(F.struct("crop_size", "n")).alias("c"))
    in_order = F.array_sort("c", lambda a, b: _by_length(a["crop_size"], b["crop_size"]))
    one = datasets.agg(F.lit(1).alias("one"), F.count("*").alias("datasets"))
    parts = [
        modalities.agg(F.lit(1).alias("one"), F.count("*").alias("modalities"), F.coalesce(F.sum("images_best_resolution"), F.lit(0)).alias("images")),
        by_size,
        specs.agg(F.lit(1).alias("one"), F.count("*").alias("specs")),
        sizes.select("one", F.array_join(F.transform(in_order, lambda s: F.concat_ws(":", s["crop_size"], s["n"].cast("string"))), ", ").alias("crops")),
    ]
    return functools.reduce(lambda a, b: a.join(b, "one"), parts, one).drop("one")


def _by_length(a: Column, b: Column) -> Column:
    """Order of texts by length, then value: sizes as text in order of their numbers."""
    return F.when(F.length(a) != F.length(b), F.length(a) - F.length(b)).when(a < b, -1).when(a > b, 1).otherwise(0)


def by_size(df: DataFrame, column: str = "crop_size") -> DataFrame:
    """Rows in order of a size that is a text: by length, then value."""
    return df.orderBy(F.length(column), column)


#: What each table of the inventory is sorted by.
ORDERS = {
    "datasets": ["dataset"],
    "modalities": ["dataset", "modality"],
    "crops": ["dataset", "resolution", "tiling_method", "crop_size"],
    "specs": ["dataset", "modality", "resolution", "spec"],
}


def drill_down(tables: dict[str, DataFrame], dataset: str | None = None, modality: str | None = None) -> dict[str, DataFrame]:
    """The inventory's tables of one dataset, of one modality, or of both, sorted; tables without a modality stay."""

    def some(df: DataFrame) -> DataFrame:
        for name, value in (("dataset", dataset), ("modality", modality)):
            df = df if value is None or name not in df.columns else df.where(F.col(name) == value)
        return df

    return {name: some(df).orderBy(*ORDERS[name]) for name, df in tables.items()}


def pair_channels(inventory: DataFrame, dm: str) -> DataFrame:
    """Channels of one dataset and modality in order of their index."""
    return inventory.where(F.col("dm") == dm).orderBy("channel_index")


def first_pairs(inventory: DataFrame, n: int = 6) -> list[str]:
    """The pairs that a heat map begins with: the first n by dataset and modality."""
    return [r["dm"] for r in inventory.select("dataset", "modality", "dm").distinct().orderBy("dataset", "modality").limit(n).collect()]


def parsed_counts(text: Column) -> Column:
    """`a:1, b:2` as a map; tokens that aren't a name and a number are skipped, and the last of a name counts."""

    def token(t: Column) -> Column:
        colon = F.instr(t, ":")
        number = F.when(colon > 0, F.trim(F.substring(t, colon + 1, F.length(t))).try_cast("bigint"))
        return F.struct(F.trim(F.substring(t, F.lit(1), colon - 1)).alias("name"), number.alias("n"))

    known = F.filter(F.transform(F.split(text, ","), token), lambda p: p["n"].isNotNull())

    def put(so_far: Column, p: Column) -> Column:
        return F.map_concat(F.map_filter(so_far, lambda k, _: k != p["name"]), F.create_map(p["name"], p["n"]))

    return F.aggregate(known, F.create_map().cast("map<string,bigint>"), put)


def crop_file_summary(coords: DataFrame) -> DataFrame:
    return coords.agg(F.count_distinct("tissue_id").alias("tissues_with_crops"), F.count("*").alias("num_crops"))
