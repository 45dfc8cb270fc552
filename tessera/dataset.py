"""A dataset of one modality, several modalities together, and cohorts, over the folder layout.

Methods return DataFrames; nothing but small metadata is read before an action.
"""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import channels, index, jobs, kernels, metadata, runs, states, stats, stencil, tiles
from tessera.sources import arrays, catalog, store

#: Planes of the modalities that are photographs.
RGB = ["R", "G", "B"]
#: Presets that each of them knows.
PRESETS = {"he": ["imagenet", "hibou", "identity"], "ihc": ["imagenet", "hibou"]}
#: Draws of a seed's sequence start far apart for different seeds.
STRIDE = 1_000_003
#: Kinds of datasets of further modalities, by the modality's name; see register_modality.
KINDS: dict[str, type[ImagingDataset]] = {}


def register_modality(name: str, kind: type[ImagingDataset]) -> None:
    """Let datasets, compositions and cohorts know a modality of one's own.

    Its folder has the modality's name. The kind is a subclass that changes what it needs
    to: channel_table, measured, _normalized (values that are ready to use) or any read.
    """
    KINDS[name.strip().lower()] = kind


@dataclass
class ImagingDataset:
    """One modality of one dataset at one resolution: he, ihc_<marker> or a multiplex one.

    `spec` (method/uq_..._level) standardizes the pixels of a multiplex modality by the
    statistics files of that name; levels say which of them to read, `z_score` whether means
    and deviations count, `usable_only` whether channels without usable statistics go.
    `preset` normalizes the RGB values of the others. `filters` run after that, in order,
    on whole planes or on a tile's.
    """

    spark: SparkSession
    root: str
    name: str
    modality: str
    resolution: float = 1.0
    split: str | None = None
    label: str | None = None
    keep: list | None = None
    change: Callable[[Column], Column] | None = None
    spec: str | None = None
    quantile_level: str = "image"
    stats_level: str = "image"
    z_score: bool = True
    usable_only: bool = True
    preset: str = "imagenet"
    filters: list[tuple[str, dict]] = field(default_factory=list)
    strategy: str = "default"
    tile_size: int | None = None

    def __post_init__(self) -> None:
        lower = self.modality.strip().lower()
        self.modality = catalog.ALIASES.get(lower, lower)
        kinds = [*catalog.MODALITIES, *KINDS]
        if self.modality not in kinds and not self.modality.startswith("ihc_"):
            raise ValueError(f"no modality {self.modality!r}; there are {kinds} and ihc_<marker>")
        if self.rgb and self.preset not in (known := PRESETS[self.modality.split("_")[0]]):
            raise ValueError(f"no preset {self.preset!r}; there are {known}")
        if self.spec and self.spec.split("/")[0] == "identity":
            self.spec = None
        for filter_name, _ in self.filters:
            if filter_name not in kernels.FILTERS:
                raise ValueError(f"no filter {filter_name!r}; there are {sorted(kernels.FILTERS)}")

    @classmethod
    def of_marker(cls, spark: SparkSession, root: str, name: str, marker: str, **more) -> ImagingDataset:
        """The dataset of an IHC marker, named with or without its prefix."""
        return cls(spark, root, name, catalog.marker_modality(marker), **more)

    @property
    def rgb(self) -> bool:
        return self.modality == "he" or self.modality.startswith("ihc_")

    @property
    def folder(self) -> str:
        return f"{self.root}/{self.name}/{catalog.modality_dir(self.modality)}"

    @property
    def images(self) -> str:
        return f"{self.folder}/{catalog.resolution_dir(self.resolution)}/images"

    def all_tissues(self) -> DataFrame:
        """Tissues of every modality that pass the filters."""
        return metadata.filtered(catalog.tissues(self.spark, self.root, self.name), self.split, self.label, self.keep, self.change)

    def tissues(self, kind: str = "modality") -> DataFrame:
        """Tissues of this modality, or (`all`) of every one."""
        if kind not in ("modality", "all"):
            raise ValueError("kind is modality or all")
        rows = self.all_tissues()
        return rows if kind == "all" else rows.where(F.col("modality") == self.modality)

    def label_codes(self) -> DataFrame:
        """(label, code) of the tissues' labels, in order of first appearance."""
        if self.label is None:
            raise ValueError("the dataset has no label")
        return metadata.label_codes(self._placed(), self.label)

    def _placed(self) -> DataFrame:
        """The tissues with `pos`, their place in the table: by its files' names, then their rows."""
        rows = catalog.placed(catalog.tissues(self.spark, self.root, self.name))
        return metadata.filtered(rows, self.split, self.label, self.keep, self.change, self.modality)

    def cells(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{self.name}/metadata/cells.parquet")

    def patients(self) -> DataFrame:
        """(patient_id, tissue_ids), tissues of a patient in order of the table."""
        return metadata.patients(self._placed())

    @functools.cached_property
    def channel_table(self) -> DataFrame:
        """channels.parquet with channel_pos, the place of each row: its index where it has one."""
        if self.rgb:
            return self.spark.createDataFrame(list(enumerate(RGB)), "channel_pos int, channel_name string")
        rows = self.spark.read.parquet(f"{self.folder}/channels.parquet")
        if "channel_pos" in rows.columns:
            return rows
        if "index" in rows.columns:
            return rows.withColumn("channel_pos", F.col("index").cast("int"))
        # A small table: rows in order of its files and of their rows.
        order = Window.orderBy(F.col("_metadata.file_name"), F.col("_metadata.row_index"))
        return rows.withColumn("channel_pos", (F.row_number().over(order) - 1).cast("int"))

    def measured(self) -> DataFrame:
        """(tissue_id, channel_pos, channel_name, measured); all are, where no table says otherwise."""
        path = f"{self.folder}/channels_per_tissue.parquet"
        if self.rgb or not catalog.exists(self.spark, path):
            return channels.default_map(self.tissues(), self.channel_table)
        return channels.long_map(self.spark.read.parquet(path)).join(self.channel_table.select("channel_name", "channel_pos"), "channel_name")

    def selected_channels(self, kind: str = "complete", nuclear: bool = False, preprocess: bool = True) -> DataFrame:
        if self.rgb:
            kind = "complete"
        return channels.select(self.measured(), self.channel_table, kind, self._usable() if preprocess else None, nuclear)

    def _usable(self) -> DataFrame | None:
        """(tissue_id, channel_pos) of channels with usable statistics, if pixels are standardized."""
        if not self.spec or not self.usable_only:
            return None
        usable = stats.valid_stats(F.col("upper"), F.col("lower"), F.col("mean"), F.col("std"))
        return self._statistics().where(usable).select("tissue_id", "channel_pos").distinct()

    def _statistics(self) -> DataFrame:
        folder = f"{self.folder}/{catalog.resolution_dir(self.resolution)}/standardization/{self.spec}"
        if not catalog.exists(self.spark, folder):
            raise FileNotFoundError(f"no statistics {self.spec!r} of {self.name}, {self.modality}: {folder}")
        rows = self.measured().select("tissue_id", F.col("channel_name").alias("channel"), "channel_pos")
        for level, part in ((self.quantile_level, ["upper", "lower"]), (self.stats_level, ["mean", "std"])):
            table = catalog.statistics_of(self.spark, folder, level, self.channel_table, part)
            rows = catalog.with_statistics(rows, table, part)
        return rows

    def pixels(self, tissue: str | None = None, kind: str = "complete", window: tuple[int, int, int, int] | None = None, preprocess: bool = True) -> DataFrame:
        """(tissue_id, channel_pos, channel, y, x, value) of the chosen channels.

        Only chunks of the tissue, window (y, x, h, w) and chosen channels are read.
        preprocess normalizes the values by the spec or preset, and filters whole planes
        (or the window's part of them).
        """
        rows = self._values(tissue, kind, window, preprocess)
        if not preprocess or not self.filters:
            return rows
        return self._filtered(rows, ["tissue_id", "channel_pos", "channel"])

    def _values(self, tissue: str | None, kind: str, window: tuple[int, int, int, int] | None, preprocess: bool, chosen: DataFrame | None = None) -> DataFrame:
        chosen = self.selected_channels(kind, preprocess=preprocess) if chosen is None else chosen
        if tissue is not None:
            chosen = chosen.where(F.col("tissue_id") == tissue)
        planes = sorted(r["plane"] for r in chosen.select("plane").distinct().collect())  # as many as there are channels
        rows = self._stored(planes, window, tissue).join(chosen, ["tissue_id", "plane"]).withColumnRenamed("channel_name", "channel").drop("plane", "uniprot_id")
        return self._normalized(rows) if preprocess else rows

    def _stored(self, planes: list[int], window: tuple[int, int, int, int] | None, tissue: str | None) -> DataFrame:
        """(tissue_id, plane, y, x, value): tasks read the stores by themselves where they reach them, else Spark lists the files."""
        if not store.reachable(self.images):
            return arrays.zarr_pixels(self.spark, self.images, planes, window, [tissue] if tissue is not None else None).withColumnRenamed("store", "tissue_id")
        rows = store.pixels(self.spark, self.images).where(F.col("plane").isin(planes))
        if window is not None:
            y, x, h, w = window
            rows = rows.where((F.col("y") >= y) & (F.col("y") < y + h) & (F.col("x") >= x) & (F.col("x") < x + w))
        return rows if tissue is None else rows.where(F.col("tissue_id") == tissue)

    def _filtered(self, rows: DataFrame, keys: list[str], y: str = "y", x: str = "x") -> DataFrame:
        """rows with values filtered: in chunks with a halo, or whole planes for filters whose reach isn't known."""
        if all(name in stencil.REACH for name, _ in self.filters):
            return stencil.filter_pixels(rows, keys, self.filters, y, x)
        each = kernels.as_planes(rows, keys, y, x)
        return kernels.as_pixels(kernels.apply_filters(each, self.filters, "h", "w"), keys, y, x)

    def planes(self, tissue: str | None = None, kind: str = "complete") -> DataFrame:
        """(tissue_id, channel, channel_pos, h, w, values): whole planes, filtered in order."""
        rows = kernels.as_planes(self._values(tissue, kind, None, True), ["tissue_id", "channel", "channel_pos"])
        rows = rows.drop("top", "left")
        return kernels.apply_filters(rows, self.filters, "h", "w") if self.filters else rows

    def image(self, tissue: str, kind: str = "complete", channels_first: bool = True) -> DataFrame:
        """(tissue_id, values): the image flat, plane by plane or pixel by pixel."""
        return kernels.layout(self.pixels(tissue, kind), channels_first)

    def _masks_folder(self) -> str:
        folder = f"{self.root}/{self.name}/segmentations/{catalog.resolution_dir(self.resolution)}/tissue_masks"
        if not catalog.exists(self.spark, folder):
            raise ValueError(f"there are no tissue masks: {folder}")
        return folder

    def mask(self) -> DataFrame:
        """(tissue_id, y, x) of tissue pixels: all of an image without a mask file, none of an empty mask."""
        folder = self._masks_folder()
        return arrays.masks_or_full(arrays.masks(self.spark, folder), arrays.mask_names(self.spark, folder), self.sizes())

    def mask_runs(self, tissues: list[str] | None = None) -> DataFrame:
        """The same as runs (tissue_id, y, x0, x1); of some tissues only their files are read."""
        folder = self._masks_folder()
        sizes = self.sizes() if tissues is None else self.sizes().where(F.col("tissue_id").isin(tissues))
        return arrays.runs_or_full(arrays.mask_runs(self.spark, folder, tissues), arrays.mask_names(self.spark, folder, tissues), sizes)

    def valid_ratios(self) -> DataFrame:
        """The tiles' coordinates with the share of tissue of each, and its grade."""
        return runs.valid_ratio(self.mask_runs(), self.coords(), self.tile_size)

    def extents(self) -> DataFrame:
        """(tissue_id, h, w) of the masks, or of the images without one."""
        known = arrays.mask_sizes(self.spark, self._masks_folder())
        return known.unionByName(self.sizes().select("tissue_id", "h", "w").join(known, "tissue_id", "left_anti"))

    def compute_tiling(self, strategy: str = "grid", overwrite: bool = False, **how) -> list[str]:
        """Tile the masks and write coordinates and statistics where the readers look for them."""
        files = arrays.mask_files(self.spark, self._masks_folder())
        # coordinates and statistics scan the masks several times: they are read once
        held, extents = self.mask_runs().persist(StorageLevel.MEMORY_AND_DISK), self.extents().persist(StorageLevel.MEMORY_AND_DISK)
        try:
            return jobs.compute_tiling(runs.pixels(held), f"{self.root}/{self.name}", self.resolution, self.tile_size, strategy, overwrite=overwrite, extents=extents, files=files, **how)
        finally:
            held.unpersist()
            extents.unpersist()

    def masked_pixels(self, tissues: list[str] | None = None, chosen: DataFrame | None = None) -> DataFrame:
        """Raw pixels of all measured channels, or of the chosen ones, that are tissue, which statistics are computed from."""
        rows = self._values(None, "complete", None, False, chosen)
        if tissues is not None:
            rows = rows.where(F.col("tissue_id").isin(tissues))
        return runs.masked(rows, self.mask_runs(tissues))

    def _measured_pixels(self, tissues: list[str] | None = None) -> tuple[DataFrame, str, list[str]]:
        """Pixels to compute statistics from, the folder that they go to, and the channels' names."""
        names = [r["channel_name"] for r in self.channel_table.orderBy("channel_pos").select("channel_name").collect()]
        folder = f"{self.folder}/{catalog.resolution_dir(self.resolution)}"
        # a name that comes again has the statistics of its first measured channel
        nth = F.row_number().over(Window.partitionBy("tissue_id", "channel_name").orderBy("channel_pos"))
        first = self.selected_channels(preprocess=False).withColumn("nth", nth).where("nth = 1").drop("nth")
        return self.masked_pixels(tissues, first), folder, list(dict.fromkeys(names))

    def compute_statistics(self, upper: float = 0.99, lower: float | None = None, overwrite: bool = False, **how) -> list[str]:
        """Statistics of the tissue pixels, written where a dataset with such a spec looks for them."""
        pixels, folder, names = self._measured_pixels()
        return jobs.compute_statistics(pixels, folder, names, upper, lower, overwrite=overwrite, **how)

    @property
    def pixel_counts(self) -> states.PixelCounts:
        """The counts of values that update_statistics keeps beside the images."""
        return states.PixelCounts(self.spark, f"{self.folder}/{catalog.resolution_dir(self.resolution)}/value_counts")

    def update_statistics(self, upper: float = 0.99, lower: float | None = None, **how) -> list[str]:
        """The same files, of all tissues so far: images and masks of tissues that came since the last time are read, those before aren't.

        A tissue without a tissue pixel leaves no count, and so is looked at again.
        """
        counts = self.pixel_counts
        known = counts.tissues()
        # names of tissues, as many as came since; none is named the first time
        new = None if known.isEmpty() else [r[0] for r in self.tissues().select(F.col("tissue_id").cast("string").alias("tissue_id")).distinct().join(known, "tissue_id", "left_anti").collect()]
        pixels, folder, names = self._measured_pixels(new)
        if new is None or new:
            counts.add(pixels)
        return jobs.update_statistics(counts, folder, names, upper, lower, **how)

    def cell_mask(self, kind: str = "instances") -> DataFrame:
        """Labelled pixels of cells; tasks come with the names of their labels."""
        folder = f"{self.root}/{self.name}/segmentations/{catalog.resolution_dir(self.resolution)}/cell_masks/{kind}"
        if not catalog.exists(self.spark, folder):
            raise ValueError(f"there are no cell masks {kind!r}: {folder}")
        found = arrays.masks(self.spark, folder, labels=True)
        return found if kind.startswith("instances") else arrays.named_labels(found, self.spark.read.parquet(f"{folder}/label_encoder.parquet"))

    def sizes(self) -> DataFrame:
        """(tissue_id, c, h, w) from the stores' metadata."""
        return self._sizes

    @functools.cached_property
    def _sizes(self) -> DataFrame:
        if store.reachable(self.images):
            return store.shapes(self.spark, self.images)
        shapes = arrays.zarr_shapes(self.spark, self.images)
        return shapes.select(F.col("store").alias("tissue_id"), *[F.col("shape")[i].alias(n) for i, n in enumerate("chw")])

    def coords(self) -> DataFrame:
        path = catalog.coords_path(self.root, self.name, self.resolution, self.strategy, self.tile_size)
        return metadata.of_dataset(tiles.validated(self.spark.read.parquet(path)), self.tissues())

    def tile_stats(self) -> DataFrame:
        """The statistics that were written beside the tile coordinates."""
        path = catalog.coords_path(self.root, self.name, self.resolution, self.strategy, self.tile_size)
        return self.spark.read.parquet(path.replace("_coordinates.parquet", "_stats.parquet"))

    def tile_at(self, tissue: str, row: int, col: int, kind: str = "complete", preprocess: bool = True) -> DataFrame:
        """(tissue_id, tile_id, channel, channel_pos, dy, dx, value) of a tile; zeros fill it up unless the strategy is default.

        Outside of the image are zeros before values are normalized, as a reader of a padded tile has it.
        """
        size = self.tile_size
        chosen = self.selected_channels(kind, preprocess=preprocess).where(F.col("tissue_id") == tissue).select("tissue_id", "channel_pos", F.col("channel_name").alias("channel"))
        rows = self._values(tissue, kind, (row, col, size, size), False).join(chosen.select("channel_pos"), "channel_pos", "left_semi")
        held = rows.select("channel_pos", (F.col("y") - row).alias("dy"), (F.col("x") - col).alias("dx"), "value")
        if self.strategy != "default":
            steps = F.sequence(F.lit(0), F.lit(size - 1))
            full = chosen.select("channel_pos").select("*", F.explode(steps).alias("dy")).select("*", F.explode(steps).alias("dx"))
            held = full.join(held, ["channel_pos", "dy", "dx"], "left").na.fill(0.0, ["value"])
        held = held.join(chosen, "channel_pos").withColumn("tile_id", F.lit(0))
        if preprocess:
            held = self._normalized(held)
            if self.filters:
                held = self._filtered(held, ["tissue_id", "tile_id", "channel", "channel_pos"], "dy", "dx")
        return held.select("tissue_id", "tile_id", "channel", "channel_pos", "dy", "dx", "value")

    def _normalized(self, rows: DataFrame) -> DataFrame:
        """rows(tissue_id, channel_pos, channel, value, ...) normalized by the place of their channel, not by its name."""
        if self.rgb:
            return rows.withColumn("value", stats.rgb_preprocess(F.col("value"), F.col("channel_pos"), self.preset))
        if not self.spec:
            return rows
        known = rows.join(self._statistics().drop("channel"), ["tissue_id", "channel_pos"])
        z = stats.transform_named(self.spec)(F.col("value"), F.col("lower"), F.col("upper"))
        return known.withColumn("value", (z - F.col("mean")) / (F.col("std") + stats.EPSILON) if self.z_score else z).drop("upper", "lower", "mean", "std")

    def tile(self, tissue: str, ordinal: int, kind: str = "complete", preprocess: bool = True) -> DataFrame:
        """The tile at a place of the tissue's list, or one at a reproducible random offset without a list."""
        if self.strategy == "default":
            found = tiles.random_tiles(self.sizes().where(F.col("tissue_id") == tissue), self.tile_size, ordinal)
        else:
            found = tiles.by_ordinal(self.coords().where(F.col("tissue_id") == tissue), ordinal)
        at = found.select("row", "col").first()
        if at is None:
            raise KeyError(f"tissue {tissue} has no tile {ordinal}")
        return self.tile_at(tissue, at["row"], at["col"], kind, preprocess)

    def channel_labels(self, tissue: str) -> list[str]:
        """Names to show for a tissue's planes: identified channels, else all, else their numbers."""
        for kind in ("uniprot_filtered", "complete"):
            rows = self.selected_channels(kind, preprocess=False).where(F.col("tissue_id") == tissue).orderBy("channel_pos").select("channel_name").collect()
            if rows:
                return [r["channel_name"] for r in rows]
        size = self.sizes().where(F.col("tissue_id") == tissue).first()
        return [f"Ch {i}" for i in range(size["c"] if size else 10)]


@dataclass
class ComposedDataset:
    """Several modalities of one dataset.

    `modalities` are used in their order; `ihc` stands for all markers on disk, which come
    last. `settings` has further arguments of ImagingDataset by modality (`ihc` for every marker).
    """

    spark: SparkSession
    root: str
    name: str
    modalities: list[str]
    resolution: float = 1.0
    strategy: str = "default"
    tile_size: int | None = None
    split: str | None = None
    settings: dict[str, dict] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if "ihc" in self.modalities:
            markers = catalog.expanded_modalities(self.spark, self.root, self.name, ["ihc"])
            if not markers:
                raise FileNotFoundError(f"{self.name} has no IHC markers")
            self.modalities = [m for m in self.modalities if m != "ihc"] + markers
        self.datasets = {}
        for modality in self.modalities:
            own = self.settings.get("ihc" if modality.startswith("ihc_") else modality, {})
            kind = KINDS.get(modality.strip().lower(), ImagingDataset)
            made = kind(self.spark, self.root, self.name, modality, self.resolution, self.split, strategy=self.strategy, tile_size=self.tile_size, **own)
            self.datasets[made.modality] = made

    def dataset(self, modality: str) -> ImagingDataset:
        if modality not in self.datasets:
            raise KeyError(f"{modality!r} is none of {list(self.datasets)}")
        return self.datasets[modality]

    def available(self) -> list[str]:
        return list(self.datasets)

    def tissues(self, modality: str | None = None) -> DataFrame:
        """Tissues of one modality, or the rows of all of them."""
        if modality is not None:
            return self.dataset(modality).tissues()
        rows = next(iter(self.datasets.values())).all_tissues()
        return rows.where(F.col("modality").isin(list(self.datasets)))

    def tissue_modalities(self) -> DataFrame:
        """(tissue_id, modalities) in the order of the modalities."""
        return metadata.modalities(self.tissues(), list(self.datasets))

    def _placed(self) -> DataFrame:
        """(tissue_id, patient_id, pos): each tissue once, at its first place in the table."""
        first = next(iter(self.datasets.values()))
        rows = metadata.filtered(catalog.placed(catalog.tissues(self.spark, self.root, self.name)), first.split)
        rows = rows.where(F.col("modality").isin(list(self.datasets)))
        return rows.groupBy("tissue_id", "patient_id").agg(F.min("pos").alias("pos"))

    def patients(self) -> DataFrame:
        """(patient_id, tissue_ids), tissues of a patient in order of the table."""
        return metadata.patients(self._placed())

    def _modalities_of(self, tissue: str) -> list[str]:
        found = self.tissue_modalities().where(F.col("tissue_id").cast("string") == str(tissue)).first()
        if found is None:
            raise KeyError(f"{self.name} has no tissue {tissue}")
        return found["modalities"]

    def _together(self, tissue: str, read: Callable[[ImagingDataset], DataFrame]) -> DataFrame:
        parts = [read(self.datasets[m]).select(F.lit(m).alias("modality"), "*") for m in self._modalities_of(tissue)]
        return functools.reduce(DataFrame.unionByName, parts)

    def tissue(self, tissue: str, kind: str = "uniprot_filtered", preprocess: bool = True) -> DataFrame:
        """(modality, tissue_id, channel_pos, channel, y, x, value) of all modalities of a tissue."""
        return self._together(tissue, lambda d: d.pixels(tissue, kind, preprocess=preprocess))

    def tile(self, tissue: str, ordinal: int, kind: str = "uniprot_filtered", preprocess: bool = True) -> DataFrame:
        """(modality, tissue_id, tile_id, channel, channel_pos, dy, dx, value) of a tile in all modalities of a tissue."""
        return self._together(tissue, lambda d: d.tile(tissue, ordinal, kind, preprocess))

    def tile_at(self, tissue: str, row: int, col: int, kind: str = "uniprot_filtered", preprocess: bool = True) -> DataFrame:
        """The same of the tile at a row and column."""
        return self._together(tissue, lambda d: d.tile_at(tissue, row, col, kind, preprocess))

    def patient(self, patient: object, kind: str = "uniprot_filtered", preprocess: bool = True) -> DataFrame | None:
        """All tissues of a patient, each with all of its modalities; None for an unknown patient."""
        found = metadata.of_patient(self.patients(), patient).first()
        parts = [self.tissue(t, kind, preprocess) for t in found["tissue_ids"]] if found else []
        return functools.reduce(DataFrame.unionByName, parts) if parts else None


@dataclass
class Cohort:
    """Several datasets with the modalities that each of them has.

    Datasets without a modality that was asked for are left out. `settings` are those of
    ComposedDataset, `dataset_settings` the same by dataset, which take precedence.
    """

    spark: SparkSession
    root: str
    datasets: list[str]
    modalities: list[str] | None = None
    resolution: float = 1.0
    strategy: str = "default"
    tile_size: int | None = None
    split: str | None = None
    settings: dict[str, dict] = field(default_factory=dict)
    dataset_settings: dict[str, dict[str, dict]] = field(default_factory=dict)
    unit: str | None = None
    stored: index.StoredIndex | None = None

    def __post_init__(self) -> None:
        if not self.datasets:
            raise ValueError("name one dataset at least")
        self.unit = self.unit or ("tiles" if self.tile_size is not None else "tissues")
        if self.unit not in ("tiles", "tissues") or (self.unit == "tiles" and self.tile_size is None):
            raise ValueError("the unit is tissues, or tiles with a tile size")
        self.members: dict[str, ComposedDataset] = {}
        for name in self.datasets:
            if not catalog.exists(self.spark, f"{self.root}/{name}"):
                raise FileNotFoundError(f"no dataset {self.root}/{name}")
            own = catalog.expanded_modalities(self.spark, self.root, name, self.modalities, list(KINDS))
            if own:
                self.members[name] = ComposedDataset(self.spark, self.root, name, own, self.resolution, self.strategy, self.tile_size, self.split, self._settings_of(name))
        if not self.members:
            raise ValueError("no dataset has a modality that was asked for")

    def _settings_of(self, name: str) -> dict[str, dict]:
        own = self.dataset_settings.get(name, {})
        return {m: {**self.settings.get(m, {}), **own.get(m, {})} for m in {*self.settings, *own}}

    def dataset(self, name: str) -> ComposedDataset:
        return self.members[name]

    def tissue_index(self) -> DataFrame:
        """(dataset_name, tissue_id, modalities) of all datasets."""
        return metadata.tissue_index({name: d.tissue_modalities() for name, d in self.members.items()})

    def tile_index(self) -> DataFrame:
        """Tiles of all datasets that have coordinates, with a dense global_tile_id: by dataset as given, then by place in the file."""
        parts = []
        for place, (name, d) in enumerate(self.members.items()):
            path = catalog.coords_path(self.root, name, self.resolution, self.strategy, self.tile_size)
            if catalog.exists(self.spark, path):
                rows = metadata.of_dataset(catalog.placed(tiles.validated(self.spark.read.parquet(path))), d.tissues())
                parts.append(rows.select(F.lit(place).alias("place"), "pos", F.lit(name).alias("dataset_name"), "tissue_id", "tile_id", "row", "col"))
        if not parts:
            raise FileNotFoundError(f"no dataset has tiles of {self.tile_size} by {self.strategy} at {self.resolution}")
        return self._numbered(functools.reduce(DataFrame.unionByName, parts), "global_tile_id")

    def _numbered(self, rows: DataFrame, name: str) -> DataFrame:
        """rows(place, pos, ...) numbered from 0 by place of the dataset, then place in the table; blocks of rows bound each sort."""
        blocks = rows.withColumns({"file": F.col("pos.file"), "block": F.floor(F.col("pos.row") / index.BLOCK)})
        return index.numbered(blocks, ["place", "file", "block"], ["pos"], name).drop("place", "pos", "file", "block")

    def index(self) -> DataFrame:
        """The units' index, with a dense global_id from 0 in the order of the datasets given."""
        if self.unit == "tiles":
            return self.tile_index().withColumnRenamed("global_tile_id", "global_id")
        parts = [
            d.tissue_modalities().join(d._placed().groupBy("tissue_id").agg(F.min("pos").alias("pos")), "tissue_id")
            .select(F.lit(place).alias("place"), "pos", F.lit(name).alias("dataset_name"), F.col("tissue_id").cast("string").alias("tissue_id"), "modalities")
            for place, (name, d) in enumerate(self.members.items())
        ]
        return self._numbered(functools.reduce(DataFrame.unionByName, parts), "global_id")

    def store_index(self, path: str, overwrite: bool = False) -> index.StoredIndex:
        """The index written once to a folder; `at`, `random`, `draws` and `size` use it from then on, and read the files they need only."""
        self.stored = index.StoredIndex(self.spark, path)
        if overwrite or not self.stored.there():
            self.stored.write(self.index())
        return self.stored

    def size(self) -> int:
        return self.stored.size() if self.stored else self.index().count()

    def per_dataset(self) -> DataFrame:
        """(dataset_name, n) units."""
        return self.index().groupBy("dataset_name").agg(F.count("*").alias("n"))

    def at(self, index: int, kind: str = "uniprot_filtered", preprocess: bool = True) -> DataFrame:
        """The unit with a global id, read in all its modalities; negative ones count from the end."""
        wanted = index if index >= 0 else self.size() + index
        found = (self.stored.at(wanted) if self.stored else self.index().where(F.col("global_id") == wanted)).first() if wanted >= 0 else None
        if found is None:
            raise IndexError(f"no unit {index}")
        return self._read(found, kind, preprocess)

    def _read(self, unit, kind: str, preprocess: bool) -> DataFrame:
        d = self.members[unit["dataset_name"]]
        tissue = unit["tissue_id"]
        rows = d.tile_at(tissue, unit["row"], unit["col"], kind, preprocess) if self.unit == "tiles" else d.tissue(tissue, kind, preprocess)
        return rows.select(F.lit(unit["dataset_name"]).alias("dataset_name"), "*")

    def sample(self, n: int, seed: int) -> DataFrame:
        """n tissues, or tiles if that is the unit, each with equal chance and once at most."""
        if self.unit == "tissues":
            return metadata.sample(self.tissue_index(), n, seed, ["dataset_name", "tissue_id"])
        return metadata.sample(self.tile_index(), n, seed, ["global_tile_id"])

    def draws(self, n: int, seed: int) -> DataFrame:
        """n units drawn with replacement, reproducibly, with the number of the draw."""
        if self.stored:
            return self.stored.draws(n, seed)
        return metadata.sample_with_replacement(self.index(), n, seed, "global_id")

    def random(self, seed: int, draw: int = 0, kind: str = "uniprot_filtered", preprocess: bool = True) -> DataFrame:
        """One unit drawn by seed and number of the draw, read in all its modalities."""
        unit = self.draws(1, seed * STRIDE + draw).first()
        return self._read(unit, kind, preprocess)
