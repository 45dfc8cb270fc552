"""What folders of datasets hold, found by tasks: each dataset's folder is walked where its row is.

The driver lists the names of the datasets only. A fact is a row of one kind: a dataset's head, a
row of its tissues, a level of a modality, statistics, tile coordinates, a channel. Of coordinates
the footers tell the rows, and only the column of tissues is read.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import dataset as arrow
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

from tessera.operators import inventory
from tessera.session import ship_package
from tessera.sources import catalog, store

COORDINATES = "_tile_coordinates.parquet"
FACTS = (
    "dataset string, kind string, modality string, level string, method string, name string, path string, n long, m long,"
    " qc_pass boolean, is_nuclear_marker boolean, uniprot_id string, description string"
)
ARROW = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}
SCHEMA = pa.schema([(name, ARROW[kind]) for name, kind in (c.split() for c in FACTS.split(","))])
#: Facts in one batch of rows.
TOGETHER = 10_000


class Folder:
    """A dataset's folder; paths are below it."""

    def __init__(self, root: str, name: str):
        self.files, top = store.opened(root)
        self.at, self.shown = f"{top}/{name}", f"{root}/{name}"

    def names(self, path: str) -> list[tuple[str, bool]]:
        """(name, whether it is a folder) in order; nothing if there is no such folder."""
        where = f"{self.at}/{path}".rstrip("/")
        if self.files.get_file_info(where).type != fs.FileType.Directory:
            return []
        return sorted((f.base_name, f.type == fs.FileType.Directory) for f in self.files.get_file_info(fs.FileSelector(where)))

    def folders(self, path: str, end: str = "") -> list[str]:
        return [n for n, is_folder in self.names(path) if is_folder and n.endswith(end)]

    def table(self, path: str) -> arrow.Dataset | None:
        """A Parquet file or a folder of them; None if it can't be read."""
        try:
            return arrow.dataset(f"{self.at}/{path}", format="parquet", filesystem=self.files)
        except (OSError, pa.ArrowException):
            return None

    def stores(self, path: str) -> int:
        images = f"{path}/images"
        there = self.files.get_file_info(f"{self.at}/{images}").type != fs.FileType.NotFound
        return len(self.folders(images if there else path, ".zarr"))

    def specs(self, path: str) -> list[str]:
        """Folders with statistics, one or two levels below."""

        def holds(at: str) -> bool:
            return any(n.endswith(".parquet") for n, _ in self.names(at))

        methods = [m for m in self.folders(path) if not m.endswith(".parquet")]
        below = [f"{m}/{s}" for m in methods for s in self.folders(f"{path}/{m}") if not s.endswith(".parquet")]
        return [s for s in methods + below if holds(f"{path}/{s}")]


def _columns(table: arrow.Dataset, kinds: dict[str, pa.DataType], fragments: bool = False) -> Iterator[dict]:
    """Rows with those columns, cast; missing columns are null. `row` is a row's place in its file."""
    known = [c for c in kinds if c in table.schema.names]
    for part in table.get_fragments() if fragments else [table]:
        row = 0
        for batch in part.scanner(schema=table.schema, columns=known).to_batches() if fragments else part.scanner(columns=known).to_batches():
            values = [pc.cast(batch.column(c), kinds[c]).to_pylist() if c in known else [None] * len(batch) for c in kinds]
            for i, one in enumerate(zip(*values, strict=True), row):
                yield {**dict(zip(kinds, one, strict=True)), "row": i}
            row += len(batch)


def channel_facts(folder: Folder) -> Iterator[dict]:
    for modality in inventory.MULTIPLEX:
        table = folder.table(f"{modality}/channels.parquet")
        if table is None or "channel_name" not in table.schema.names:
            continue
        text = dict.fromkeys(("channel_name", "uniprot_id", "description"), pa.string())
        rows = _columns(table, {"index": pa.int64(), **text, "qc_pass": pa.bool_(), "is_nuclear_marker": pa.bool_()}, fragments=True)
        numbered = "index" in table.schema.names
        for r in rows:
            own = {c: r[c] for c in ("uniprot_id", "description", "qc_pass", "is_nuclear_marker")}
            yield {"kind": "channel", "modality": modality, "n": r["index"] if numbered else r["row"], "name": r["channel_name"], "path": f"{folder.shown}/{modality}/channels.parquet", **own}


def crop_counts(table: arrow.Dataset | None) -> tuple[int, int]:
    """(tissues, tiles) of a table of coordinates; none of one that can't be read."""
    if table is None:
        return 0, 0
    try:
        seen: set = set()
        if "tissue_id" in table.schema.names:
            for batch in table.scanner(columns=["tissue_id"]).to_batches():
                seen.update(pc.unique(batch.column(0)).to_pylist())
        return len(seen - {None}), table.count_rows()
    except (OSError, pa.ArrowException):
        return 0, 0


def dataset_facts(folder: Folder) -> Iterator[dict]:
    """All facts of a dataset but its channels; none if its tissues can't be read."""
    table = folder.table("metadata/tissues.parquet")
    if table is None:
        return
    named = set()
    for r in _columns(table, {"modality": pa.string(), "tissue_id": pa.string()}):
        named.add(r["modality"])
        yield {"kind": "tissue", "modality": r["modality"], "name": r["tissue_id"]}
    named = sorted(named - {None})
    roots = [n for n in folder.folders("") if n in (*catalog.MODALITIES, "ihc", "mif")]
    on_disk = [n for n in roots if n in catalog.MODALITIES] + [n for n in folder.folders("ihc") if n.startswith("ihc_")]
    known = [m for m in named if m in catalog.MODALITIES or m.startswith("ihc_")]
    yield {"kind": "head", "name": ", ".join(named), "level": ", ".join(roots), "path": f"{folder.shown}/metadata/tissues.parquet"}
    for modality in sorted({*known, *on_disk}):
        at = catalog.modality_dir(modality)
        one = {"modality": modality, "path": f"{folder.shown}/{at}"}
        levels = folder.folders(at, "mpp")
        if not levels:
            yield {"kind": "level", **one}
        for level in levels:
            yield {"kind": "level", **one, "level": level, "n": folder.stores(f"{at}/{level}")}
            below = f"{at}/{level}/standardization"
            for spec in folder.specs(below) if modality in inventory.MULTIPLEX else []:
                yield {"kind": "spec", "modality": modality, "level": level, "name": spec, "path": f"{folder.shown}/{below}/{spec}"}
    for level in folder.folders("tiling", "mpp"):
        for method in folder.folders(f"tiling/{level}"):
            at = f"tiling/{level}/{method}"
            for name, _ in folder.names(at):
                if name.endswith(COORDINATES):
                    tissues, tiles = crop_counts(folder.table(f"{at}/{name}"))
                    yield {"kind": "crop", "level": level, "method": method, "name": name, "path": f"{folder.shown}/{at}/{name}", "n": tissues, "m": tiles}


def facts(spark: SparkSession, root: str, datasets: list[str], channels_only: bool = False) -> DataFrame:
    """The facts of some datasets of a folder; datasets are dealt to tasks, which walk them."""
    ship_package(spark)
    root = root.rstrip("/")
    tasks = max(1, min(len(datasets), 4 * spark.sparkContext.defaultParallelism))
    names = spark.createDataFrame([(i % tasks, d) for i, d in enumerate(datasets)], "task int, dataset string")
    dealt = names.repartitionByRange(tasks, "task").select("dataset")

    def run(batches):
        for batch in batches:
            for name in batch.column("dataset").to_pylist():
                folder = Folder(root, name)
                found = channel_facts(folder) if channels_only else itertools.chain(dataset_facts(folder), channel_facts(folder))
                for some in itertools.batched(found, TOGETHER):
                    yield pa.RecordBatch.from_pylist([{**dict.fromkeys(SCHEMA.names), "dataset": name, **f} for f in some], SCHEMA)

    return dealt.mapInArrow(run, FACTS)
