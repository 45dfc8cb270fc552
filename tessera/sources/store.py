"""Array stores as a Spark data source: pixels of images, with filters that prune stores and chunks.

    spark.read.format("tessera_store").load(folder).where("tissue_id = 't1' and y < 512")

The driver lists the folder's names only. A task reads the metadata of its stores, plans the names
of the chunks that the filters leave, and opens those. Files are opened by Arrow's file systems.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from tessera.session import ship_package
from tessera.sources.layout import Layout, read_layout

NAME, FILES = "tessera_store", "tessera_files"
PIXELS = "tissue_id string, plane int, y int, x int, value double"
SHAPES = "tissue_id string, c int, h int, w int"
#: Tasks of a read unless it is told: few stores are dealt out in slices, many share tasks.
TASKS = 200
#: Pixels in one batch of rows, and from how many on a batch isn't filled up by the next chunk's.
TOGETHER, ENOUGH = 1 << 20, 1 << 16
#: Bytes of files in one batch, unless a file is larger.
FILE_BYTES = 4 << 20
#: Where Arrow's file systems reach.
SCHEMES = ("", "file", "hdfs", "viewfs", "s3", "s3a", "gs", "abfs", "abfss")


def reachable(folder: str) -> bool:
    """Whether tasks can open files there by themselves."""
    return (re.match(r"([a-z0-9]+):/", folder) or [None, ""])[1] in SCHEMES


def opened(folder: str) -> tuple[fs.FileSystem, str]:
    if re.match(r"file:/", folder):
        folder = re.sub(r"^file:/+", "/", folder)
    if "://" in folder:
        return fs.FileSystem.from_uri(re.sub(r"^s3a:", "s3:", folder))
    return fs.LocalFileSystem(), folder


def content(files: fs.FileSystem, path: str) -> bytes | None:
    try:
        with files.open_input_file(path) as file:
            return file.read()
    except FileNotFoundError:
        return None


@dataclass
class Stores(InputPartition):
    """Stores of a task, and which of their chunks: numbers that leave `slice` when divided by `slices`."""

    names: list[str]
    slice: int = 0
    slices: int = 1


@dataclass
class Bounds:
    """What filters leave: sets of tissues and planes (None: all), and [first, last) along axes."""

    tissues: set[str] | None = None
    planes: set[int] | None = None
    ranges: dict[str, tuple[int, int]] = field(default_factory=dict)

    def add(self, f: Filter) -> None:
        column = getattr(f, "attribute", ())
        if len(column) != 1 or column[0] not in ("tissue_id", "plane", "y", "x"):
            return
        name = column[0]
        some = {f.value} if isinstance(f, EqualTo | EqualNullSafe) else set(f.value) if isinstance(f, In) else None
        if name == "tissue_id":
            if some is not None:
                self.tissues = some if self.tissues is None else self.tissues & some
            return
        some = None if some is None else {v for v in some if v is not None}
        if some is not None and name == "plane":
            self.planes = some if self.planes is None else self.planes & some
        axis = "c" if name == "plane" else name
        first, last = self.ranges.get(axis, (0, 1 << 31))
        if some is not None:
            first, last = max(first, min(some, default=1)), min(last, max(some, default=0) + 1)
        elif isinstance(f, GreaterThan | GreaterThanOrEqual):
            first = max(first, f.value + isinstance(f, GreaterThan))
        elif isinstance(f, LessThan | LessThanOrEqual):
            last = min(last, f.value + isinstance(f, LessThanOrEqual))
        self.ranges[axis] = (first, last)


def joined(batches: Iterator[pa.RecordBatch], enough: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of `enough` rows or more, but for the last: each batch costs something on its way to Spark."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= enough:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, n = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


class StoreReader(DataSourceReader):
    def __init__(self, options):
        self.folder = options["path"].rstrip("/")
        self.shapes = options.get("rows", "pixels") == "shapes"
        self.level = int(options.get("level", 0))
        self.axes = options.get("axes")
        self.tasks = int(options.get("tasks", TASKS))
        self.fixed = {a: int(options.get(a, 0)) for a in "tz"}
        self.bounds = Bounds()

    def pushFilters(self, filters: list[Filter]):
        """Filters prune here, and Spark evaluates them again."""
        for f in filters:
            self.bounds.add(f)
        return filters

    def partitions(self) -> list[InputPartition]:
        files, folder = opened(self.folder)
        wanted = self.bounds.tissues
        if wanted is None:
            found = files.get_file_info(fs.FileSelector(folder, allow_not_found=True))
        else:
            paths = [f"{folder}/{t}{end}" for t in sorted(t for t in wanted if t) for end in (".ome.zarr", ".zarr")]
            found = files.get_file_info(paths) if paths else []
        names = sorted(f.base_name for f in found if f.type == fs.FileType.Directory and f.base_name.endswith(".zarr"))
        if self.shapes or len(names) >= self.tasks:
            return [Stores(names[i :: self.tasks]) for i in range(min(len(names), self.tasks))] or [Stores([])]
        slices = -(-self.tasks // max(1, len(names)))
        return [Stores([n], i, slices) for n in names for i in range(slices)] or [Stores([])]

    def read(self, partition: Stores) -> Iterator[pa.RecordBatch]:
        return joined(self._batches(partition), ENOUGH)

    def _batches(self, partition: Stores) -> Iterator[pa.RecordBatch]:
        files, folder = opened(self.folder)
        for name in partition.names:
            store = f"{folder}/{name}"
            path, layout = read_layout(lambda p, store=store: content(files, f"{store}/{p}"), self.level, self.axes)
            tissue = name.removesuffix(".zarr").removesuffix(".ome")
            if self.shapes:
                yield pa.RecordBatch.from_arrays([pa.array([tissue]), *(pa.array([n], pa.int32()) for n in layout.chw)], ["tissue_id", "c", "h", "w"])
                continue
            ranges = {**{a: (i, i + 1) for a, i in self.fixed.items()}, **self.bounds.ranges}
            for i, at in enumerate(layout.wanted(ranges, self.bounds.planes)):
                if i % partition.slices == partition.slice:
                    values = layout.values(content(files, f"{store}/{path}/{layout.name(at)}"))
                    if values is not None:
                        yield from self._rows(tissue, layout, at, values, ranges)

    def _rows(self, tissue: str, layout: Layout, at: tuple[int, ...], values: np.ndarray, ranges: dict) -> Iterator[pa.RecordBatch]:
        """Rows of a chunk that the ranges and planes leave."""
        begin, cut = {}, []
        for axis, number, chunk, n in zip(layout.axes, at, layout.chunks, layout.shape, strict=True):
            first, last = ranges.get(axis, (0, n))
            begin[axis] = max(number * chunk, first)
            cut.append(slice(begin[axis] - number * chunk, max(begin[axis], min((number + 1) * chunk, n, last)) - number * chunk))
        part = values[tuple(cut)]
        # t and z are cut to one; what is left is put in the order c, y, x
        part = part.transpose([layout.axes.index(a) for a in "tzcyx" if a in layout.axes])
        part = part.reshape(-1, *part.shape[-2:])
        step = max(1, TOGETHER // max(1, part.shape[2]))
        for c, plane in enumerate(part, begin.get("c", 0)):
            if self.bounds.planes is not None and c not in self.bounds.planes:
                continue
            for top in range(0, len(plane), step):
                some = plane[top : top + step]
                y, x = np.indices(some.shape, np.int32)
                columns = [np.full(some.size, c, np.int32), y.ravel() + np.int32(begin["y"] + top), x.ravel() + np.int32(begin["x"]), some.ravel().astype(float)]
                yield pa.RecordBatch.from_arrays([pa.array([tissue]).dictionary_encode().cast(pa.string()).take(pa.array(np.zeros(some.size, np.int64))), *map(pa.array, columns)], ["tissue_id", "plane", "y", "x", "value"])


class StoreSource(DataSource):
    """Pixels (tissue_id, plane, y, x, value) of the <tissue>[.ome].zarr stores of a folder.

    Options: `rows` (`shapes` gives tissue_id, c, h, w instead), `level` (0), `axes` (letters of t, c,
    z, y, x, where stores neither name theirs nor have a usual order), `t` and `z` (0, the place along
    those axes), `tasks` (about so many, each with some stores or a slice of one's chunks). A missing chunk has the store's fill value, and
    no rows if it has none.
    """

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SHAPES if self.options.get("rows") == "shapes" else PIXELS

    def reader(self, schema) -> StoreReader:
        return StoreReader(self.options)


class FilesReader(DataSourceReader):
    def __init__(self, options):
        self.folder, self.ending = options["path"].rstrip("/"), options["ending"]
        self.names_only = options.get("rows", "files") == "names"
        self.tasks = int(options.get("tasks", TASKS))
        # a name holds no slash
        self.wanted = set(options["names"].split("/")) if "names" in options else None

    def partitions(self) -> list[InputPartition]:
        files, folder = opened(self.folder)
        found = files.get_file_info(fs.FileSelector(folder))
        names = sorted(f.base_name for f in found if f.type == fs.FileType.File and f.base_name.endswith(self.ending) and f.base_name[0] not in "._")
        if self.wanted is not None:
            names = [n for n in names if n in self.wanted]
        return [Stores(names[i :: self.tasks]) for i in range(min(len(names), self.tasks))] or [Stores([])]

    def read(self, partition: Stores) -> Iterator[pa.RecordBatch]:
        if self.names_only:
            yield pa.RecordBatch.from_arrays([pa.array(partition.names, pa.string())], ["name"])
            return
        files, folder = opened(self.folder)
        paths, held, size = [], [], 0
        for name in partition.names:
            data = content(files, f"{folder}/{name}")
            if data is None:
                raise FileNotFoundError(f"{folder}/{name} went while it was read")
            paths, held, size = [*paths, f"{self.folder}/{name}"], [*held, data], size + len(data)
            if size >= FILE_BYTES:
                yield self._batch(paths, held)
                paths, held, size = [], [], 0
        if held:
            yield self._batch(paths, held)

    def _batch(self, paths: list[str], held: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(held, pa.binary())], ["path", "content"])


class FilesSource(DataSource):
    """Rows (path, content) of a folder's files, many small ones to a task; what is below its folders isn't looked at.

    Options: `ending` of the names, `names` (those asked for, with slashes between them; else all), `rows`
    (`names` gives their names alone, without opening them), `tasks`.
    """

    @classmethod
    def name(cls) -> str:
        return FILES

    def schema(self) -> str:
        return "name string" if self.options.get("rows") == "names" else "path string, content binary"

    def reader(self, schema) -> FilesReader:
        return FilesReader(self.options)


def register(spark: SparkSession) -> None:
    """Let the session read stores by NAME, with filters pushed into them, and files by FILES."""
    ship_package(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(StoreSource)
    spark.dataSource.register(FilesSource)


def files(spark: SparkSession, folder: str, ending: str, names: list[str] | None = None, **options) -> DataFrame:
    """(path, content) of the files of a reachable folder, or their (name) with rows="names"."""
    register(spark)
    some = {} if names is None else {"names": "/".join(names)}
    tasks = str(4 * spark.sparkContext.defaultParallelism)
    return spark.read.format(FILES).options(ending=ending, tasks=tasks, **some, **options).load(folder)


def pixels(spark: SparkSession, folder: str, **options) -> DataFrame:
    register(spark)
    tasks = str(4 * spark.sparkContext.defaultParallelism)
    return spark.read.format(NAME).options(**{"tasks": tasks, **options}).load(folder)


def shapes(spark: SparkSession, folder: str) -> DataFrame:
    """(tissue_id, c, h, w) of the stores of a folder, from their metadata alone."""
    return pixels(spark, folder, rows="shapes")
