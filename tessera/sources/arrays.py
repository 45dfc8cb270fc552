"""Image planes and masks from array stores: .npz files and Zarr v2 groups.

A file or a chunk is a row that Spark deals out; numpy only decodes it. What is asked for
(stores, planes, a window) becomes a pattern of chunk names, so other chunks are neither
listed for reading nor opened.
"""

from __future__ import annotations

import functools
import io
import zipfile
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import ship_package
from tessera.sources import catalog, store
from tessera.sources.layout import decoded

#: Metadata files that are read at once.
READERS = 16
#: Pixels in one batch of rows.
TOGETHER = 1 << 20


def mask_files(spark: SparkSession, folder: str, tissues: list[str] | None = None) -> DataFrame:
    """(path, content) of the <tissue>.npz files of a folder, or of those of some tissues only.

    Tasks open them by themselves where they reach the folder, else Spark lists the files.
    """
    ship_package(spark)
    if store.reachable(folder):
        return store.files(spark, folder, ".npz", None if tissues is None else [f"{t}.npz" for t in tissues])
    reader = spark.read.format("binaryFile").option("pathGlobFilter", "*.npz")
    if tissues is None:
        return reader.load(folder).select("path", "content")
    wanted = {f"{t}.npz" for t in tissues}
    paths = [f"{folder}/{n}" for n, is_folder in catalog.children(spark, folder) if n in wanted and not is_folder]
    return (reader.load(paths) if paths else reader.load(folder).where("false")).select("path", "content")


def mask_names(spark: SparkSession, folder: str, tissues: list[str] | None = None) -> DataFrame:
    """(tissue_id) of the mask files, which aren't opened."""
    if store.reachable(folder):
        names = store.files(spark, folder, ".npz", None if tissues is None else [f"{t}.npz" for t in tissues], rows="names")
    else:
        names = mask_files(spark, folder, tissues).select(F.substring_index("path", "/", -1).alias("name"))
    return names.select(F.expr("left(name, length(name) - 4)").alias("tissue_id"))


def mask_shape(data: bytes) -> tuple[int, ...]:
    """The shape of an .npz file's array `mask`, from its header."""
    with zipfile.ZipFile(io.BytesIO(data)) as parts, parts.open("mask.npy") as array:
        read = np.lib.format.read_array_header_1_0 if np.lib.format.read_magic(array) == (1, 0) else np.lib.format.read_array_header_2_0
        return read(array)[0]


def decoded_mask(path: str, data: bytes) -> tuple[str, np.ndarray]:
    """(tissue, array `mask`) of an .npz file."""
    return path.rsplit("/", 1)[1].removesuffix(".npz"), np.load(io.BytesIO(data))["mask"]


def masks(spark: SparkSession, folder: str, labels: bool = False) -> DataFrame:
    """(tissue_id, y, x[, label]) of the non-zero pixels of <tissue>.npz files, array `mask`."""

    def run(batches):
        for batch in batches:
            for path, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                tissue, mask = decoded_mask(path, data)
                step = max(1, TOGETHER // max(1, mask.shape[1]))
                for top in range(0, len(mask), step):
                    y, x = np.nonzero(mask[top : top + step])
                    columns = [pa.array([tissue] * len(y), pa.string()), pa.array((y + top).astype(np.int32)), pa.array(x.astype(np.int32))]
                    if labels:
                        columns.append(pa.array(mask[y + top, x].astype(np.int32)))
                    yield pa.RecordBatch.from_arrays(columns, ["tissue_id", "y", "x", "label"][: len(columns)])

    return mask_files(spark, folder).mapInArrow(lambda batches: store.joined(run(batches), store.ENOUGH), "tissue_id string, y int, x int" + (", label int" if labels else ""))


def mask_runs(spark: SparkSession, folder: str, tissues: list[str] | None = None) -> DataFrame:
    """(tissue_id, y, x0, x1): the runs of non-zero pixels of <tissue>.npz files, found where a file is read."""

    def run(batches):
        for batch in batches:
            for path, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                tissue, mask = decoded_mask(path, data)
                step = max(1, TOGETHER // max(1, mask.shape[1]))
                for top in range(0, len(mask), step):
                    inside = np.pad(mask[top : top + step] != 0, ((0, 0), (1, 1)))
                    y, edges = np.nonzero(inside[:, 1:] != inside[:, :-1])
                    y, x0, x1 = (y[::2] + top).astype(np.int32), edges[::2].astype(np.int32), edges[1::2].astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array([tissue] * len(y), pa.string()), *map(pa.array, (y, x0, x1))], ["tissue_id", "y", "x0", "x1"])

    return mask_files(spark, folder, tissues).mapInArrow(lambda batches: store.joined(run(batches), store.ENOUGH), "tissue_id string, y int, x0 int, x1 int")


def runs_or_full(found: DataFrame, known: DataFrame, sizes: DataFrame) -> DataFrame:
    """Runs, and whole rows (h, w of sizes) for tissues without a mask file, which known(tissue_id) don't name."""
    missing = sizes.join(known.select("tissue_id"), "tissue_id", "left_anti").where("h > 0 and w > 0")
    full = missing.select("tissue_id", F.explode(F.sequence(F.lit(0), F.col("h") - 1)).alias("y"), F.lit(0).alias("x0"), F.col("w").alias("x1"))
    return found.unionByName(full)


def mask_sizes(spark: SparkSession, folder: str, tissues: list[str] | None = None) -> DataFrame:
    """(tissue_id, h, w) of every mask file, empty masks too."""

    def run(batches):
        for batch in batches:
            names = [p.rsplit("/", 1)[1].removesuffix(".npz") for p in batch.column("path").to_pylist()]
            shapes = [mask_shape(d) for d in batch.column("content").to_pylist()]
            made = [pa.array(names, pa.string()), *(pa.array([s[i] for s in shapes], pa.int32()) for i in (0, 1))]
            yield pa.RecordBatch.from_arrays(made, ["tissue_id", "h", "w"])

    return mask_files(spark, folder, tissues).mapInArrow(run, "tissue_id string, h int, w int")


def masks_or_full(found: DataFrame, known: DataFrame, sizes: DataFrame) -> DataFrame:
    """Masks, and the whole image (h, w of sizes) for tissues without a mask file.

    known(tissue_id) names the tissues with a file: an empty mask is one without pixels.
    """
    missing = sizes.join(known.select("tissue_id"), "tissue_id", "left_anti")
    full = missing.select("tissue_id", F.explode(F.sequence(F.lit(0), F.col("h") - 1)).alias("y"), "w")
    full = full.select("tissue_id", "y", F.explode(F.sequence(F.lit(0), F.col("w") - 1)).alias("x"))
    return found.select("tissue_id", "y", "x").unionByName(full)


def named_labels(labelled: DataFrame, encoder: DataFrame) -> DataFrame:
    """Labelled pixels with the names of encoder(id, name)."""
    names = encoder.select(F.col("id").alias("label"), "name")
    return labelled.join(F.broadcast(names) if _few(names) else names, "label")


def _few(df: DataFrame, rows: int = 100_000) -> bool:
    return df.limit(rows + 1).count() <= rows


META = "shape array<int>, chunks array<int>, dtype string, order string, fill_value string, dimension_separator string, compressor struct<id:string>"


def zarr_shapes(spark: SparkSession, folder: str, stores: list[str] | None = None) -> DataFrame:
    """(store, file, shape, chunks, dtype, order, fill, separator, codec) of level 0 of the Zarr stores.

    Only their metadata is read, of the stores asked for or of all of the folder. Those
    files are hidden ones, which Spark's listings leave out, so tasks get their text.
    """
    names = [n for n, is_folder in catalog.children(spark, folder) if is_folder and n.endswith(".zarr")]
    wanted = {n: n.removesuffix(".zarr").removesuffix(".ome") for n in names}
    if stores is not None:
        wanted = {n: held for n, held in wanted.items() if held in stores}
    with ThreadPoolExecutor(READERS) as pool:
        texts = list(pool.map(lambda n: catalog.text_of(spark, f"{folder}/{n}/0/.zarray"), wanted))
    rows = spark.createDataFrame(list(zip(wanted.values(), wanted, texts, strict=True)), "store string, file string, text string")
    parsed = rows.select("store", "file", F.from_json("text", META).alias("m"))
    return parsed.select(
        "store", "file", "m.shape", "m.chunks", "m.dtype", F.coalesce("m.order", F.lit("C")).alias("order"), F.col("m.fill_value").alias("fill"),
        F.coalesce("m.dimension_separator", F.lit(".")).alias("separator"), F.col("m.compressor.id").alias("codec"),
    )


def chunk_numbers(n: int, chunk: int, first: int = 0, size: int | None = None) -> list[int]:
    """Numbers along one axis of the chunks that hold [first, first + size) of n."""
    last = n if size is None else min(n, first + size)
    return list(range(max(0, first) // chunk, -(-max(0, last) // chunk)))


def _chunk_names(meta, planes: list[int] | None, window: tuple[int, int, int, int] | None) -> list[list[int]]:
    """For each axis the numbers of the chunks asked for, of one store's metadata."""
    (c, h, w), (pc, ph, pw) = meta["shape"], meta["chunks"]
    wanted = chunk_numbers(c, pc) if planes is None else sorted({p // pc for p in planes if 0 <= p < c})
    y, x, rows, cols = window or (0, 0, h, w)
    return [wanted, chunk_numbers(h, ph, y, rows + min(0, y)), chunk_numbers(w, pw, x, cols + min(0, x))]


def _listed(spark: SparkSession, paths: list[str]) -> DataFrame | None:
    """Files of the paths and patterns; None if there is none. A pattern without a file is no error."""
    try:
        return spark.read.format("binaryFile").load(paths)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
    some = [found for p in paths if len(paths) > 1 and (found := _listed(spark, [p])) is not None]
    return functools.reduce(DataFrame.union, some) if some else None


def zarr_chunks(spark: SparkSession, folder: str, planes: list[int] | None = None, window: tuple[int, int, int, int] | None = None, stores: list[str] | None = None) -> DataFrame:
    """Chunks asked for, with their store's metadata, place `at` and content; NULL content where the store has no file."""
    shapes = zarr_shapes(spark, folder, stores)
    metas = shapes.collect()  # one row a store, as listings have it
    kind = "store string, at array<int>"
    place = F.regexp_extract("path", r"[.]zarr/0/([0-9./]+)$", 1)
    at = F.transform(F.split(place, "[./]"), lambda p: p.cast("int"))
    named = (F.regexp_extract("path", r"([^/]+?)(?:[.]ome)?[.]zarr/0/", 1).alias("store"), at.alias("at"))
    patterns: dict[str, list[str]] = {}
    for m in metas:
        axes = _chunk_names(m, planes, window)
        if all(axes):
            whole = planes is None and window is None
            name = m["separator"].join("*" if whole else "{" + ",".join(map(str, axis)) + "}" for axis in axes)
            patterns.setdefault(f"0/{name}", []).append(m["file"])
    if not patterns:
        return shapes.join(spark.createDataFrame([], kind + ", content binary"), "store")
    everything = stores is None and len(patterns) == 1
    paths = [f"{folder}/*.zarr/{p}" if everything else f"{folder}/{f}/{p}" for p, files in patterns.items() for f in (["*"] if everything else files)]
    found = _listed(spark, paths)
    wanted = shapes.withColumn("at", F.explode(_places(planes, window)))
    if found is None:
        return wanted.withColumn("content", F.lit(None).cast("binary"))
    there = found.select(*named, "content").where("size(at) = 3")
    absent = wanted.join(found.select(*named), ["store", "at"], "left_anti").withColumn("content", F.lit(None).cast("binary"))
    inside = F.lit(True)
    if planes is not None:
        inside = F.array_contains(_planes_of(planes), F.col("at")[0])
    for axis, (first, size) in enumerate(zip(window[:2], window[2:], strict=True) if window else (), 1):
        begin = F.col("at")[axis] * F.col("chunks")[axis]
        inside = inside & (begin < first + size) & (begin + F.col("chunks")[axis] > first)
    return there.join(shapes, "store").where(inside).unionByName(absent)


def _planes_of(planes: list[int]):
    """Array of the numbers along the first axis of the chunks with some of the planes."""
    asked = F.filter(F.array(*[F.lit(p) for p in planes]).cast("array<int>"), lambda p: (p >= 0) & (p < F.col("shape")[0]))
    return F.array_distinct(F.transform(asked, lambda p: F.floor(p / F.col("chunks")[0]).cast("int")))


def _places(planes: list[int] | None, window: tuple[int, int, int, int] | None):
    """Array of the (c, y, x) numbers of a store's chunks that are asked for."""
    shape, chunks = F.col("shape"), F.col("chunks")

    def along(i: int, first: int | None, size: int | None):
        last = shape[i] if first is None else F.least(shape[i], F.lit(first + size))
        low = F.lit(0) if first is None else F.floor(F.lit(max(0, first)) / chunks[i]).cast("int")
        high = (F.ceil(last / chunks[i]) - 1).cast("int")
        return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))

    depth = along(0, None, None)
    if planes is not None:
        depth = _planes_of(planes)
    y, x, h, w = window or (None, None, None, None)
    rows, cols = along(1, y, h), along(2, x, w)
    each = F.transform(depth, lambda c: F.flatten(F.transform(rows, lambda r: F.transform(cols, lambda k: F.array(c, r, k)))))
    return F.flatten(each)


def zarr_pixels(spark: SparkSession, folder: str, planes: list[int] | None = None, window: tuple[int, int, int, int] | None = None, stores: list[str] | None = None) -> DataFrame:
    """(store, plane, y, x, value) of (C, H, W) arrays; stores, planes and window (y, x, h, w) prune chunks.

    Chunks outside of what is asked for are not opened. A missing chunk has the store's
    fill value, and no rows if it has none.
    """
    ship_package(spark)
    chunks = zarr_chunks(spark, folder, planes, window, stores).where("content is not null or fill is not null")

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                size, kind = tuple(r["chunks"]), np.dtype(r["dtype"])
                if r["content"] is None:
                    values = np.full(size, float(r["fill"]))
                else:
                    values = np.frombuffer(decoded(r["content"], r["codec"]), kind).reshape(size, order=r["order"])
                begin = [a * n for a, n in zip(r["at"], size, strict=True)]
                low, high = list(begin), [min(b + n, s) for b, n, s in zip(begin, size, r["shape"], strict=True)]
                if window is not None:
                    for axis, (first, n) in enumerate(((window[0], window[2]), (window[1], window[3])), 1):
                        low[axis], high[axis] = max(low[axis], first), min(high[axis], first + n)
                for c in range(low[0], high[0]):
                    if planes is not None and c not in planes:
                        continue
                    part = values[c - begin[0], low[1] - begin[1] : high[1] - begin[1], low[2] - begin[2] : high[2] - begin[2]]
                    y, x = np.indices(part.shape, np.int32)
                    columns = [pa.array([r["store"]] * part.size, pa.string()), pa.array(np.full(part.size, c, np.int32)), pa.array(y.ravel() + np.int32(low[1])), pa.array(x.ravel() + np.int32(low[2])), pa.array(part.ravel().astype(float))]
                    yield pa.RecordBatch.from_arrays(columns, ["store", "plane", "y", "x", "value"])

    rows = chunks.select("store", "content", "at", "shape", "chunks", "dtype", "order", "fill", "codec")
    return rows.mapInArrow(run, "store string, plane int, y int, x int, value double")
