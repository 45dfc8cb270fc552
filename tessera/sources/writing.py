"""Images and masks written by tasks: a file for each chunk or mask, in the layout that the readers know."""

from __future__ import annotations

import io
import json
import uuid

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import ship_package
from tessera.sources.store import opened


def put(files: fs.FileSystem, path: str, data: bytes) -> None:
    """Write a file as a whole: a task that is run again puts the same one in its place."""
    folder, name = path.rsplit("/", 1)
    files.create_dir(folder, recursive=True)
    made = f"{folder}/.{name}.{uuid.uuid4().hex}"
    with files.open_output_stream(made, compression=None) as out:
        out.write(data)
    files.move(made, path)


def write_images(pixels: DataFrame, folder: str, chunk: int = 512, dtype: str = "<f4", extents: DataFrame | None = None) -> None:
    """Write pixels(tissue_id, plane, y, x, value), each once and from 0 on, as Zarr v2 stores <tissue>.ome.zarr, level 0.

    extents(tissue_id, c, h, w) are the images' shapes, which else end at their last pixels: only they
    tell of last planes without a pixel, and of images without any. A chunk is one plane's square of
    `chunk` pixels, compressed with zstd; it is filled up with 0, and chunks without a pixel have no
    file. A row holds a chunk's pixels, never an image's.
    """
    ship_package(pixels.sparkSession)

    def store_of(tissue) -> str:
        return f"{opened(folder)[1]}/{tissue}.ome.zarr/0"

    def chunks(batches):
        files, _ = opened(folder)
        for batch in batches:
            for tissue, plane, cy, cx, held in zip(*(batch.column(i) for i in range(5)), strict=True):
                part = np.zeros((chunk, chunk), dtype)
                y, x, values = (held.values.field(k).to_numpy(zero_copy_only=False) for k in range(3))
                part[y % chunk, x % chunk] = values
                packed = pa.Codec("zstd").compress(part.tobytes(), asbytes=True)
                put(files, f"{store_of(tissue.as_py())}/{plane.as_py()}.{cy.as_py()}.{cx.as_py()}", packed)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    def metadata(batches):
        files, _ = opened(folder)
        for batch in batches:
            for tissue, *shape in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                meta = {"zarr_format": 2, "shape": shape, "chunks": [1, chunk, chunk], "dtype": dtype, "order": "C", "compressor": {"id": "zstd"}, "filters": None, "fill_value": 0}
                put(files, f"{store_of(tissue)}/.zarray", json.dumps(meta).encode())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    dealt = pixels.select("tissue_id", "plane", F.floor(F.col("y") / chunk).alias("cy"), F.floor(F.col("x") / chunk).alias("cx"), F.struct("y", "x", "value").alias("p"))
    dealt.groupBy("tissue_id", "plane", "cy", "cx").agg(F.collect_list("p").alias("held")).mapInArrow(chunks, "n long").agg(F.sum("n")).collect()
    if extents is None:
        extents = pixels.groupBy("tissue_id").agg(*[(F.max(c) + 1).cast("int").alias(n) for c, n in (("plane", "c"), ("y", "h"), ("x", "w"))])
    sizes = extents.select("tissue_id", "c", "h", "w")
    sizes.mapInArrow(metadata, "n long").agg(F.sum("n")).collect()


def write_masks(runs: DataFrame, extents: DataFrame, folder: str) -> None:
    """Write the masks of runs(tissue_id, y, x0, x1) as <tissue>.npz, one for each tissue of extents(tissue_id, h, w).

    A mask is one file and so one task's work; its row holds runs, not pixels.
    """
    ship_package(runs.sparkSession)

    def save(batches):
        files, place = opened(folder)
        for batch in batches:
            for tissue, h, w, held in zip(*(batch.column(i) for i in range(4)), strict=True):
                edges = np.zeros((h.as_py(), w.as_py() + 1), np.int8)
                for y, x0, x1 in zip(*(held.values.field(k).to_numpy() for k in range(3)), strict=True):
                    edges[y, x0], edges[y, x1] = edges[y, x0] + 1, edges[y, x1] - 1
                out = io.BytesIO()
                np.savez_compressed(out, mask=edges.cumsum(axis=1, dtype=np.int8)[:, :-1].astype(np.uint8))
                put(files, f"{place}/{tissue.as_py()}.npz", out.getvalue())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    each = runs.groupBy("tissue_id").agg(F.collect_list(F.struct("y", "x0", "x1")).alias("held"))
    empty = F.array().cast("array<struct<y: int, x0: int, x1: int>>")
    rows = extents.select("tissue_id", "h", "w").join(each, "tissue_id", "left").select("tissue_id", "h", "w", F.coalesce("held", empty).alias("held"))
    rows.mapInArrow(save, "n long").agg(F.sum("n")).collect()
