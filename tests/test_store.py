"""The data source of array stores: layouts, codecs, and which files it opens."""

from __future__ import annotations

import json
import struct
import uuid
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from tessera.operators import jobs
from tessera.plans import store_queries
from tessera.sources import arrays, layout, store


def blosc_frame(data: bytes, width: int, codec: str | None, shuffle: bool, block: int, split: bool = False) -> bytes:
    """A frame by the published format; codec None stores the bytes."""
    number = {None: 0, "lz4_raw": 1, "snappy": 2, "zlib": 3, "zstd": 4}[codec]
    flags = (1 if shuffle else 0) | (2 if codec is None else 0) | (0 if split else 16) | number << 5
    if codec is None:
        return struct.pack("<BBBBiii", 2, 1, flags, width, len(data), len(data), 16 + len(data)) + data
    body, starts = b"", []
    pack = (lambda b: zlib.compress(b)) if codec == "zlib" else (lambda b: pa.Codec(codec).compress(b, asbytes=True))
    n = -(-len(data) // block)
    for i in range(n):
        part = data[i * block : (i + 1) * block]
        if shuffle:
            whole = len(part) // width * width
            part = np.frombuffer(part[:whole], np.uint8).reshape(-1, width).T.tobytes() + part[whole:]
        starts.append(16 + 4 * n + len(body))
        each = len(part) // width if split and len(part) == block else len(part)
        for j in range(0, len(part), each):
            stream = part[j : j + each]
            packed = pack(stream)
            body += struct.pack("<i", min(len(packed), each)) + (packed if len(packed) < each else stream)
    return struct.pack("<BBBBiii", 2, 1, flags, width, len(data), block, 16 + 4 * n + len(body)) + struct.pack(f"<{n}i", *starts) + body


@pytest.mark.parametrize("codec", [None, "lz4_raw", "zstd", "zlib", "snappy"])
@pytest.mark.parametrize(("shuffle", "split"), [(False, False), (True, False), (True, True)])
@pytest.mark.parametrize("width", [1, 2, 4])
def test_blosc_frames(codec, shuffle, split, width):
    rng = np.random.default_rng(width)
    for data in (np.arange(3000, dtype=np.uint32).tobytes(), rng.bytes(5003), b"\0" * 4096):
        assert layout.decoded(blosc_frame(data, width, codec, shuffle, 2048, split), "blosc") == data


def test_bit_planes_of_a_blosc_block():
    values = np.arange(64, dtype="<u2") * 511
    bits = np.unpackbits(values.view(np.uint8).reshape(64, 2), axis=1, bitorder="little")
    planes = np.packbits(bits.T, axis=1, bitorder="little").tobytes()
    assert layout._unshuffled(planes + b"xyz", 2, True) == values.tobytes() + b"xyz"


def test_unknown_codecs_are_errors():
    with pytest.raises(NotImplementedError, match="no decoder"):
        layout.decoded(b"", "jpeg2k")
    with pytest.raises(NotImplementedError, match="compressor 0"):
        layout.blosc(struct.pack("<BBBBiii", 2, 1, 16, 1, 10, 10, 30))


def written(folder, image, axes, version, codec="zlib", chunk=4, name="0", describe=True, unreadable=()):
    """A store of image (c, y, x) with its axes in another order; chunk numbers of `unreadable` (c, y, x) hold noise."""
    place = {a: i for i, a in enumerate("cyx")}
    values = image.transpose([place[a] for a in axes if a in place])
    for i, a in enumerate(axes):
        if a not in place:
            values = np.expand_dims(values, i)
    shape, chunks = values.shape, [1 if a in "tcz" else chunk for a in axes]
    level = folder / name
    level.mkdir(parents=True)
    pack = {"zlib": zlib.compress, "blosc": lambda b: blosc_frame(b, image.itemsize, "zstd", True, 64), None: lambda b: b}[codec]
    scales = {"multiscales": [{"axes": [{"name": a} for a in axes], "datasets": [{"path": name}]}]} if describe else {}
    if version == 2:
        (folder / ".zattrs").write_text(json.dumps(scales))
        (level / ".zarray").write_text(json.dumps({"shape": shape, "chunks": chunks, "dtype": image.dtype.str, "compressor": codec and {"id": codec}, "fill_value": 0, "dimension_separator": "/"}))
    else:
        (folder / "zarr.json").write_text(json.dumps({"node_type": "group", "attributes": {"ome": scales}}))
        codecs = [{"name": "bytes", "configuration": {"endian": "little"}}, *([{"name": codec}] if codec else [])]
        grid = {"name": "regular", "configuration": {"chunk_shape": chunks}}
        (level / "zarr.json").write_text(json.dumps({"shape": shape, "chunk_grid": grid, "data_type": image.dtype.name, "codecs": codecs, "fill_value": 0, "chunk_key_encoding": {"name": "default"}}))
    for at in np.ndindex(*(-(-n // c) for n, c in zip(shape, chunks, strict=True))):
        part = np.zeros(chunks, image.dtype)
        cut = values[tuple(slice(a * c, (a + 1) * c) for a, c in zip(at, chunks, strict=True))]
        part[tuple(slice(0, n) for n in cut.shape)] = cut
        file = level / ("" if version == 2 else "c") / "/".join(map(str, at))
        file.parent.mkdir(parents=True, exist_ok=True)
        spot = tuple(at[axes.index(a)] if a in axes else 0 for a in "cyx")
        file.write_bytes(b"noise" if spot in unreadable else pack(part.tobytes()))


def pixels_of(df):
    rows = df.collect()
    assert len({(r.tissue_id, r.plane, r.y, r.x) for r in rows}) == len(rows)
    return {(r.plane, r.y, r.x): r.value for r in rows}


@pytest.mark.parametrize("version", [2, 3])
@pytest.mark.parametrize(("axes", "codec"), [("cyx", "blosc"), ("yxc", "zlib"), ("tczyx", None), ("zyxc", "blosc")])
def test_layouts_give_the_same_pixels(spark, tmp_path, version, axes, codec):
    image = np.arange(3 * 9 * 7, dtype="<i2").reshape(3, 9, 7)
    written(tmp_path / "t1.ome.zarr", image, axes, version, codec, name="full" if version == 3 else "0")
    want = {(c, y, x): float(image[c, y, x]) for c in range(3) for y in range(9) for x in range(7)}
    assert pixels_of(store.pixels(spark, str(tmp_path), tasks=3)) == want
    some = store.pixels(spark, f"file://{tmp_path}").where("tissue_id = 't1' and plane in (0, 2) and y > 2 and y <= 6 and x = 5")
    assert pixels_of(some) == {k: v for k, v in want.items() if k[0] != 1 and 2 < k[1] <= 6 and k[2] == 5}
    assert [tuple(r) for r in store.shapes(spark, str(tmp_path)).collect()] == [("t1", 3, 9, 7)]


def test_axes_are_guessed_or_given_where_no_store_names_them(spark, tmp_path):
    image = np.arange(3 * 9 * 7, dtype="<f4").reshape(3, 9, 7)
    written(tmp_path / "a.zarr", image, "yxc", 2, describe=False)
    assert pixels_of(store.pixels(spark, str(tmp_path))) == {(c, y, x): float(image[c, y, x]) for c in range(3) for y in range(9) for x in range(7)}
    assert [layout.guessed_axes(s) for s in ([5, 6], [3, 9, 7], [9, 7, 3], [4, 4, 4], [2, 1, 5, 6], [1, 2, 1, 5, 6])] == ["yx", "cyx", "yxc", "cyx", "czyx", "tczyx"]
    tall = np.arange(20 * 9 * 7, dtype="<f4").reshape(20, 9, 7)
    written(tmp_path / "more" / "c.zarr", tall, "cyx", 2, describe=False)  # more planes than rows: said by an option
    got = store.pixels(spark, str(tmp_path / "more"), axes="cyx").where("plane = 19 and y = 8").collect()
    assert sorted((r.x, r.value) for r in got) == [(x, float(tall[19, 8, x])) for x in range(7)]


def test_filters_leave_other_stores_and_chunks_closed(spark, tmp_path):
    image = np.arange(2 * 12 * 12, dtype="<f4").reshape(2, 12, 12)
    inside = {(c, y, x) for c in range(2) for y in range(3) for x in range(3)}
    written(tmp_path / "t1.ome.zarr", image, "cyx", 2, unreadable=inside - {(1, 0, 0), (1, 0, 1), (1, 0, 2)})
    written(tmp_path / "t2.zarr", image, "cyx", 2, unreadable=inside)
    (tmp_path / "t3.zarr").mkdir()  # not even metadata
    every = store.pixels(spark, str(tmp_path))
    some = every.where("tissue_id = 't1' and plane = 1 and y < 4")
    assert pixels_of(some) == {(1, y, x): float(image[1, y, x]) for y in range(4) for x in range(12)}
    with pytest.raises(Exception, match="(?i)zlib|incorrect|Error"):
        every.where("tissue_id = 't1' and plane = 1 and y < 5").collect()
    assert every.where("tissue_id = 't9'").collect() == []
    assert every.where("tissue_id = 't1' and y > 100").collect() == []
    assert store.pixels(spark, str(tmp_path / "nowhere")).collect() == []


def test_many_stores_share_tasks_and_few_are_sliced(tmp_path):
    for i in range(30):
        (tmp_path / f"t{i}.zarr").mkdir()
    (tmp_path / "notes").mkdir()
    few = store.StoreReader({"path": str(tmp_path), "tasks": "60"}).partitions()
    assert sorted((p.names[0], p.slice, p.slices) for p in few) == sorted((f"t{i}.zarr", k, 2) for i in range(30) for k in range(2))
    many = store.StoreReader({"path": str(tmp_path), "tasks": "4"}).partitions()
    assert sorted(n for p in many for n in p.names) == sorted(f"t{i}.zarr" for i in range(30))
    assert (len(many), {p.slices for p in many}) == (4, {1})


def test_missing_chunks_and_nothing_to_fill_them(spark, tmp_path):
    image = np.ones((1, 8, 8), "<f4")
    written(tmp_path / "t1.zarr", image, "cyx", 2)
    (tmp_path / "t1.zarr/0/0/1/1").unlink()
    assert sum(pixels_of(store.pixels(spark, str(tmp_path))).values()) == 48
    meta = json.loads((tmp_path / "t1.zarr/0/.zarray").read_text())
    (tmp_path / "t1.zarr/0/.zarray").write_text(json.dumps({**meta, "fill_value": None}))
    assert len(pixels_of(store.pixels(spark, str(tmp_path)))) == 48


@pytest.fixture(scope="module")
def uneven(spark, tmp_path_factory):
    """Embeddings that leave images without their last planes, and one without the first: 0 to 33 but for 21, 23 and 24."""
    folder = tmp_path_factory.mktemp("uneven")
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").where("vec_id < 34 and vec_id not in (21, 23, 24)")
    rows.write.parquet(f"{folder}/embeddings.parquet")
    return str(folder)


@pytest.mark.parametrize("name", sorted(store_queries.ORACLES))
def test_images_keep_planes_without_a_pixel(spark, uneven, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{uneven}/embeddings.parquet/*.parquet'")
    for other in ("events", "lineitem", "orders", "part"):
        con.execute(f"CREATE VIEW {other} AS SELECT * FROM '/root/testdata/sf0.001/{other}.parquet'")
    df = store_queries.QUERIES[name](spark, uneven)
    columns = ", ".join(f'"{c}"' for c in df.columns)
    want = con.execute(f"SELECT {columns} FROM ({store_queries.ORACLES[name]})").fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(want)


def test_files_are_dealt_to_tasks(spark, tmp_path):
    for name, data in (("a.npz", b"1"), ("b.npz", b"22"), ("c.txt", b"3"), (".d.npz", b"4")):
        (tmp_path / name).write_bytes(data)
    (tmp_path / "e.npz").mkdir()
    got = store.files(spark, str(tmp_path), ".npz").collect()
    assert sorted((r.path.rsplit("/", 1)[1], bytes(r.content)) for r in got) == [("a.npz", b"1"), ("b.npz", b"22")]
    assert [r.path for r in store.files(spark, f"file://{tmp_path}", ".npz", ["b.npz", "z.npz"]).collect()] == [f"file://{tmp_path}/b.npz"]
    # names come without opening the files, which hold no masks here
    assert sorted(r.tissue_id for r in arrays.mask_names(spark, str(tmp_path)).collect()) == ["a", "b"]
    batches = [pa.RecordBatch.from_pydict({"n": [i] * 3}) for i in range(5)]
    assert [b.num_rows for b in store.joined(iter(batches), 6)] == [6, 6, 3]


def test_statistics_scan_the_pixels_twice(spark, tmp_path):
    """Quantiles, then moments; the files are written from what they found."""
    seen = tmp_path / "seen"
    seen.mkdir()

    def watched(batches):
        (seen / uuid.uuid4().hex).touch()
        yield from batches

    rows = [("t", "A", float(v)) for v in range(20)]
    pixels = spark.createDataFrame(rows, "tissue_id string, channel string, value double").coalesce(1).mapInArrow(watched, "tissue_id string, channel string, value double")
    assert len(jobs.compute_statistics(pixels, str(tmp_path / "made"), ["A"], 0.9, 0.1)) == 4
    assert len(list(seen.iterdir())) == 2
