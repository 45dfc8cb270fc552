"""How array stores are laid out: metadata of Zarr v2 and v3, axes, chunk names, codecs."""

from __future__ import annotations

import gzip
import itertools
import json
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard

#: Compressors of a blosc frame, by the number in its flags (fixed values); blosclz has no decoder here.
BLOSC = {1: "lz4_raw", 2: "snappy", 3: "zlib", 4: "zstd"}
#: Streams of a block are split by byte only from so many elements on, and up to this element size (fixed values).
BLOSC_LEAST, BLOSC_WIDEST = 128, 16


def _plain(codec: str, data: bytes, size: int) -> bytes:
    return zlib.decompress(data) if codec == "zlib" else pa.Codec(codec).decompress(data, size, asbytes=True)


def _unshuffled(block: bytes, width: int, by_bit: bool) -> bytes:
    """The bytes of a block in order, from byte planes or bit planes; what doesn't fill an element stays."""
    values = np.frombuffer(block, np.uint8)
    n = len(values) // width
    n -= n % 8 if by_bit else 0
    whole = values[: n * width]
    if by_bit:
        bits = np.unpackbits(whole.reshape(width * 8, -1), axis=1, bitorder="little")
        whole = np.packbits(bits.T.reshape(n, width, 8), axis=2, bitorder="little")
    else:
        whole = whole.reshape(width, n).T
    return whole.tobytes() + values[n * width :].tobytes()


def blosc(frame: bytes) -> bytes:
    """The content of a blosc frame (format 2)."""
    flags, width = frame[2], frame[3]
    size, block, _ = struct.unpack_from("<iii", frame, 4)
    if flags & 2:  # stored as it is
        return frame[16 : 16 + size]
    codec = BLOSC.get(flags >> 5)
    if codec is None:
        raise NotImplementedError(f"no decoder for compressor {flags >> 5} of blosc")
    starts = struct.unpack_from(f"<{-(-size // block)}i", frame, 16)
    out = []
    for i, at in enumerate(starts):
        length = min(block, size - i * block)
        split = not flags & 16 and width <= BLOSC_WIDEST and block // width >= BLOSC_LEAST and length == block
        parts = []
        for _ in range(width if split else 1):
            each = length // width if split else length
            (packed,) = struct.unpack_from("<i", frame, at)
            data = frame[at + 4 : at + 4 + packed]
            parts.append(data if packed == each else _plain(codec, data, each))
            at += 4 + packed
        whole = b"".join(parts)
        out.append(_unshuffled(whole, width, bool(flags & 4)) if flags & 5 and width > 1 else whole)
    return b"".join(out)


#: Decoders of bytes by the codec's name; register more here.
CODECS: dict[str, Callable[[bytes], bytes]] = {
    "zlib": zlib.decompress,
    "gzip": gzip.decompress,
    "zstd": lambda data: zstandard.ZstdDecompressor().decompressobj().decompress(data),
    "lz4": lambda data: pa.Codec("lz4_raw").decompress(data[4:], struct.unpack_from("<i", data)[0], asbytes=True),
    "blosc": blosc,
    "crc32c": lambda data: data[:-4],
}


def decoded(data: bytes, codec: str | None) -> bytes:
    if not codec:
        return data
    if codec not in CODECS:
        raise NotImplementedError(f"no decoder for codec {codec!r}")
    return CODECS[codec](data)


def guessed_axes(shape: list[int]) -> str:
    """Axes of an array whose store doesn't name them.

    Two are y and x. Of three, the first is c if none is shorter, else the last. More than three are t, c, z, y, x from the end.
    """
    if len(shape) == 3:
        return "cyx" if shape[0] <= min(shape[1:]) else "yxc"
    if not 2 <= len(shape) <= 5:
        raise ValueError(f"no layout for {len(shape)} axes")
    return {2: "yx", 4: "czyx", 5: "tczyx"}[len(shape)]


@dataclass(frozen=True)
class Layout:
    """One array: its shape and chunks by `axes` (letters of t, c, z, y, x), and how a chunk's bytes are read."""

    shape: tuple[int, ...]
    chunks: tuple[int, ...]
    axes: str
    dtype: str
    order: tuple[int, ...]
    fill: float | None
    prefix: str
    separator: str
    codecs: tuple[str, ...]

    def size(self, axis: str) -> int:
        return self.shape[self.axes.index(axis)] if axis in self.axes else 1

    @property
    def chw(self) -> tuple[int, int, int]:
        return self.size("c"), self.size("y"), self.size("x")

    def wanted(self, ranges: dict[str, tuple[int, int]], planes: set[int] | None = None) -> Iterator[tuple[int, ...]]:
        """Numbers of the chunks that hold some of the ranges [first, last) of axes (whole ones if absent) and planes."""
        numbers = []
        for axis, n, chunk in zip(self.axes, self.shape, self.chunks, strict=True):
            first, last = ranges.get(axis, (0, n))
            some = range(max(0, first) // chunk, -(-max(0, min(n, last)) // chunk))
            if axis == "c" and planes is not None:
                some = sorted({p // chunk for p in planes if 0 <= p < n and first <= p < last})
            numbers.append(some)
        return itertools.product(*numbers)

    def name(self, at: tuple[int, ...]) -> str:
        return self.prefix + self.separator.join(map(str, at))

    def values(self, data: bytes | None) -> np.ndarray | None:
        """A chunk's values by `axes`, the fill value where there is no chunk, None where there is neither."""
        if data is None:
            return None if self.fill is None else np.full(self.chunks, self.fill)
        for codec in self.codecs:
            data = decoded(data, codec)
        stored = [self.chunks[i] for i in self.order]
        return np.frombuffer(data, self.dtype).reshape(stored).transpose(np.argsort(self.order))


def _number(fill) -> float | None:
    return None if fill is None else float({"Infinity": "inf", "-Infinity": "-inf"}.get(fill, fill))


def layout_v2(text: str, axes: str | None = None) -> Layout:
    """From the text of a .zarray file."""
    meta = json.loads(text)
    if meta.get("filters"):
        raise NotImplementedError(f"no decoder for filters {meta['filters']}")
    shape, n = tuple(meta["shape"]), len(meta["shape"])
    order = tuple(range(n))[:: -1 if meta.get("order") == "F" else 1]
    compressor = (meta.get("compressor") or {}).get("id")
    return Layout(
        shape, tuple(meta["chunks"]), axes or guessed_axes(shape), meta["dtype"], order, _number(meta.get("fill_value")), "", meta.get("dimension_separator", "."),
        (compressor,) if compressor else (),
    )


def layout_v3(text: str, axes: str | None = None) -> Layout:
    """From the text of an array's zarr.json."""
    meta = json.loads(text)
    shape = tuple(meta["shape"])
    order, endian, codecs = tuple(range(len(shape))), "<", []
    for codec in meta["codecs"]:
        more = codec.get("configuration", {})
        if codec["name"] == "transpose":
            order = tuple(order[i] for i in more["order"])
        elif codec["name"] == "bytes":
            endian = ">" if more.get("endian") == "big" else "<"
        else:
            codecs.insert(0, codec["name"])
    key = meta.get("chunk_key_encoding", {"name": "default"})
    kind = np.dtype(meta["data_type"]).newbyteorder(endian).str
    separator = key.get("configuration", {}).get("separator", "/" if key["name"] == "default" else ".")
    names = meta.get("dimension_names")
    if axes is None and names and all(names):
        axes = "".join(n[0].lower() for n in names)
    return Layout(
        shape, tuple(meta["chunk_grid"]["configuration"]["chunk_shape"]), axes or guessed_axes(shape), kind, order, _number(meta.get("fill_value")),
        f"c{separator}" if key["name"] == "default" else "", separator, tuple(codecs),
    )


def scales(attributes: dict) -> tuple[list[str], str | None]:
    """Paths of the levels, and the axes, that a group's attributes describe; ([], None) without such a description."""
    many = (attributes.get("ome") or attributes).get("multiscales") or [{}]
    axes = [a["name"] if isinstance(a, dict) else a for a in many[0].get("axes", [])]
    return [d["path"] for d in many[0].get("datasets", [])], "".join(a[0].lower() for a in axes) or None


def read_layout(read: Callable[[str], bytes | None], level: int = 0, axes: str | None = None) -> tuple[str, Layout]:
    """(path of the level, its layout) of a store; read(path in it) gives a file's bytes, or None without one."""
    group = read("zarr.json")
    attributes = json.loads(group).get("attributes", {}) if group else json.loads(read(".zattrs") or b"{}")
    paths, known = scales(attributes)
    path = paths[level] if level < len(paths) else str(level)
    for name, layout in (("zarr.json", layout_v3), (".zarray", layout_v2)):
        text = read(f"{path}/{name}")
        if text is not None:
            return path, layout(text.decode(), axes or known)
    raise FileNotFoundError(f"no array {path}")
