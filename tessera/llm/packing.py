"""Operator 5: token ids packed into rows of one length by best fit, longest first.

Texts longer than a row are split without loss. Within a batch of segments, a segment tree
over capacities keeps how many open rows have each amount of room left; the least room
that is enough is found by one descent. Packed rows carry their cumulative segment lengths
and positions that begin anew with each segment, and the ids as one matrix row.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import SparkFiles
from pyspark.sql import DataFrame

from tessera.llm.shared import prepare, ship_file

#: Token ids that are packed together; what a task holds is bounded by it.
BATCH_TOKENS = 1_000_000
PADDING = -1


class Room:
    """How many rows have each amount of room, 0 to capacity, under a tree of counts."""

    def __init__(self, capacity: int):
        self.width = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.width)

    def add(self, room: int, n: int) -> None:
        i = room + self.width
        while i:
            self.count[i] += n
            i >>= 1

    def least(self, need: int) -> int:
        """The least room of at least `need` that a row has, or -1."""
        i = need + self.width
        if self.count[i]:
            return need
        while i > 1:
            if i % 2 == 0 and self.count[i + 1]:
                i += 1
                while i < self.width:
                    i = 2 * i if self.count[2 * i] else 2 * i + 1
                return i - self.width
            i >>= 1
        return -1


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[list[int]]:
    """Rows of indices into sizes: each segment, longest first, into the fullest row it fits."""
    room, rows = Room(capacity), []
    by_room: dict[int, list[int]] = {}
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        left = room.least(sizes[i])
        if left < 0:
            rows.append([])
            row, left = len(rows) - 1, capacity
        else:
            row = by_room[left].pop()
            room.add(left, -1)
        rows[row].append(i)
        by_room.setdefault(left - sizes[i], []).append(row)
        room.add(left - sizes[i], 1)
    return rows


@functools.lru_cache(maxsize=2)
def _encoding(path: str, pattern: str) -> tiktoken.Encoding:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


SCHEMA = "ids array<int>, n_tokens int, cu_seqlens array<int>, positions array<int>, segments array<struct<doc_id:long,part:int>>"


def pack(docs: DataFrame, path: str, pattern: str, length: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packed rows: ids (padded with PADDING to `length`), n_tokens, cu_seqlens (0, ends of
    segments), positions (within segments, 0 in the padding) and segments (doc id and part
    number of each).

    Every token of every text is in one row, parts of a text in order of their numbers.
    Null and empty texts have no tokens and no segments; a null id stays null. Repeated
    rows are packed each time. Rows are packed in batches of BATCH_TOKENS within a task, so
    which segments share a row depends on how the input is dealt out, what is in them not.
    Other columns are not read; an empty table gives no rows.
    """
    prepare(docs.sparkSession)
    name = ship_file(docs.sparkSession, path)

    def segments(batches) -> Iterator[tuple[int | None, int, np.ndarray]]:
        encoding = _encoding(SparkFiles.get(name), pattern)
        for batch in batches:
            for doc, text in zip(batch.column("id").to_pylist(), batch.column("text"), strict=True):
                ids = np.array(encoding.encode_ordinary(text.as_py() or ""), np.int32)
                for part, at in enumerate(range(0, len(ids), length)):
                    yield doc, part, ids[at : at + length]

    def emit(some: list[tuple[int | None, int, np.ndarray]]) -> pa.RecordBatch:
        rows = best_fit_decreasing([len(s[2]) for s in some], length)
        ids = np.full((len(rows), length), PADDING, np.int32)
        positions = np.zeros((len(rows), length), np.int32)
        ends, members = [], []
        for r, row in enumerate(rows):
            at = 0
            ends.append([0])
            for i in row:
                size = len(some[i][2])
                ids[r, at : at + size] = some[i][2]
                positions[r, at : at + size] = np.arange(size)
                at += size
                ends[-1].append(at)
            members.append([{"doc_id": some[i][0], "part": some[i][1]} for i in row])
        steps = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * length)
        return pa.RecordBatch.from_arrays(
            [
                pa.ListArray.from_arrays(steps, pa.array(ids.ravel())),
                pa.array([e[-1] for e in ends], pa.int32()),
                pa.array(ends, pa.list_(pa.int32())),
                pa.ListArray.from_arrays(steps, pa.array(positions.ravel())),
                pa.array(members, pa.list_(pa.struct([("doc_id", pa.int64()), ("part", pa.int32())]))),
            ],
            ["ids", "n_tokens", "cu_seqlens", "positions", "segments"],
        )

    def run(batches):
        some, held = [], 0
        for segment in segments(batches):
            some.append(segment)
            held += len(segment[2])
            if held >= BATCH_TOKENS:
                yield emit(some)
                some, held = [], 0
        if some:
            yield emit(some)

    return docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text")).mapInArrow(run, SCHEMA)


def write_matrix(packed: DataFrame, path: str) -> None:
    """Parquet files of packed rows: the id matrix as little-endian 32-bit bytes beside the lists."""
    rest = packed.columns[1:]

    def run(batches):
        for batch in batches:
            data = [np.asarray(row.values, "<i4").tobytes() for row in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([pa.array(data, pa.binary()), *batch.columns[1:]], ["matrix_row", *rest])

    packed.mapInArrow(run, SCHEMA.replace("ids array<int>", "matrix_row binary")).write.parquet(path)
