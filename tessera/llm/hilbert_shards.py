"""Operator 7: shards cut from a Hilbert curve through quantised metadata.

Each metadata column is cut into 2**bits ranges of about equal size, which makes a row a
cell of a grid; the Hilbert index of the cell puts cells that are near in all columns near
in the order. Rows in that order are dealt in runs to shards whose counts are at most one
apart, so a shard's minimum and maximum of each column let readers skip it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.shared import Scratch, bounded_sample, bucket_of, aside, cut_points, prepare, values_at  # noqa: F401

BITS = 6
#: Rows of the sample that deals rows to tasks evenly; no result depends on it.
SAMPLE_ROWS = 20_000


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position on the Hilbert curve of each row of cells (n rows, one column a dimension).

    By Skilling's transform: undo the excess work of each bit level, Gray-decode, and
    interleave the bits of the dimensions.
    """
    x = cells.astype(np.int64).copy()
    n = x.shape[1]
    level = 1 << (bits - 1)
    while level > 1:
        mask = level - 1
        for i in range(n):
            high = (x[:, i] & level) != 0
            swap = np.where(high, 0, (x[:, 0] ^ x[:, i]) & mask)
            x[:, 0] ^= np.where(high, mask, swap)
            x[:, i] ^= swap
        level >>= 1
    for i in range(1, n):
        x[:, i] ^= x[:, i - 1]
    turn = np.zeros(len(x), np.int64)
    level = 1 << (bits - 1)
    while level > 1:
        turn ^= np.where(x[:, n - 1] & level, level - 1, 0)
        level >>= 1
    x ^= turn[:, None]
    out = np.zeros(len(x), np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = out << 1 | (x[:, i] >> b & 1)
    return out


def with_curve(df: DataFrame, dims: list[str], bits: int = BITS) -> DataFrame:
    """df with `curve`, the Hilbert index of its columns `dims`; nulls count as the lowest values.

    The columns' ranges are those of all rows.
    """
    ranges = 1 << bits
    cuts = [np.array(values_at(df, name, lambda total: [total * i // ranges for i in range(1, ranges)])) for name in dims]

    @F.pandas_udf("long")
    def curve(rows: pd.DataFrame) -> pd.Series:
        cells = np.zeros((len(rows), len(dims)), np.int64)
        for i, (name, c) in enumerate(zip(dims, cuts, strict=True)):
            there = rows[name].notna().to_numpy()
            if len(c):
                cells[there, i] = np.searchsorted(c, rows[name].to_numpy()[there].astype(c.dtype), "right")
        return pd.Series(hilbert_index(cells, bits))

    return df.withColumn("curve", curve(F.struct(*dims)))


def shard(df: DataFrame, dims: list[str], spread: list[str], shards: int = 8, bits: int = BITS, together: str | None = None) -> DataFrame:
    """df with curve, shard (0 to shards - 1) and slot (from 0, gapless in each shard).

    Rows of a cell are in order of the hashes of the columns `spread`, which should tell
    rows apart; equal values of the first of them are neighbours. Rows that are equal in
    the column `together` all take the first place on the curve that one of them has, so
    with that column first in `spread` they are neighbours wherever their metadata differ.
    Shards' counts are at most one apart, whatever the data: a cell or group that many rows
    share is cut where its shard is full. Nulls may be in any column; equal rows take
    neighbouring slots in either order; an empty table gives no rows. Columns of df named
    like these, or like the operator's working columns, come back with _input behind them.
    """
    prepare(df.sparkSession)
    names = ["curve", "shard", "slot", "bucket", "rank", "first_curve", "group", *(f"h{i}" for i in range(len(spread)))]
    used = [*dims, *spread, *([together] if together else [])]
    df, *used = aside(df, names, *used)
    dims, spread, together = used[: len(dims)], used[len(dims) : len(dims) + len(spread)], used[-1] if together else None
    hashes = [f"h{i}" for i in range(len(spread))]
    keyed = with_curve(df, dims, bits).withColumns({h: F.xxhash64(c) for h, c in zip(hashes, spread, strict=True)})
    if together is not None:
        firsts = keyed.groupBy(F.col(together).alias("group")).agg(F.min("curve").alias("first_curve"))
        keyed = keyed.join(firsts, keyed[together].eqNullSafe(firsts["group"])).withColumn("curve", F.col("first_curve")).drop("first_curve", "group")
        keyed = Scratch(df.sparkSession).keep(keyed, "keyed")
    order = ["curve", *hashes]
    parts = max(shards, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = keyed.withColumn("bucket", bucket_of(cut_points(keyed, order, parts, SAMPLE_ROWS), order))
    # Rows before each bucket: one number for each bucket.
    before, total = [], 0
    counts = {r["bucket"]: r["count"] for r in placed.groupBy("bucket").count().collect()}
    for b in range(max(counts, default=-1) + 1):
        before.append(total)
        total += counts.get(b, 0)
    starts = F.array(*[F.lit(n).cast("long") for n in before or [0]])
    rank = F.row_number().over(Window.partitionBy("bucket").orderBy(*order)) - 1 + F.get(starts, F.col("bucket"))
    small, larger = divmod(total, shards)
    edge = larger * (small + 1)  # rows in the shards that have one more
    ranked = placed.withColumn("rank", rank)
    in_larger = F.col("rank") < edge
    size = max(1, small)
    out = ranked.withColumns({
        "shard": F.when(in_larger, F.floor(F.col("rank") / (small + 1))).otherwise(larger + F.floor((F.col("rank") - edge) / size)).cast("int"),
        "slot": F.when(in_larger, F.col("rank") % (small + 1)).otherwise((F.col("rank") - edge) % size),
    })
    return out.drop("bucket", "rank", *hashes)


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder for each shard, its rows in slot order, so files keep narrow ranges of the columns."""
    sharded.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
