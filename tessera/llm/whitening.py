"""Whitening of vectors by shifted CholeskyQR.

With X the centred distinct vectors as rows, each pass forms the Gram matrix of Q = X R^-1 over all
partitions, factors it, and multiplies the factor into R: after the first, shifted pass Q is well
conditioned, after two more its columns are orthonormal to rounding. Then X = Q R, and the singular
values and right vectors of the small R are those of X. Only matrices of dimension x dimension and
sums travel; rows stay where they are.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import Scratch, aside, prepare

#: Gram passes: one shifted, two that make the columns orthonormal.
PASSES = 3
#: Rows that a task has in one matrix.
ROWS = 4096
#: Components whose singular value is below this share of the largest have no variance.
NO_VARIANCE = 1e-12
#: Entries beyond this would not be exact as a double.
LARGEST = 1 << 52


def quantized(vector: Column, scale: int = 64, offset: int = 1_000_000) -> Column:
    """floor(scale * entry) + offset for each entry; null where an entry is null, not finite or beyond exact doubles."""
    steps = F.transform(vector, lambda c: F.floor(F.when(F.abs(c.cast("double")) < LARGEST // scale, c.cast("double")) * scale).cast("long") + offset)
    return F.when((F.size(vector) > 0) & F.forall(steps, lambda x: x.isNotNull()), steps)


@dataclass
class Whitening:
    """What was fitted: n distinct vectors, their sums, right singular vectors (columns) and singular values of the centred ones."""

    n: int
    sums: np.ndarray
    vectors: np.ndarray
    singular: np.ndarray

    @property
    def scales(self) -> np.ndarray:
        """Deviations of the components; NaN without variance."""
        least = NO_VARIANCE * self.singular.max(initial=0.0)
        return np.where(self.singular > least, self.singular, np.nan) / np.sqrt(max(self.n, 1))

    @property
    def explained(self) -> np.ndarray:
        squares = self.singular**2
        return squares / squares.sum() if squares.sum() else np.full(len(squares), np.nan)


def _matrices(batches, at: int, width: int):
    """The vectors of a partition, some rows at a time."""
    for batch in batches:
        values = batch.column(at).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
        for i in range(0, len(values), ROWS):
            yield values[i : i + ROWS]


def _added(vectors: DataFrame, width: int, made) -> np.ndarray:
    """The sum over all rows of made(matrix of rows), a small array; partitions send one each, Spark adds cell by cell."""

    def run(batches):
        total = None
        for rows in _matrices(batches, 0, width):
            more = made(rows)
            total = more if total is None else total + more
        if total is not None:
            flat = total.ravel()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(flat.size), pa.int32()), pa.array(flat, pa.int64() if flat.dtype.kind == "i" else pa.float64())], ["cell", "value"])

    kind = "long" if made(np.zeros((1, width), np.int64)).dtype.kind == "i" else "double"
    cells = vectors.mapInArrow(run, f"cell int, value {kind}").groupBy("cell").agg(F.sum("value").alias("value")).toPandas().sort_values("cell")
    shape = made(np.zeros((1, width), np.int64)).shape
    return cells["value"].to_numpy().reshape(shape) if len(cells) else made(np.zeros((0, width), np.int64))


def centred(rows: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """rows - sums / n with one rounding, as long as n * row fits 64 bits."""
    return (n * rows - sums) / n


def solved(rows: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """rows @ inverse(upper) by substitution, column after column."""
    out = np.empty_like(rows)
    for j in range(upper.shape[0]):
        out[:, j] = (rows[:, j] - out[:, :j] @ upper[:j, j]) / upper[j, j]
    return out


def _factor(gram: np.ndarray, rows: int, shifted: bool) -> np.ndarray:
    """The upper Cholesky factor, of the shifted matrix if asked for or needed."""
    width, unit = len(gram), np.finfo(float).eps / 2
    shift = 11 * (rows * width + width * (width + 1)) * unit * np.linalg.norm(gram, 2)
    shift = min(shift, np.linalg.norm(gram, 2) / 100) or 1.0  # of no rows but equal ones the matrix is 0
    if not shifted:
        try:
            return np.linalg.cholesky(gram).T
        except np.linalg.LinAlgError:  # dependent columns
            pass
    return np.linalg.cholesky(gram + shift * np.eye(width)).T


def fit(vectors: DataFrame, width: int) -> Whitening:
    """Fit on all rows of a table whose one column holds arrays of `width` longs, none null, each vector once."""
    n = vectors.count()
    sums = _added(vectors, width, lambda rows: rows.sum(axis=0, dtype=np.int64))
    factors: list[np.ndarray] = []
    for i in range(PASSES):

        def gram(rows, factors=tuple(factors)):
            q = centred(rows, max(n, 1), sums)
            for upper in factors:
                q = solved(q, upper)
            return q.T @ q

        factors.append(_factor(_added(vectors, width, gram), n, i == 0))
    whole = np.eye(width)
    for upper in factors:
        whole = upper @ whole
    _, singular, right = np.linalg.svd(whole)
    signs = np.sign(right[np.arange(width), np.abs(right).argmax(axis=1)])
    if n < 2:
        singular = np.zeros(width)
    singular = np.where(singular > NO_VARIANCE * singular.max(initial=0.0), singular, 0.0)
    return Whitening(n, sums, (right * signs[:, None]).T, singular)


def identity_error(vectors: DataFrame, fitted: Whitening, components: int) -> float | None:
    """The largest absolute entry of the covariance, minus the identity, of the whitened vectors of the fit; null without variance."""
    scales = fitted.scales[:components]
    able = ~np.isnan(scales)
    if not able.any():
        return None
    basis = fitted.vectors[:, :components][:, able] / scales[able]

    def moments(rows):
        z = centred(rows, max(fitted.n, 1), fitted.sums) @ basis
        return np.concatenate([z.sum(axis=0)[None], z.T @ z])

    total = _added(vectors, len(fitted.sums), moments) / fitted.n
    return float(np.abs(total[1:] - np.outer(total[0], total[0]) - np.eye(able.sum())).max())


def whiten(df: DataFrame, vector_col: str, components: int = 16, scale: int = 64, offset: int = 1_000_000) -> DataFrame:
    """Rows of df for each component: component (from 1), n, deviation, whitened, explained, identity_error, in place of the vector.

    Entries become longs, floor(scale * entry) + offset; the fit takes each distinct vector of longs
    once. Rows without a vector, with an empty one or with entries that are null, not finite or
    beyond 2**52 are dropped, and so are vectors whose length isn't the commonest one (of equally
    common ones the longest). `deviation` is the exact sum of (n * x - S)**2, null where it exceeds a
    long. Components without variance have a null `whitened`; all values that no fit can tell are
    null. Repeated rows stay repeated, other columns pass through, an empty table gives no rows;
    columns that have these names already come back with _input behind them.
    """
    spark = df.sparkSession
    prepare(spark, rows=10_000)
    own = ["component", "n", "deviation", "whitened", "explained", "identity_error"]
    df, vector_col = aside(df, own, vector_col)
    scratch = Scratch(spark)
    longs = df.withColumn(vector_col, quantized(F.col(vector_col), scale, offset)).where(F.col(vector_col).isNotNull())
    lengths = longs.groupBy(F.size(vector_col).alias("width")).count()
    commonest = lengths.agg(F.max(F.struct("count", "width")).alias("top")).first()["top"]
    width = commonest["width"] if commonest else 1
    longs = longs.where(F.size(vector_col) == width)
    vectors = scratch.keep(longs.select(vector_col).distinct(), "vectors")
    fitted = fit(vectors, width)
    error = identity_error(vectors, fitted, components)
    scratch.drop("vectors")
    k = min(components, width)
    n, sums = fitted.n, fitted.sums
    with np.errstate(invalid="ignore"):
        basis = fitted.vectors[:, :k] / fitted.scales[:k]
    explained = [None if np.isnan(e) else float(e) for e in fitted.explained[:k]]
    rest = [f for f in longs.schema.fields if f.name != vector_col]
    at = longs.columns.index(vector_col)

    def run(batches):
        for batch in batches:
            rows = batch.column(at).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            apart = n * rows - sums
            fits = (apart.astype(float) ** 2).sum(axis=1) < 9.2e18
            deviation = pa.array(np.where(fits, (apart * apart).sum(axis=1), 0), pa.int64(), mask=~fits)
            projected = (apart / n) @ basis
            values = pa.array(projected.ravel(), pa.float64(), mask=np.isnan(projected.ravel()))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * k, pa.int32()), values)
            kept = [batch.column(i) for i in range(batch.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays([*kept, deviation, lists], [*(f.name for f in rest), "deviation", "whitened"])

    told = longs.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest), "deviation long, whitened array<double>"]))
    names = [f.name for f in rest]
    each = told.select(*[F.col(f"`{c}`") for c in names], "deviation", F.posexplode("whitened").alias("component", "whitened"))
    return each.select(
        *[F.col(f"`{c}`") for c in names],
        (F.col("component") + 1).alias("component"),
        F.lit(n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(F.array(*[F.lit(e).cast("double") for e in explained]), F.col("component")).alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
    )
