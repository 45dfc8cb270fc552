"""Value counts of tissues, kept in a folder: statistics that grow with a cohort.

A count says how often a value occurs in a tissue's channel. Counts add up, so tissues come in
batches, each written once, and quantiles and moments of any level are worked out from all
counts without looking at an image again. They are as exact as from the pixels.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import stats
from tessera.sources import catalog

SCHEMA = "tissue_id string, channel string, value double, n long"
KEYS = ["tissue_id", "channel", "value"]


def counted(pixels: DataFrame) -> DataFrame:
    """(tissue_id, channel, value, n) of pixels(tissue_id, channel, value); missing values, NaN and the infinities are NULL."""
    ids = [F.col(k).cast("string").alias(k) for k in ("tissue_id", "channel")]
    return pixels.select(*ids, stats.finite(F.col("value").cast("double")).alias("value")).groupBy(*KEYS).agg(F.count("*").alias("n"))


def quantiles(counts: DataFrame, level: str, upper: float = 0.99, lower: float | None = None) -> DataFrame:
    """stats.quantiles of the pixels that were counted."""
    keys = stats.LEVELS[level]
    if level == "global":
        return stats.range_quantiles(added(counts, [*keys, "value"]), keys, upper, lower, "n")
    low = F.percentile("value", F.lit(lower), F.col("n")) if lower is not None else F.lit(None).cast("double")
    return counts.groupBy(*keys).agg(F.percentile("value", F.lit(upper), F.col("n")).alias("upper"), low.alias("lower"))


def moments(counts: DataFrame, bounds: DataFrame, quantile_level: str, stats_level: str, spec: str = "quantile_clipping") -> DataFrame:
    """stats.moments of the pixels that were counted: means first, then squares around them, so that nothing cancels out."""
    keys = stats.LEVELS[stats_level]
    z = stats.transformed(counts, bounds, quantile_level, spec).select(*keys, "z", F.when(F.col("z").isNotNull(), F.col("n")).otherwise(0).alias("n"))
    means = z.groupBy(*keys).agg((F.sum(F.col("z") * F.col("n")) / F.nullif(F.sum("n"), F.lit(0))).alias("mean"), F.min("z").alias("least"), F.max("z").alias("most"))
    around = F.sum(F.pow(F.col("z") - F.col("mean"), 2) * F.col("n"))
    one = F.col("least") == F.col("most")
    made = z.join(means, keys).groupBy(*keys, "mean", "least", "most").agg(around.alias("around"), F.sum("n").alias("n"))
    std = F.when(one, 0.0).otherwise(F.sqrt(F.col("around") / F.nullif(F.col("n"), F.lit(0))))
    return made.select(*keys, F.when(one, F.col("least")).otherwise(F.col("mean")).alias("mean"), std.alias("std"), "n")


def added(counts: DataFrame, keys: list[str]) -> DataFrame:
    return counts.groupBy(*keys).agg(F.sum("n").alias("n"))


class PixelCounts:
    """Counts in a folder: generations of batches, of which the last generation holds.

    A batch appears as a whole, and one of a name that was added before isn't added again, so a
    stream that repeats its last batch counts it once. `compact` adds up all batches into the
    first one of a new generation. One writer at a time. Integer images have as many counts a
    tissue and channel as they have levels; images of arbitrary reals may have one for each pixel.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _generation(self) -> str:
        found = [n for n, _ in catalog.children(self.spark, self.path) if re.fullmatch(r"generation-[0-9]+", n)]
        return max(found, key=lambda n: int(n.split("-")[1]), default="generation-0")

    def _held(self, folder: str) -> list[str]:
        return [n for n, _ in catalog.children(self.spark, folder) if n.startswith("batch-") and ".writing-" not in n]

    def batches(self) -> list[str]:
        """Names of the batches that are in the counts."""
        at = f"{self.path}/{self._generation()}"
        names = [n.removeprefix("batch-") for n in self._held(at)]
        if catalog.exists(self.spark, f"{at}/names"):
            names += [r["name"] for r in self.spark.read.parquet(f"{at}/names").collect()]
        return sorted(set(names) - {""})

    def table(self) -> DataFrame:
        """(tissue_id, channel, value, n) of all batches; a tissue may come in several."""
        at = f"{self.path}/{self._generation()}"
        held = self._held(at)
        if not held:
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(*[f"{at}/{n}" for n in held])

    def tissues(self) -> DataFrame:
        return self.table().select("tissue_id").distinct()

    def add(self, pixels: DataFrame, name: str | None = None) -> bool:
        """Add pixels to the counts as a batch; False if one of that name was added before."""
        name = name or uuid.uuid4().hex
        if not re.fullmatch(r"[A-Za-z0-9_-]+", name):
            raise ValueError(f"a batch's name is letters, digits, _ and -: {name!r}")
        if name in self.batches():
            return False
        catalog.replace(self.spark, counted(pixels), f"{self.path}/{self._generation()}/batch-{name}")
        return True

    def add_new(self, pixels: DataFrame) -> bool:
        """Add the tissues that have no counts yet."""
        ids = F.col("tissue_id").cast("string")
        return self.add(pixels.withColumn("tissue_id", ids).join(self.tissues(), "tissue_id", "left_anti"))

    def follow(self, pixels: DataFrame, checkpoint: str, name: str = "stream", **trigger):
        """Add each batch of a stream of pixels; the query that runs. A tissue's pixels may come in any batches."""
        writer = pixels.writeStream.foreachBatch(lambda batch, i: self.add(batch, f"{name}-{i}")).option("checkpointLocation", checkpoint)
        return (writer.trigger(**trigger) if trigger else writer).start()

    def compact(self) -> None:
        """One batch in the place of all of them; their names stay known."""
        now = self._generation()
        made = f"{self.path}/making-{uuid.uuid4().hex}"
        added(self.table(), KEYS).write.parquet(f"{made}/batch-")
        self.spark.createDataFrame([(n,) for n in self.batches()], "name string").coalesce(1).write.parquet(f"{made}/names")
        fs, at = catalog._path(self.spark, made)
        to = f"{self.path}/generation-{int(now.split('-')[1]) + 1}"
        if not fs.rename(at, catalog._path(self.spark, to)[1]):
            raise OSError(f"can't put {made} in the place of {to}")
        fs.delete(catalog._path(self.spark, f"{self.path}/{now}")[1], True)
