"""Dense numbers for ordered tables, and an index of them that is written once and read by number."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import metadata
from tessera.sources import catalog

#: Rows of a block, which one task puts in order.
BLOCK = 100_000
#: Rows of a file of a stored index.
FILE_ROWS = 1_000_000


def numbered(rows: DataFrame, block: list[str], order: list[str], name: str = "global_id") -> DataFrame:
    """rows with a dense number from 0, in order of the block's columns, then of `order`.

    Blocks are counted and the counts added up, so a task sorts one block only; the table of
    counts has a row for each block.
    """
    counts = rows.groupBy(*block).agg(F.count("*").alias("__n"))
    over = Window.orderBy(*block).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*block, F.coalesce(F.sum("__n").over(over), F.lit(0)).alias("__before"))
    nth = F.row_number().over(Window.partitionBy(*block).orderBy(*order)) - 1
    return rows.withColumn("__nth", nth).join(starts, block).withColumn(name, F.col("__before") + F.col("__nth")).drop("__before", "__nth")


class StoredIndex:
    """A numbered table as files of consecutive numbers, and a manifest that tells which file holds which.

    What asks for rows by number looks into the manifest, a row a file, and scans the files that
    hold them; a file is sorted, so its row groups prune by their statistics.
    """

    def __init__(self, spark: SparkSession, path: str, number: str = "global_id"):
        self.spark, self.path, self.number = spark, path.rstrip("/"), number

    def there(self) -> bool:
        return catalog.exists(self.spark, f"{self.path}/manifest")

    def write(self, rows: DataFrame, file_rows: int = FILE_ROWS) -> None:
        """Write rows whose numbers are dense from 0."""
        n = F.col(self.number)
        # dealt by number, not by a sample of it: each file has exactly its numbers
        parts = max(1, -(-rows.count() // file_rows))
        dealt = rows.repartitionByRange(parts, n) if parts > 1 else rows.coalesce(1)
        catalog.replace(self.spark, dealt.sortWithinPartitions(n), f"{self.path}/rows")
        written = self.spark.read.parquet(f"{self.path}/rows")
        held = written.groupBy(F.col("_metadata.file_name").alias("file")).agg(F.min(n).alias("first"), F.max(n).alias("last"))
        catalog.replace(self.spark, held.coalesce(1), f"{self.path}/manifest")

    @property
    def manifest(self) -> DataFrame:
        """(file, first, last)."""
        return self.spark.read.parquet(f"{self.path}/manifest")

    def size(self) -> int:
        return self.manifest.agg(F.coalesce(F.max("last") + 1, F.lit(0))).first()[0]

    def numbers(self, wanted: list[int]) -> DataFrame:
        """Rows with some numbers, from the files that hold them."""
        held = F.exists(F.array(*[F.lit(w) for w in wanted]), lambda w: (w >= F.col("first")) & (w <= F.col("last")))
        files = [r["file"] for r in self.manifest.where(held).select("file").collect()] if wanted else []
        if not files:
            return self.spark.read.parquet(f"{self.path}/rows").where("false")
        return self.spark.read.parquet(*[f"{self.path}/rows/{f}" for f in files]).where(F.col(self.number).isin(wanted))

    def at(self, number: int) -> DataFrame:
        return self.numbers([number])

    def draws(self, n: int, seed: int) -> DataFrame:
        """n rows drawn with replacement, reproducibly, with the number of the draw."""
        size = self.size()
        if not size:
            raise ValueError("nothing to draw from")
        picks = self.spark.range(n).select((metadata.drawn(["id"], seed) % size).alias(self.number), F.col("id").alias("draw"))
        if n > 1000:  # most files hold some of them
            return picks.join(self.spark.read.parquet(f"{self.path}/rows"), self.number)
        return picks.join(self.numbers([r[0] for r in picks.select(self.number).distinct().collect()]), self.number)
