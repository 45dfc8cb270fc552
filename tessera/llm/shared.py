"""What several operators need: intermediate tables, bounded samples and range buckets."""

from __future__ import annotations

import bisect
import itertools
import os
import tempfile
import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.session import ship_package


#: Folders of local applications that name none.
_own: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names; in local mode only, one of the application's own if none is named."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not spark.sparkContext.master.startswith(("local[", "local*")) and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="tessera-")
    return _own[app]


class Scratch:
    """Tables written to the shared folder: they cut lineage and outlive lost executors."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{scratch_root(spark)}/tessera-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop(self, *names: str) -> None:
        """Remove tables that nothing reads any more."""
        jvm = self.spark.sparkContext._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession, rows: int = 500, size: int = 8 << 20) -> None:
    """Let workers import the package, and get at most so many rows and bytes at once: texts are long."""
    ship_package(spark)
    for name, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        key = f"spark.sql.execution.arrow.{name}"
        if not 0 < int(spark.conf.get(key).rstrip("b")) <= most:
            spark.conf.set(key, str(most))


def ship_file(spark: SparkSession, path: str) -> str:
    """Let workers open a small local file of the driver's, by the name that comes back: SparkFiles.get(name)."""
    context = spark.sparkContext
    shipped = context.__dict__.setdefault("_tessera_files", {})
    if path not in shipped:
        context.addFile(path)
        shipped[path] = os.path.basename(path)
    return shipped[path]


def aside(df: DataFrame, names: list[str], *used: str) -> tuple:
    """df with _input behind those of its columns that are named like one of `names`; then the new names of `used`.

    So an operator's own columns have their names, and the others are still there.
    """
    taken, have = {n.lower() for n in names}, {c.lower() for c in df.columns}
    new = []
    for column in df.columns:
        if column.lower() in taken:
            column += "_input"
            while column.lower() in taken | have:
                column += "_input"
            have.add(column.lower())
        new.append(column)
    to = dict(zip(df.columns, new, strict=True))
    return df.toDF(*new) if new != df.columns else df, *[to[u] for u in used]


def bounded_sample(df: DataFrame, key: Column, rows: int) -> DataFrame:
    """About `rows` rows, the same for the same data: those whose hash is below a share.

    The number of rows fetched stays near `rows` whatever the size of the table, as the
    share comes from a count of all rows.
    """
    share = min(1.0, rows / max(1, df.count()))
    if share == 1.0:
        return df
    return df.where(F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(1 << 30)) < int(share * (1 << 30)))


def cut_points(df: DataFrame, order: list[str], parts: int, sample_rows: int = 20_000) -> list:
    """At most parts - 1 rows that cut `df`, in the order of the columns, into even parts.

    They come from a bounded sample, so even one very common value is cut as long as a
    later column of `order` tells its rows apart.
    """
    picked = bounded_sample(df, F.struct(*order), sample_rows).select(*order)
    rows = sorted(tuple(r) for r in picked.collect())
    return sorted({rows[len(rows) * i // parts] for i in range(1, parts)}) if rows else []


def tasks_of(spark: SparkSession) -> int:
    """Tasks of a shuffle, for rows that are few bytes and much work, which adaptive execution would put together."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def values_at(df: DataFrame, name: str, ranks: Callable[[int], list[int]]) -> list:
    """The values of a column at the ranks (from 0) that a function names for the count of all rows with one; each value once, in order.

    NULL and NaN aside. Values are counted, dealt to tasks in order, and counted up within a task from
    what the tasks before it hold: one number a task and the values asked for come to the driver.
    """
    known = F.col(name).isNotNull()
    if df.schema[name].dataType.typeName() in ("float", "double"):
        known = known & ~F.isnan(name)
    scratch = Scratch(df.sparkSession)
    counted = df.where(known).groupBy(F.col(name).alias("value")).agg(F.count("*").alias("n"))
    dealt = scratch.keep(counted.repartitionByRange(tasks_of(df.sparkSession), "value").withColumn("part", F.spark_partition_id()), "counted")
    held = dealt.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect()
    total = sum(r["n"] for r in held)
    wanted = sorted({r for r in ranks(total) if 0 <= r < total})
    picked = []
    if wanted:
        before = zip([r["part"] for r in held], itertools.accumulate([0, *(r["n"] for r in held)]), strict=False)
        starts = F.create_map(*[F.lit(v) for pair in before for v in pair])
        upto = F.sum("n").over(Window.partitionBy("part").orderBy("value")) + F.element_at(starts, F.col("part"))
        holds = F.exists(F.array(*[F.lit(r) for r in wanted]), lambda r: (r < F.col("upto")) & (r >= F.col("upto") - F.col("n")))
        picked = sorted(r["value"] for r in dealt.withColumn("upto", upto).where(holds).select("value").collect())
    scratch.drop("counted")
    return picked


def bucket_of(points: list, columns: list[str]) -> Column:
    """The number of cut points that are at most the row's columns (none of them null)."""

    @F.pandas_udf("int")
    def find(rows: pd.DataFrame) -> pd.Series:
        return pd.Series([bisect.bisect_right(points, r) for r in rows.itertuples(index=False, name=None)], dtype="int32")

    return find(F.struct(*columns)) if points else F.lit(0)
