"""Session settings that the engine's plans rely on."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

#: Adaptive execution, UTC times and filter pushdown into the data source of array stores.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.python.filterPushdown.enabled": "true",
}


def build(master: str | None = None, app: str = "tessera", **more: str) -> SparkSession:
    """A session with SETTINGS; `more` takes settings with _ for the dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = SETTINGS | {k.replace("_", "."): v for k, v in more.items()}
    return builder.config(map=settings).getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package, wherever they run; once a session."""
    context = spark.sparkContext
    if getattr(context, "_tessera_shipped", False):
        return
    top = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="tessera-")) / "tessera.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(top.rglob("*.py")):
            out.write(file, file.relative_to(top.parent))
    context.addPyFile(str(archive))
    context._tessera_shipped = True
