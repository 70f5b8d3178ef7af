"""Sends this package's modules to the Python workers of executors that don't have it."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parents[1]


def ship(spark: SparkSession) -> None:
    """Once per Spark context; Spark's own file server brings the modules to every executor."""
    context = spark.sparkContext
    if getattr(context, "_graphloom_shipped", False) or not PACKAGE.is_dir():
        return
    archive = Path(tempfile.mkdtemp(prefix="graphloom-")) / "graphloom.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for path in sorted(PACKAGE.rglob("*.py")):
            z.write(path, path.relative_to(PACKAGE.parent))
    context.addPyFile(str(archive))
    context._graphloom_shipped = True
