"""Sends this package to the executors, for the functions that run in Python there."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession | None = None) -> None:
    """Once for each Spark context, in case the executors don't have the package."""
    spark = spark or SparkSession.active()
    sc = spark.sparkContext
    if getattr(sc, "_raregram_sent", False):
        return
    package = Path(__file__).resolve().parent
    tmp = tempfile.mkdtemp(prefix="raregram-")  # the driver serves the file while it lives
    atexit.register(shutil.rmtree, tmp, ignore_errors=True)
    with zipfile.ZipFile(f"{tmp}/raregram.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f"{package.name}/{f.relative_to(package)}")
    sc.addPyFile(z.filename)
    sc._raregram_sent = True
