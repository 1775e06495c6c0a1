"""Make the package importable in Python workers wherever they run."""

from __future__ import annotations

import functools
import os
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from . import scratch

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Hand the package to the executors, once per application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    here = Path(__file__).resolve().parent
    base = scratch.folder(spark).removeprefix("file://")
    folder = base if base.startswith("/") else tempfile.mkdtemp(prefix="sidloom-")  # the driver serves the file itself
    os.makedirs(folder, exist_ok=True)
    path = f"{folder}/sidloom-{app}.zip"
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(here.rglob("*.py")):
            z.write(p, p.relative_to(here.parent))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


def shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run
