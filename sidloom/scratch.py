"""Intermediate tables in the folder that all executors share.

A table kept here cuts the lineage and outlives any executor. The folder is the
session's ``spark.checkpoint.dir``; only where that is unset (single machine,
tests) a private temporary folder stands in for it.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """A folder of this application in the shared folder; it goes when the application's JVM ends."""
    app = spark.sparkContext.applicationId
    if app not in _own:
        given = spark.conf.get("spark.checkpoint.dir", None)
        if given:
            _own[app] = f"{given.rstrip('/')}/sidloom-{app}"
            path = spark._jvm.org.apache.hadoop.fs.Path(_own[app])
            files = path.getFileSystem(spark._jsc.hadoopConfiguration())
            files.mkdirs(path)
            files.deleteOnExit(path)
        else:
            _own[app] = tempfile.mkdtemp(prefix="sidloom-")
            atexit.register(shutil.rmtree, _own[app], True)
            spark.sparkContext.setCheckpointDir(f"{_own[app]}/rdd")
    return _own[app]


def keep(df: DataFrame, name: str, clustered: str | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and return a scan of it."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    out = df.repartition(clustered) if clustered else df
    out.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
