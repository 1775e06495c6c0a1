"""Structured Streaming jobs: sessions with late data, and incremental behavior."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import scratch


def _source(spark: SparkSession, path: str) -> DataFrame:
    folder = path.rsplit("/", 1)
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", folder[1]).parquet(folder[0])


def sessions(events: DataFrame, gap: str = "12 hours", late: str = "1 hour") -> DataFrame:
    """(user_id, start, end, n) per session window; rows later than ``late`` behind the watermark are out."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    g = timed.groupBy("user_id", F.session_window("at", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return g.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def run_sessions(spark: SparkSession, path: str) -> DataFrame:
    """All sessions that the watermark has closed, after the source is read to its end."""
    at = f"{scratch.folder(spark)}/sessions-{uuid.uuid4().hex}"
    q = sessions(_source(spark, path)).writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{at}/state").option("path", f"{at}/out").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema("user_id bigint, start timestamp, end timestamp, n bigint").parquet(f"{at}/out")


def run_behavior_upsert(spark: SparkSession, path: str) -> DataFrame:
    """Counts and sums per user and type, kept up batch by batch.

    Every micro-batch is pre-aggregated and written under its number, so a
    batch that is run again replaces itself; a reader adds up the batches.
    """
    at = f"{scratch.folder(spark)}/upsert-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        part = batch.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
        part.write.mode("overwrite").parquet(f"{at}/out/batch={number}")

    q = _source(spark, path).writeStream.foreachBatch(write).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    parts = spark.read.schema("user_id bigint, event_type string, n bigint, total double, batch int").parquet(f"{at}/out")
    return parts.groupBy("user_id", "event_type").agg(F.sum("n").alias("n"), F.round(F.sum("total"), 4).alias("total"))
