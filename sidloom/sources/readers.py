"""Readers and writers of the domain's formats."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import scratch
from ..util import first_column


def read_content(spark: SparkSession, path: str) -> DataFrame:
    """Content newest first; the text column may be named full_text, text or content; null images are []."""
    df = spark.read.parquet(path)
    text = first_column(df, ["full_text", "text", "content"])
    images = F.coalesce("images", F.array().cast("array<string>")) if "images" in df.columns else F.array().cast("array<string>")
    return df.orderBy(F.desc("create_date")).select("content_id", F.col(text).alias("full_text"), "content_language", images.alias("images"))


def read_content_map(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).where("full_text IS NOT NULL AND full_text <> ''").select("content_id", "full_text")


def read_behavior(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.parquet(*paths).select("uid", "iid", F.col("action_bitmap").cast("int").alias("action_bitmap"), F.coalesce("first_ts", F.lit(0)).cast("bigint").alias("first_ts"))


def days(df: DataFrame, at: str, start: str, end: str) -> DataFrame:
    """Rows of the days start..end, both included, with their day as ``dt``; a range on ``at`` that reaches the scan."""
    lo, hi = F.to_timestamp(F.lit(start)), F.to_timestamp(F.date_add(F.to_date(F.lit(end)), 1))
    return df.where((F.col(at) >= lo) & (F.col(at) < hi)).withColumn("dt", F.to_date(at))


def read_movies_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("mid bigint, title string, genres string").option("header", True).csv(path)


def write_dat(df: DataFrame, path: str) -> None:
    """Rows as text with ``::`` between the columns."""
    df.select(F.concat_ws("::", *[F.col(c).cast("string") for c in df.columns]).alias("value")).write.mode("overwrite").text(path)


def read_ratings_dat(spark: SparkSession, path: str) -> DataFrame:
    """``uid::mid::rating::ts`` lines in Latin-1."""
    return spark.read.schema("uid bigint, mid bigint, rating double, ts bigint").option("sep", "::").option("encoding", "ISO-8859-1").csv(path)


def synthetic_ratings(spark: SparkSession, users: int = 240, items: int = 120, genres: int = 6) -> DataFrame:
    """Invented ratings: each user prefers one genre for three quarters of 8 to 28 items; the same rows at every call."""
    h = lambda *c: F.conv(F.substring(F.sha2(F.concat(*[x if isinstance(x, Column) else F.lit(x) for x in c]), 256), 1, 8), 16, 10).cast("bigint")
    uid, t = F.col("uid").cast("string"), F.col("t").cast("string")
    seq = spark.range(users).withColumnRenamed("id", "uid").select("uid", F.explode(F.sequence(F.lit(1).cast("bigint"), 8 + h(uid, "n") % 21)).alias("t"))
    own = h(uid, "g") % genres
    genre = F.when(h(uid, "_", t, "p") % 4 < 3, own).otherwise(h(uid, "_", t, "q") % genres)
    mid = (h(uid, "_", t, "m") % (items // genres)) * genres + genre
    return seq.select("uid", mid.cast("bigint").alias("mid"), F.when(genre == own, 4.0).otherwise(3.0).alias("rating"), (F.lit(1_700_000_000) + F.col("uid") * 1000 + F.col("t")).alias("ts"))


def merge_by_priority(parts: list[DataFrame], key: str) -> DataFrame:
    """Union in which the first part that has a key wins; ``_source`` is that part's number."""
    all_rows = None
    for i, p in enumerate(parts):
        p = p.withColumn("_source", F.lit(i))
        all_rows = p if all_rows is None else all_rows.unionByName(p)
    best = Window.partitionBy(key).orderBy("_source")
    return all_rows.withColumn("_rn", F.row_number().over(best)).where("_rn = 1").drop("_rn")


#: Keys of a configuration file that describe it and are no settings (fixed values).
META_KEYS = ("base", "name", "description", "variants")


def read_config(path: str) -> dict:
    """A YAML file, or JSON where no YAML reader is installed."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    try:
        import yaml
    except ImportError:
        return json.loads(text)
    return yaml.safe_load(text) or {}


def resolve_variants(base: dict, raw: dict, stem: str) -> list[tuple[str, dict]]:
    """(name, settings) of every variant of a configuration, or of the one that it is."""
    shared = {k: v for k, v in raw.items() if k not in META_KEYS}
    if not raw.get("variants"):
        return [(raw.get("name") or stem, {**base, **shared})]
    return [(v["name"], {**base, **shared, **{k: x for k, x in v.items() if k != "name"}}) for v in raw["variants"]]


def write_sample_runs(spark: SparkSession) -> str:
    """Three small run directories with meta JSON and a JSON-lines log; returns their parent."""
    at = f"{scratch.folder(spark)}/runs-{uuid.uuid4().hex}"
    rows = [(f"run{i}", json.dumps({"name": f"run{i}", "train": {"total_tokens": 10**6 * i}, "eval": {"ppl": 20.0 - i}})) for i in (1, 2, 3)]
    spark.createDataFrame(rows, "run string, value string").write.partitionBy("run").text(f"{at}/meta")
    logs = [(f"run{i}", json.dumps({"step": s, "ntp_loss": 6.0 - s / 10})) for i in (1, 2, 3) for s in range(5)]
    spark.createDataFrame(logs, "run string, value string").write.partitionBy("run").text(f"{at}/log")
    return at


def read_runs(spark: SparkSession, at: str) -> DataFrame:
    """One row per run: its meta data and the last step of its log."""
    meta = spark.read.schema("run string, name string, train struct<total_tokens: bigint>, eval struct<ppl: double>").json(f"{at}/meta")
    log = spark.read.schema("run string, step bigint, ntp_loss double").json(f"{at}/log").groupBy("run").agg(F.max("step").alias("last_step"), F.max_by("ntp_loss", "step").alias("last_loss"))
    return meta.join(log, "run").select("run", F.col("train.total_tokens").alias("total_tokens"), F.col("eval.ppl").alias("ppl"), "last_step", "last_loss")


def write_sorted(df: DataFrame, key: str, files: int) -> DataFrame:
    """Write ``files`` sorted snappy files and return a scan of them."""
    path = f"{scratch.folder(df.sparkSession)}/sorted-{uuid.uuid4().hex}"
    df.repartition(files, key).sortWithinPartitions(key).write.option("compression", "snappy").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def contiguous_shards(df: DataFrame, key: str, shards: int) -> DataFrame:
    """Runs of equal length in the order of ``key``; the last shard takes the remainder.

    The position of a row is the number of rows in the range partitions before
    its own plus its place there, so no task sorts the whole table.
    """
    ranged = scratch.keep(df.repartitionByRange(shards * 4, key).sortWithinPartitions(key).withColumn("_m", F.monotonically_increasing_id()), "ranged")
    part = F.shiftright("_m", 33)
    sizes = ranged.groupBy(part.alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_b", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # shards * 4 rows
    total = ranged.count()
    size = max(1, total // shards)
    place = F.col("_b") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    return ranged.withColumn("_p", part).join(F.broadcast(before), "_p").withColumn("shard", F.least(F.floor(place / size), F.lit(shards - 1)).cast("int")).drop("_m", "_p", "_n", "_b")


def parse_object_path(url: Column) -> list[Column]:
    pattern = "^s3://([^/]+)/(.*)$"
    return [F.regexp_extract(url, pattern, 1).alias("bucket"), F.regexp_extract(url, pattern, 2).alias("key")]


def read_days(spark: SparkSession, path: str, start: str, end: str) -> DataFrame:
    """Rows of the folders day=YYYYMMDD of a range of days; the others are not opened."""
    day = F.to_date("day", "yyyyMMdd")
    return spark.read.option("basePath", path).parquet(path).withColumn("day", F.col("day").cast("string")).where(day.between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def read_zip_csv(archives: DataFrame, member: str, schema: str) -> DataFrame:
    """Rows of the CSV file ``member`` (by the end of its name) of each archive (content binary), as ``binaryFile`` reads them."""

    def unpack(batches):
        import io
        import zipfile

        import pyarrow as pa

        for b in batches:
            lines = []
            for content in b.column("content").to_pylist():
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name in z.namelist():
                        if name.endswith(member):
                            lines += z.read(name).decode("utf-8").splitlines()[1:]
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], names=["line"])

    got = archives.select("content").mapInArrow(unpack, "line string").select(F.from_csv("line", schema).alias("r"))
    return got.select("r.*")
