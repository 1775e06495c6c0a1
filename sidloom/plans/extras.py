"""Sources, sinks and batch orders that need no table of their own section, and the metric report."""

from __future__ import annotations

import io
import json
import uuid
import zipfile

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import scratch
from ..evaluate import METRICS, Inputs, evaluate
from ..functions import scalars
from ..operators import vq
from ..sources import readers
from ..util import first_column, table
from .base import behavior, behavior_v2, sids, sql
from .pipelines import _CENT, _RQ, _books

Q: dict = {}
S: dict = {}


def query(oracle: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if oracle:
            S[f.__name__] = oracle
        return f

    return add


@query("SELECT content_id, length(coalesce(full_text, ''))::INT AS chars FROM pinned_content")
def probe_column(spark, d):
    """The first of several possible names that a table has."""
    c = table(spark, d, "pinned_content")
    return c.select("content_id", F.length(F.coalesce(F.col(first_column(c, ["text", "content", "full_text"])), F.lit(""))).alias("chars"))


@query(sql("SELECT day, count(*) AS n FROM (SELECT strftime(ingested_at, '%Y%m%d') AS day FROM behavior_v2 WHERE ingested_at::DATE BETWEEN DATE '2025-01-05' AND DATE '2025-01-08') GROUP BY day"))
def scan_exposure_files(spark, d):
    """Rows by day from files that lie in a folder for each day; only the folders of the range are read."""
    at = f"{scratch.folder(spark)}/exposure-{uuid.uuid4().hex}"
    table(spark, d, "behavior_v2").where("ingested_at IS NOT NULL").select("uid", "iid", F.date_format("ingested_at", "yyyyMMdd").alias("day")).write.partitionBy("day").parquet(at)
    return readers.read_days(spark, at, "2025-01-05", "2025-01-08").groupBy("day").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT movie, title FROM (VALUES (1, 'One (1995)'), (2, 'Two, again (1996)')) t(movie, title)")
def scan_download_zip(spark, d):
    """A table from an archive that was fetched before."""
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        z.writestr("set/movies.csv", 'movieId,title\n1,One (1995)\n2,"Two, again (1996)"\n')
    archive = spark.createDataFrame([("set.zip", bytearray(packed.getvalue()))], "path string, content binary")
    return readers.read_zip_csv(archive, "movies.csv", "movieId int, title string").select(F.col("movieId").alias("movie"), "title")


@query("SELECT uid, built_at, len(tokens)::INT AS length, (row_number() OVER (ORDER BY len(tokens), uid, built_at, list_sum(tokens)) - 1) // 64 AS batch FROM (SELECT * FROM (SELECT DISTINCT uid, built_at, tokens FROM sequences WHERE uid IS NOT NULL AND built_at IS NOT NULL AND len(tokens) > 0) QUALIFY count(*) OVER (PARTITION BY uid, built_at) = 1)")
def sort_length_bucket(spark, d):
    """Batches of 64 sequences of about the same length: places inside range partitions, plus the sizes of those before."""
    s = table(spark, d, "sequences").where("uid IS NOT NULL AND built_at IS NOT NULL AND size(tokens) > 0").select("uid", "built_at", "tokens").distinct()
    alone = F.count(F.lit(1)).over(Window.partitionBy("uid", "built_at"))
    s = s.withColumn("k", alone).where("k = 1").select("uid", "built_at", F.size("tokens").alias("length"))
    return numbered(s, ["length", "uid", "built_at"]).select("uid", "built_at", "length", F.floor(F.col("place") / 64).alias("batch"))


def numbered(df, by):
    """With place, 0 for the first row in the order of ``by``; no task sorts all rows."""
    cut = scratch.keep(df.repartitionByRange(*by).withColumn("_p", F.spark_partition_id()), "ranges")
    skip = cut.groupBy("_p").agg(F.count(F.lit(1)).alias("c")).select("_p", (F.sum("c").over(Window.orderBy("_p")) - F.col("c")).alias("skip"))  # a row per partition
    return cut.join(F.broadcast(skip), "_p").withColumn("place", F.row_number().over(Window.partitionBy("_p").orderBy(*by)) - 1 + F.col("skip")).drop("_p", "skip")


@query("SELECT p_partkey, (row_number() OVER (ORDER BY sha256(p_partkey::VARCHAR || '7'), p_partkey) - 1) // 256 AS batch FROM part")
def shuffle_seeded(spark, d):
    """Batches of 256 in an order that a seed decides and no partitioning."""
    h = table(spark, d, "part").select("p_partkey", F.sha2(F.concat(F.col("p_partkey").cast("string"), F.lit("7")), 256).alias("h"))
    return numbered(h, ["h", "p_partkey"]).select("p_partkey", F.floor(F.col("place") / 256).alias("batch"))


@query(sql("SELECT count(*) AS items, count(DISTINCT sid) AS sids, max(n) AS largest FROM (SELECT sid, count(*) OVER (PARTITION BY sid) AS n FROM sid)", "sid"))
def sink_artifacts(spark, d):
    """SID map, metrics and meta data of a run, written and read again."""
    at = f"{scratch.folder(spark)}/run-{uuid.uuid4().hex}"
    s = scratch.keep(sids(spark, d).select("content_id", "sid"), "map")
    s.write.parquet(f"{at}/sid_map")
    n = s.groupBy("sid").agg(F.count(F.lit(1)).alias("n"))
    n.agg(F.sum("n").alias("items"), F.count(F.lit(1)).alias("sids"), F.max("n").alias("largest")).coalesce(1).write.json(f"{at}/metrics")
    spark.createDataFrame([(json.dumps({"layers": 3, "codes": 256}),)], "value string").coalesce(1).write.text(f"{at}/meta")
    spark.read.parquet(f"{at}/sid_map").limit(1).count()
    return spark.read.schema("items bigint, sids bigint, largest bigint").json(f"{at}/metrics")


@query("SELECT l_returnflag AS part, round(sum(l_extendedprice * l_discount) / sum(l_extendedprice), 9) AS value, count(*) AS n FROM lineitem GROUP BY 1")
def agg_distributed_reduce(spark, d):
    """Sums of numerators and denominators where the rows are, divided once at the end."""
    g = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("part")).agg(F.sum(F.col("l_extendedprice") * F.col("l_discount")).alias("a"), F.sum("l_extendedprice").alias("b"), F.count(F.lit(1)).alias("n"))
    return g.select("part", F.round(F.col("a") / F.col("b"), 9).alias("value"), "n")


_HR = dict(
    u=_CENT,
    n="SELECT q.vec_id AS q, v.vec_id AS c, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_dot_product(q.v, v.v), 9) DESC, v.vec_id) AS r FROM u q JOIN u v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0 QUALIFY r <= 50",
    l="SELECT vec_id, label FROM embeddings",
)


@query(sql("SELECT count(DISTINCT q) AS queries, round(avg(h), 6) AS hr50 FROM (SELECT n.q, avg(CASE WHEN a.label = b.label THEN 1.0::DOUBLE ELSE 0.0 END) AS h FROM n JOIN l a ON a.vec_id = n.q JOIN l b ON b.vec_id = n.c GROUP BY n.q)", **_HR))
def m_hr_monitor(spark, d):
    """Share of the 50 nearest vectors that belong with the query (here: have its label), the monitor of a training run."""
    from ..operators.vectors import topk_cosine

    e = table(spark, d, "embeddings")
    v = e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    near = topk_cosine(v.where("id % 50 = 0"), v, 50)
    label = e.select("vec_id", "label")
    j = near.join(label.select(F.col("vec_id").alias("q"), F.col("label").alias("lq")), "q").join(label.select(F.col("vec_id").alias("c"), F.col("label").alias("lc")), "c")
    per = j.groupBy("q").agg(F.avg(F.when(F.col("lq") == F.col("lc"), 1.0).otherwise(0.0)).alias("h"))
    return per.agg(F.count(F.lit(1)).alias("queries"), F.round(F.avg("h"), 6).alias("hr50"))


_LAYERS = " UNION ALL ".join(f"SELECT '{k}' AS part, avg(list_dot_product(v, v)) AS loss FROM e{k}" for k in (1, 2, 3))


@query(sql(f"SELECT part, round(loss, 6) AS loss FROM ({_LAYERS} UNION ALL SELECT 'total', avg(list_dot_product(v, v)) FROM e3 UNION ALL SELECT 'norm', avg(list_dot_product(v, v)) FROM u UNION ALL SELECT 'normalized', (SELECT avg(list_dot_product(v, v)) FROM e3) / ((SELECT avg(list_dot_product(v, v)) FROM u) + 1e-8))", **_RQ))
def m_reconstruction(spark, d):
    """Mean squared residual after each codebook, in all, and relative to the vectors' mean squared length."""
    u = table(spark, d, "embeddings").select("vec_id", scalars.l2_normalize(F.col("embedding")).alias("v"))
    coded = vq.encode(u.withColumn("norm", scalars.dot(F.col("v"), F.col("v"))), "vec_id", "v", _books(u), keep=("norm",))
    g = coded.agg(*[F.avg(F.element_at("losses", k)).alias(str(k)) for k in (1, 2, 3)], F.avg(F.element_at("losses", 3)).alias("total"), F.avg("norm").alias("norm")).withColumn("normalized", F.col("total") / (F.col("norm") + 1e-8))
    return g.select(F.explode(F.array(*[F.struct(F.lit(c).alias("part"), F.round(F.col(f"`{c}`"), 6).alias("loss")) for c in g.columns])).alias("r")).select("r.*")


def inputs(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    return Inputs(vectors=e, sids=sids(spark, d), behavior=behavior(spark, d).where("action_bitmap > 0"), impressions=behavior_v2(spark, d))


@query()
def m_evaluate(spark, d):
    """Every registered metric over the tables at hand: value, quality, or why there is none."""
    return evaluate(inputs(spark, d), list(METRICS))


QUERIES, SQL = Q, S
