"""Queries of the training-data problems and their SQL oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import scratch
from ..util import table
from .cooccur import cooccurrence
from .density import density_clusters, describe_clusters
from .frequent import frequent_items, latest_targets
from .leakage import leaked_passages
from .neighbors import similar_items
from .packing import WINDOW, pack_documents
from .residue import read_messages, residue_records, template_verdicts
from .vectors import latest_vectors


def _acted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "behavior_v2").where("action_bitmap > 0").select("uid", "session_id", "iid")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cooccurrence(_acted(spark, sf_dir), ["uid", "session_id"], "iid", min_count=8, min_lift=10).select("iid_a", "iid_b")


def _significant(spark: SparkSession, sf_dir: str, min_count: int) -> DataFrame:
    pairs = cooccurrence(_acted(spark, sf_dir), ["uid", "session_id"], "iid", min_count=min_count)
    return pairs.select("iid_a", "iid_b", "n_ab", "n_a", "n_b", F.round("lift", 6).alias("lift"), F.round("llr", 4).alias("llr")).where("llr >= 10.83")


def p2_pair_significance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every significant pair, however few baskets have it."""
    return _significant(spark, sf_dir, 1)


def _vectors(spark: SparkSession, sf_dir: str, extra: str | None = None) -> DataFrame:
    return latest_vectors(table(spark, sf_dir, "results"), "content_id", "embedding", "encoded_at", 128, extra)


def p3_similar_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_items(_vectors(spark, sf_dir), 5).withColumn("cosine", F.round("cosine", 5))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = similar_items(_vectors(spark, sf_dir), 5).where("cosine >= 0.95")
    return near.select(F.least("content_id", "neighbor_id").alias("content_a"), F.greatest("content_id", "neighbor_id").alias("content_b")).distinct()


def _frequent(spark: SparkSession, sf_dir: str, share: float) -> DataFrame:
    targets = scratch.keep(latest_targets(table(spark, sf_dir, "sequences")), "targets")
    return frequent_items(targets, "item", share)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _frequent(spark, sf_dir, 1 / 200).select(F.col("item").alias("target_cid"))


def p4_item_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _frequent(spark, sf_dir, 1 / 500).select(F.col("item").alias("target_cid"), "n", F.round(F.col("n") / F.col("n_total"), 9).alias("share"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = density_clusters(_vectors(spark, sf_dir, "semantic_id"), 0.7)
    large = members.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n")).where("n >= 3")
    return members.join(large, "cluster_id", "left_semi").select("cluster_id", "content_id")


def p5_cluster_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = density_clusters(_vectors(spark, sf_dir, "semantic_id"), 0.7)
    return describe_clusters(members).withColumn("agreement", F.round("agreement", 6))


def p6_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack_documents(table(spark, sf_dir, "documents"), "doc_id", "text")
    return packed.select(F.col("key").alias("doc_id"), "piece", "start", "n_tokens", "window_id", "place")


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well the windows are filled."""
    windows = p6_windows(spark, sf_dir).where("window_id IS NOT NULL")
    found = windows.agg(F.count_distinct("window_id").alias("windows"), F.sum("n_tokens").alias("tokens"), F.count_distinct("doc_id").alias("texts"))
    return found.withColumn("fill", F.round(F.col("tokens") / (F.col("windows") * WINDOW), 6))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked_passages(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "eval_passages"), "item_id", "passage")


def p7_leaks_per_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every evaluation item with the number of documents that hold it."""
    items = table(spark, sf_dir, "eval_passages").select("item_id", "suite").distinct()
    hits = p7_found(spark, sf_dir).groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    return items.join(hits, "item_id", "left").select("item_id", "suite", F.coalesce("n", F.lit(0)).alias("n_docs"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue_records(table(spark, sf_dir, "documents"), "doc_id", "text").where("residue").select("doc_id")


def p8_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every template with a verdict: what decided it, and how often it stands in the texts."""
    read = read_messages(table(spark, sf_dir, "documents"), "doc_id", "text")
    return template_verdicts(read).groupBy("template", "verdict").agg(F.sum("messages").alias("messages"))


QUERIES = {
    "p2_found": p2_found,
    "p2_pair_significance": p2_pair_significance,
    "p3_found": p3_found,
    "p3_similar_items": p3_similar_items,
    "p4_found": p4_found,
    "p4_item_freq": p4_item_freq,
    "p5_found": p5_found,
    "p5_cluster_profiles": p5_cluster_profiles,
    "p6_windows": p6_windows,
    "p6_fill": p6_fill,
    "p7_found": p7_found,
    "p7_leaks_per_item": p7_leaks_per_item,
    "p8_found": p8_found,
    "p8_templates": p8_templates,
}

_PAIRS = r"""
WITH b AS (SELECT DISTINCT uid, session_id, lower(trim(iid, E' \t\r\n')) AS iid FROM behavior_v2
           WHERE uid IS NOT NULL AND session_id IS NOT NULL AND iid IS NOT NULL AND action_bitmap > 0),
n AS (SELECT count(*) AS n FROM (SELECT DISTINCT uid, session_id FROM b)),
c AS (SELECT iid, count(*) AS n_x FROM b GROUP BY iid),
k AS (SELECT b.uid, b.session_id, b.iid FROM b JOIN c USING (iid) WHERE n_x >= {least}),
p AS (SELECT x.iid AS iid_a, y.iid AS iid_b, count(*) AS n_ab FROM k x JOIN k y ON x.uid = y.uid AND x.session_id = y.session_id AND x.iid < y.iid
      GROUP BY ALL HAVING count(*) >= {least}),
q AS (SELECT p.*, ca.n_x AS n_a, cb.n_x AS n_b, n.n AS n, n_ab::DOUBLE * n.n / (ca.n_x::DOUBLE * cb.n_x) AS lift
      FROM p JOIN c ca ON ca.iid = iid_a JOIN c cb ON cb.iid = iid_b CROSS JOIN n)
"""

_TARGETS = r"""
WITH l AS (SELECT uid, eval_cids FROM sequences WHERE uid IS NOT NULL
           QUALIFY row_number() OVER (PARTITION BY uid ORDER BY built_at DESC NULLS LAST, eval_cids DESC NULLS LAST) = 1),
t AS (SELECT lower(trim(e, E' \t\r\n')) AS item FROM (SELECT unnest(eval_cids) AS e FROM l) WHERE e IS NOT NULL),
f AS (SELECT item, count(*) AS n FROM t WHERE item <> '' GROUP BY item),
s AS (SELECT sum(n)::BIGINT AS total FROM f)
"""

SQL = {
    "p4_found": _TARGETS + "SELECT item AS target_cid FROM f, s WHERE n * 200 >= total",
    "p4_item_freq": _TARGETS + "SELECT item AS target_cid, n, round(n / total::DOUBLE, 9) AS share FROM f, s WHERE n * 500 >= total",
    "p2_found": _PAIRS.replace("{least}", "8") + "SELECT iid_a, iid_b FROM q WHERE lift >= 10",
    "p2_pair_significance": _PAIRS.replace("{least}", "1")
    + """, l AS (SELECT iid_a, iid_b, n_ab, n_a, n_b, round(lift, 6) AS lift, round(greatest(0, 2 * (
  n_ab * ln(n_ab::DOUBLE * n / (n_a::DOUBLE * n_b))
  + CASE WHEN n_a > n_ab THEN (n_a - n_ab) * ln((n_a - n_ab)::DOUBLE * n / (n_a::DOUBLE * (n - n_b))) ELSE 0 END
  + CASE WHEN n_b > n_ab THEN (n_b - n_ab) * ln((n_b - n_ab)::DOUBLE * n / ((n - n_a)::DOUBLE * n_b)) ELSE 0 END
  + CASE WHEN n - n_a - n_b + n_ab > 0 THEN (n - n_a - n_b + n_ab) * ln((n - n_a - n_b + n_ab)::DOUBLE * n / ((n - n_a)::DOUBLE * (n - n_b))) ELSE 0 END)), 4) AS llr FROM q)
SELECT * FROM l WHERE llr >= 10.83""",
}

# all pairs, for small tables
_UNIT = r"""
WITH RECURSIVE l AS (SELECT content_id, embedding::DOUBLE[] AS v, semantic_id FROM (
  SELECT lower(trim(content_id, E' \t\r\n')) AS content_id, embedding, semantic_id, encoded_at FROM results WHERE content_id IS NOT NULL AND len(embedding) = 128)
  WHERE content_id <> '' AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
  QUALIFY row_number() OVER (PARTITION BY content_id ORDER BY encoded_at DESC NULLS LAST) = 1),
u AS (SELECT content_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM l),
p AS MATERIALIZED (SELECT x.content_id AS a, y.content_id AS b, list_dot_product(x.v, y.v) AS s FROM u x JOIN u y ON x.content_id <> y.content_id)
"""

SQL["p3_found"] = _UNIT + "SELECT DISTINCT least(a, b) AS content_a, greatest(a, b) AS content_b FROM (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5) WHERE s >= 0.95"
SQL["p5_found"] = (
    _UNIT
    + """, e AS MATERIALIZED (SELECT a, b FROM p WHERE s >= 0.7), r AS (SELECT content_id AS x, content_id AS root FROM l UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.x),
m AS (SELECT x AS content_id, min(root) AS cluster_id FROM r GROUP BY x)
SELECT cluster_id, content_id FROM m QUALIFY count(*) OVER (PARTITION BY cluster_id) >= 3"""
)
