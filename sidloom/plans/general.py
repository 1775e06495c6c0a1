"""Queries of problem 1: results per key where a few keys hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.skew import latest_sids, prefix_stats
from ..util import table


def p1_prefix_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = prefix_stats(latest_sids(table(spark, sf_dir, "sid_map")))
    return s.select("depth", "prefix", "n_items", "n_sids", "first_item", F.round(F.col("n_items") / F.col("n_total"), 9).alias("share"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = prefix_stats(latest_sids(table(spark, sf_dir, "sid_map")))
    return s.where("n_items * 50 >= n_total").select("depth", "prefix")


QUERIES = {"p1_found": p1_found, "p1_prefix_stats": p1_prefix_stats}

_STATS = r"""
WITH v AS (
  SELECT lower(trim(content_id, E' \t\r\n')) AS content_id, assigned_at,
         regexp_extract(sid, '^[ \t\r\n]*0*([0-9]{1,3})[ \t\r\n]*_[ \t\r\n]*0*([0-9]{1,3})[ \t\r\n]*_[ \t\r\n]*0*([0-9]{1,3})[ \t\r\n]*$', ['a','b','c']) AS m
  FROM sid_map WHERE content_id IS NOT NULL AND sid IS NOT NULL),
w AS (SELECT content_id, assigned_at, try_cast(m.a AS INT) AS a, try_cast(m.b AS INT) AS b, try_cast(m.c AS INT) AS c FROM v WHERE m.a <> '' AND content_id <> ''),
u AS (SELECT content_id, a, b, c FROM w WHERE a <= 255 AND b <= 255 AND c <= 255
      QUALIFY row_number() OVER (PARTITION BY content_id ORDER BY assigned_at DESC NULLS LAST, a DESC, b DESC, c DESC) = 1),
p AS (SELECT content_id, a||'_'||b||'_'||c AS sid, 1::INT AS depth, a::VARCHAR AS prefix FROM u
      UNION ALL SELECT content_id, a||'_'||b||'_'||c, 2::INT, a||'_'||b FROM u
      UNION ALL SELECT content_id, a||'_'||b||'_'||c, 3::INT, a||'_'||b||'_'||c FROM u),
s AS (SELECT depth, prefix, count(*) AS n_items, count(DISTINCT sid) AS n_sids, min(content_id) AS first_item FROM p GROUP BY ALL)
"""

SQL = {
    "p1_found": _STATS + "SELECT depth, prefix FROM s WHERE n_items * 50 >= (SELECT count(*) FROM u)",
    "p1_prefix_stats": _STATS + "SELECT depth, prefix, n_items, n_sids, first_item, round(n_items / (SELECT count(*) FROM u)::DOUBLE, 9) AS share FROM s",
}
