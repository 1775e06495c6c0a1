"""Domain tables that the queries share, as DataFrames and as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.skew import latest_sids
from ..util import item_key, table


def behavior_v2(spark: SparkSession, d: str) -> DataFrame:
    """Session-grain behavior without repeated deliveries and missing keys."""
    return (
        table(spark, d, "behavior_v2")
        .where("uid IS NOT NULL AND session_id IS NOT NULL AND iid IS NOT NULL")
        .select("uid", "session_id", item_key("iid").alias("iid"), "action_bitmap", F.coalesce("first_ts", F.lit(0)).alias("first_ts"), "last_ts", "event_cnt")
        .distinct()
    )


def behavior(spark: SparkSession, d: str) -> DataFrame:
    """One row per user and item: OR of the bits, first and last time, events."""
    return (
        behavior_v2(spark, d)
        .groupBy("uid", "iid")
        .agg(F.bit_or("action_bitmap").alias("action_bitmap"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"), F.sum("event_cnt").alias("event_cnt"))
    )


def sids(spark: SparkSession, d: str) -> DataFrame:
    return latest_sids(table(spark, d, "sid_map")).withColumn("sid", F.concat_ws("_", "a", "b", "c"))


def ratings(spark: SparkSession, d: str) -> DataFrame:
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    return o.join(li, o["o_orderkey"] == li["l_orderkey"]).select(
        F.col("o_custkey").alias("uid"),
        F.col("l_partkey").alias("mid"),
        F.unix_timestamp("o_orderdate").alias("ts"),
        (1 + F.floor(F.col("l_quantity") / 10.001)).cast("int").alias("rating"),
        F.col("l_orderkey").alias("okey"),
        F.col("l_linenumber").alias("lno"),
    )


def movies(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("mid"), F.col("p_name").alias("title"), F.concat_ws("|", "p_type", "p_brand").alias("genres"))


def interactions(spark: SparkSession, d: str) -> DataFrame:
    bit = {"view": 65536, "click": 1, "signup": 8, "purchase": 262144, "error": -2147483648}
    pairs = [F.lit(x) for k, v in bit.items() for x in (k, v)]
    return table(spark, d, "events").select(
        F.col("user_id").alias("uid"), F.get_json_object("props", "$.k").cast("int").alias("iid"), F.unix_timestamp("ts").alias("ts"), F.create_map(*pairs)[F.col("event_type")].alias("bit"), "event_id"
    )


# The same tables in SQL; each may use those before it.
CTES = {
    "b2": r"""SELECT DISTINCT uid, session_id, lower(trim(iid, E' \t\r\n')) AS iid, action_bitmap, coalesce(first_ts, 0) AS first_ts, last_ts, event_cnt
 FROM behavior_v2 WHERE uid IS NOT NULL AND session_id IS NOT NULL AND iid IS NOT NULL""",
    "beh": "SELECT uid, iid, bit_or(action_bitmap)::INT AS action_bitmap, min(first_ts)::BIGINT AS first_ts, max(last_ts)::BIGINT AS last_ts, sum(event_cnt)::BIGINT AS event_cnt FROM b2 GROUP BY uid, iid",
    "sidv": r"""SELECT lower(trim(content_id, E' \t\r\n')) AS content_id, assigned_at,
 regexp_extract(sid, '^[ \t\r\n]*0*([0-9]{1,3})[ \t\r\n]*_[ \t\r\n]*0*([0-9]{1,3})[ \t\r\n]*_[ \t\r\n]*0*([0-9]{1,3})[ \t\r\n]*$', ['a','b','c']) AS m
 FROM sid_map WHERE content_id IS NOT NULL AND sid IS NOT NULL""",
    "sidw": "SELECT content_id, assigned_at, try_cast(m.a AS INT) AS a, try_cast(m.b AS INT) AS b, try_cast(m.c AS INT) AS c FROM sidv WHERE m.a <> '' AND content_id <> ''",
    "sid": """SELECT content_id, a, b, c, a||'_'||b||'_'||c AS sid FROM sidw WHERE a <= 255 AND b <= 255 AND c <= 255
 QUALIFY row_number() OVER (PARTITION BY content_id ORDER BY assigned_at DESC NULLS LAST, a DESC, b DESC, c DESC) = 1""",
    "ratings": """SELECT o_custkey AS uid, l_partkey AS mid, epoch(o_orderdate)::BIGINT AS ts, (1 + floor(l_quantity / 10.001))::INT AS rating,
 l_orderkey AS okey, l_linenumber AS lno FROM orders JOIN lineitem ON o_orderkey = l_orderkey""",
    "movies": "SELECT p_partkey AS mid, p_name AS title, p_type || '|' || p_brand AS genres FROM part",
    "inter": """SELECT user_id AS uid, json_extract_string(props, '$.k')::INT AS iid, floor(epoch(ts))::BIGINT AS ts, event_id,
 CASE event_type WHEN 'view' THEN 65536 WHEN 'click' THEN 1 WHEN 'signup' THEN 8 WHEN 'purchase' THEN 262144 WHEN 'error' THEN -2147483648 END::INT AS bit FROM events""",
}
_NEEDS = {"beh": ["b2"], "sid": ["sidv", "sidw"]}


def sql(select: str, *ctes: str, **own: str) -> str:
    """``select`` with the named shared tables, then its own, as WITH clauses."""
    names: list[str] = []
    for c in ctes:
        names += [x for x in (*_NEEDS.get(c, []), c) if x not in names]
    parts = [f"{n} AS ({CTES[n]})" for n in names] + [f"{n} AS ({s})" for n, s in own.items()]
    return (f"WITH {', '.join(parts)} " if parts else "") + select
