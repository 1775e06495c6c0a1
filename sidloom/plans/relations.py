"""Joins, aggregations, windows, sorts and set operations (inventory 2.3 to 2.7)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import scratch
from ..functions import bits, scalars
from ..operators import relate
from ..operators import sequences as seq
from ..util import item_key, table
from .base import behavior, behavior_v2, interactions, movies, ratings, sids, sql

Q: dict = {}
S: dict = {}
ORD = ["ts", "okey", "lno", "mid"]
_ORD = "ts, okey, lno, mid"


def query(oracle: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if oracle:
            S[f.__name__] = oracle
        return f

    return add


def liked(spark, d):
    return ratings(spark, d).where("rating >= 4")


LIKED = "SELECT * FROM ratings WHERE rating >= 4"
ORDERED = f"SELECT *, row_number() OVER (PARTITION BY uid ORDER BY {_ORD}) AS rn, count(*) OVER (PARTITION BY uid) AS n FROM ratings WHERE rating >= 4"
RI = r"SELECT lower(trim(content_id, E' \t\r\n')) AS content_id, semantic_id FROM results WHERE content_id IS NOT NULL"

# --- joins -------------------------------------------------------------------


@query(r"SELECT d.doc_id, d.lang FROM documents d WHERE lower(trim(d.content_id, E' \t\r\n')) IN (SELECT lower(trim(iid, E' \t\r\n')) FROM behavior_v2 WHERE iid IS NOT NULL)")
def join_content_exposed(spark, d):
    exposed = table(spark, d, "behavior_v2").select(item_key("iid").alias("k")).distinct()
    return table(spark, d, "documents").withColumn("k", item_key("content_id")).join(exposed, "k").select("doc_id", "lang")


@query("WITH u AS (SELECT content_id, unnest(images) AS image FROM pinned_content) SELECT content_id, image, CASE WHEN length(image) % 2 = 0 THEN 's3://images/' || md5(image) END AS path FROM u")
def join_url_map(spark, d):
    u = table(spark, d, "pinned_content").select("content_id", F.explode("images").alias("image"))
    known = u.select("image").distinct().where(F.length("image") % 2 == 0).withColumn("path", F.concat(F.lit("s3://images/"), F.md5("image")))
    return u.join(known, "image", "left").select("content_id", "image", "path")


@query(sql("SELECT uid, iid, a, b, c FROM beh JOIN sid ON iid = content_id", "beh", "sid"))
def join_item_sid(spark, d):
    return behavior(spark, d).join(sids(spark, d), F.col("iid") == F.col("content_id")).select("uid", "iid", "a", "b", "c")


@query(
    sql(
        """SELECT p.uid, p.session_id, p.iid, p.first_ts, p.last_ts, p.event_cnt, array_to_string(list_resize(list_slice(list_transform(list_filter(coalesce(n.neg, []), lambda x: x.iid <> p.iid), lambda x: x.a), 1, 5), 5, -1), ',') AS neg_l0
 FROM b2 p SEMI JOIN sid ON p.iid = sid.content_id LEFT JOIN neg n ON p.uid = n.uid AND p.session_id = n.session_id WHERE p.action_bitmap > 0""",
        "b2",
        "sid",
        neg="SELECT uid, session_id, list_sort(list(DISTINCT {'iid': iid, 'a': a})) AS neg FROM b2 JOIN sid ON iid = content_id WHERE action_bitmap = 0 GROUP BY uid, session_id",
    )
)
def join_neg_session(spark, d):
    got = seq.session_negatives(behavior_v2(spark, d), sids(spark, d))
    return got.select("uid", "session_id", "iid", "first_ts", "last_ts", "event_cnt", F.array_join(F.col("neg_l0").cast("array<string>"), ",").alias("neg_l0"))


@query(sql("SELECT uid, session_id, count(*) AS n_negatives, sum(a)::BIGINT AS total FROM (SELECT DISTINCT uid, session_id, iid, a FROM b2 JOIN sid ON iid = content_id WHERE action_bitmap = 0) GROUP BY uid, session_id", "b2", "sid"))
def join_neg_inline(spark, d):
    """Negatives that are already an array: explode, look up, collect again."""
    inline = behavior_v2(spark, d).where("action_bitmap = 0").groupBy("uid", "session_id").agg(F.collect_set("iid").alias("neg_iids"))
    known = inline.select("uid", "session_id", F.explode("neg_iids").alias("content_id")).join(sids(spark, d), "content_id")
    return known.groupBy("uid", "session_id").agg(F.count(F.lit(1)).alias("n_negatives"), F.sum("a").alias("total"))


@query(sql("SELECT DISTINCT iid FROM b2 WHERE iid NOT IN (SELECT content_id FROM sid)", "b2", "sid"))
def anti_cached(spark, d):
    return behavior_v2(spark, d).select("iid").distinct().join(sids(spark, d), F.col("iid") == F.col("content_id"), "left_anti")


@query(
    sql(
        "SELECT count(*) AS exposed, count(*) FILTER (iid IN (SELECT content_id FROM sid)) AS covered, round(100.0 * count(*) FILTER (iid IN (SELECT content_id FROM sid)) / count(*), 6) AS pct FROM e",
        "b2",
        "sid",
        e="SELECT DISTINCT iid FROM b2",
    )
)
def set_coverage(spark, d):
    e = behavior_v2(spark, d).select("iid").distinct().join(sids(spark, d).select(F.col("content_id").alias("iid"), F.lit(1).alias("hit")), "iid", "left")
    return e.agg(F.count(F.lit(1)).alias("exposed"), F.count("hit").alias("covered")).withColumn("pct", F.round(100.0 * F.col("covered") / F.col("exposed"), 6))


_COUSER = "SELECT a.mid AS item_a, b.mid AS item_b, count(DISTINCT a.uid) AS users FROM l a JOIN l b ON a.uid = b.uid AND a.mid <> b.mid GROUP BY ALL"


@query(sql("SELECT item_a, count(*) AS neighbors FROM (" + _COUSER + ") GROUP BY item_a", "ratings", l="SELECT DISTINCT uid, mid FROM ratings WHERE rating >= 5"))
def self_cooccur(spark, d):
    pairs = relate.all_user_pairs(ratings(spark, d).where("rating >= 5"), "uid", "mid").distinct()
    both = pairs.unionByName(pairs.select(F.col("item_b").alias("item_a"), F.col("item_a").alias("item_b")))
    return both.groupBy("item_a").agg(F.count(F.lit(1)).alias("neighbors"))


@query(
    sql(
        "SELECT DISTINCT least(mid, p) AS item_a, greatest(mid, p) AS item_b FROM w WHERE p IS NOT NULL AND p <> mid",
        "ratings",
        w=f"SELECT mid, lag(mid) OVER (PARTITION BY uid ORDER BY {_ORD}) AS p FROM ratings WHERE rating >= 4",
    )
)
def self_adjacent(spark, d):
    return relate.adjacent_pairs(liked(spark, d), "uid", "mid", ORD)


_SWING = "SELECT a.mid AS item_a, b.mid AS item_b, round(sum(1.0::DOUBLE / (5.0 + a.n)), 6) AS score FROM u a JOIN u b ON a.uid = b.uid AND a.mid < b.mid GROUP BY ALL"
_SWING_U = "SELECT uid, mid, count(*) OVER (PARTITION BY uid) AS n FROM (SELECT uid, mid FROM (SELECT DISTINCT uid, mid FROM ratings WHERE rating >= 5) QUALIFY count(*) OVER (PARTITION BY mid) >= 2) QUALIFY n <= 200"


@query(sql("SELECT item_a, item_b, score FROM (" + _SWING + ")", "ratings", u=_SWING_U))
def self_swing(spark, d):
    return relate.swing(ratings(spark, d).where("rating >= 5"), "uid", "mid").withColumn("score", F.round("score", 6))


@query(
    sql(
        "SELECT a.mid AS a, b.mid AS b, round(sum(1.0::DOUBLE / abs(b.rn - a.rn)), 6) AS weight FROM o a JOIN o b ON a.uid = b.uid AND b.rn <> a.rn AND abs(b.rn - a.rn) <= 5 GROUP BY ALL",
        "ratings",
        o=ORDERED,
    )
)
def self_window_cooccur(spark, d):
    return _window_weights(spark, d)


_BOTH = ("1.0::DOUBLE / (b.rn - a.rn)", "1.0::DOUBLE / abs(b.rn - a.rn)"), ("b.rn > a.rn AND b.rn - a.rn <= 5", "b.rn <> a.rn AND abs(b.rn - a.rn) <= 5"), (" HAVING sum(1.0::DOUBLE / abs(b.rn - a.rn)) >= 1.5", "")


def _both_ways(oracle):
    for old, new in _BOTH:
        oracle = oracle.replace(old, new)
    return oracle


def _window_weights(spark, d):
    """Weights of items within 5 places before or after, whatever they sum to."""
    w = relate.band_pairs(seq.ordered(liked(spark, d), "uid", ORD), "uid", "mid", "rn", 5)
    both = w.unionByName(w.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight"))
    return both.groupBy("a", "b").agg(F.round(F.sum("weight"), 6).alias("weight"))


@query(sql("SELECT content_id, count(*) OVER (PARTITION BY a, b) - 1 AS neighbors FROM sid", "sid"))
def join_prefix_neighbors(spark, d):
    """How many other items share the first two codes, without forming the pairs."""
    s = sids(spark, d)
    n = s.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    return s.join(n, ["a", "b"]).select("content_id", (F.col("n") - 1).alias("neighbors"))


@query(
    sql(
        "SELECT s.content_id, round(coalesce(p3.score, p2.score * 0.5, p1.score * 0.25, 0.0)::DOUBLE, 6) AS score FROM k s LEFT JOIN p3 ON p3.prefix = s.sid LEFT JOIN p2 ON p2.prefix = s.ab LEFT JOIN p1 ON p1.prefix = s.aa",
        "sid",
        "b2",
        k="SELECT content_id, sid, a || '_' || b AS ab, a::VARCHAR AS aa FROM sid",
        x="SELECT k.* FROM k SEMI JOIN (SELECT iid FROM b2 WHERE action_bitmap > 0) y ON y.iid = k.content_id",
        p3="SELECT sid AS prefix, count(*)::DOUBLE AS score FROM x GROUP BY sid",
        p2="SELECT ab AS prefix, count(*)::DOUBLE AS score FROM x GROUP BY ab",
        p1="SELECT aa AS prefix, count(*)::DOUBLE AS score FROM x GROUP BY aa",
    )
)
def join_prefix_fallback(spark, d):
    """For every item the number of acted-on items of its SID, or of the longest prefix that has any, halved per code."""
    s = sids(spark, d)
    x = s.join(behavior_v2(spark, d).where("action_bitmap > 0").select(F.col("iid").alias("content_id")).distinct(), "content_id", "left_semi")
    levels = F.inline(F.array(*[F.struct(F.lit(k).alias("depth"), F.concat_ws("_", *"abc"[:k]).alias("prefix")) for k in (3, 2, 1)]))
    scores = x.select(levels).groupBy("depth", "prefix").agg(F.count(F.lit(1)).cast("double").alias("score"))
    return relate.prefix_lookup(s, scores, ["a", "b", "c"]).select("content_id", F.round("score", 6).alias("score"))


@query(
    sql(
        "SELECT q, content_id, row_number() OVER (PARTITION BY q ORDER BY rank, freq DESC, content_id) AS pos FROM x QUALIFY pos <= 20",
        "sid",
        "b2",
        f="SELECT iid, count(*) AS freq FROM b2 GROUP BY iid",
        r="SELECT a AS q, sid, row_number() OVER (PARTITION BY a ORDER BY count(*) DESC, sid) AS rank FROM sid GROUP BY a, sid QUALIFY rank <= 10",
        x="SELECT r.q, r.rank, s.content_id, coalesce(f.freq, 0) AS freq FROM r JOIN sid s USING (sid) LEFT JOIN f ON f.iid = s.content_id",
    )
)
def join_sid_expand(spark, d):
    """Ranked SIDs to their items, the first 20 a query."""
    s = sids(spark, d)
    ranked = s.groupBy(F.col("a").alias("q"), "sid").agg(F.count(F.lit(1)).alias("c"))
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("c"), "sid"))).where("rank <= 10")
    freq = behavior_v2(spark, d).groupBy(F.col("iid").alias("content_id")).agg(F.count(F.lit(1)).alias("freq"))
    x = ranked.join(s.select("sid", "content_id"), "sid").join(freq, "content_id", "left").withColumn("freq", F.coalesce("freq", F.lit(0)))
    pos = F.row_number().over(Window.partitionBy("q").orderBy("rank", F.desc("freq"), "content_id"))
    return x.withColumn("pos", pos).where("pos <= 20").select("q", "content_id", F.col("pos").cast("bigint").alias("pos"))


@query(
    """WITH v AS (SELECT vec_id, embedding, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings), q AS (SELECT * FROM v WHERE vec_id % 50 = 0)
SELECT q.vec_id AS q, v.vec_id AS c, round(list_dot_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) / (q.n * v.n), 5) AS cosine FROM q JOIN v ON q.vec_id <> v.vec_id
QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY list_dot_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) / (q.n * v.n) DESC, v.vec_id) <= 10"""
)
def cross_topk(spark, d):
    from ..operators.vectors import topk_cosine

    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return topk_cosine(e.where("id % 50 = 0"), e, 10).select("q", "c", F.round("cosine", 5).alias("cosine"))


@query(
    """WITH e AS (SELECT vec_id, label, ('0x' || substr(sha256(vec_id::VARCHAR), 1, 8))::BIGINT AS h FROM embeddings), o AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY h, vec_id) AS rn FROM e)
SELECT a.vec_id AS id_a, b.vec_id AS id_b FROM o a JOIN o b ON a.label = b.label AND b.rn = a.rn + 1"""
)
def cross_sampled_pairs(spark, d):
    """Random pairs: neighbours in hash order inside a label, one a vector."""
    e = table(spark, d, "embeddings").withColumn("h", F.conv(F.substring(F.sha2(F.col("vec_id").cast("string"), 256), 1, 8), 16, 10).cast("bigint"))
    return e.select(F.col("vec_id").alias("id_a"), F.lead("vec_id").over(Window.partitionBy("label").orderBy("h", "vec_id")).alias("id_b")).where("id_b IS NOT NULL")


@query(
    sql(
        "SELECT q.sid AS q, s.sid AS c, ((q.a = s.a)::INT + (q.b = s.b)::INT + (q.c = s.c)::INT) AS same FROM q JOIN s ON q.sid <> s.sid AND (q.a = s.a OR q.b = s.b OR q.c = s.c) QUALIFY row_number() OVER (PARTITION BY q.sid ORDER BY same DESC, s.sid) <= 5",
        "sid",
        s="SELECT DISTINCT sid, a, b, c FROM sid",
        q="SELECT * FROM s WHERE (a * 65536 + b * 256 + c) % 50 = 0",
    )
)
def cross_hamming(spark, d):
    """The five SIDs that agree with a query SID in most digits, ties to the smaller.

    SIDs with two equal digits come from joins on two digits, which have at
    most 256 rows a key. Those with one follow by their name alone, so the
    first ten of a digit are all that a query can need.
    """
    s = scratch.keep(sids(spark, d).select("sid", "a", "b", "c").distinct(), "sids")
    q = s.where("(a * 65536 + b * 256 + c) % 50 = 0").withColumnRenamed("sid", "q")
    digits = F.posexplode(F.array("a", "b", "c"))
    pairs = F.posexplode(F.array(F.concat_ws("_", "a", "b"), F.concat_ws("_", "a", "c"), F.concat_ws("_", "b", "c")))
    two = q.select("q", pairs).join(s.select(F.col("sid").alias("c"), pairs), ["pos", "col"]).select("q", "c").distinct()
    first = Window.partitionBy("pos", "col").orderBy("c")
    few = s.select(F.col("sid").alias("c"), digits).withColumn("r", F.row_number().over(first)).where("r <= 10").drop("r")
    one = q.select("q", digits).join(few, ["pos", "col"]).select("q", "c").distinct()
    codes = lambda x: F.split(x, "_")
    same = F.aggregate(F.zip_with(codes(F.col("q")), codes(F.col("c")), lambda x, y: (x == y).cast("int")), F.lit(0), lambda a, x: a + x)
    met = two.unionByName(one).distinct().where("q <> c").withColumn("same", same)
    return met.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("same"), "c"))).where("r <= 5").drop("r")


_CFG = {"r1": {"lr": "0.1", "dim": "64", "layers": "3", "seed": "1"}, "r2": {"lr": "0.1", "dim": "128", "layers": "3"}, "r3": {"lr": "0.2", "dim": "32", "layers": "4", "tau": "9"}, "r4": {"lr": "0.1", "dim": "64", "layers": "3", "seed": "2"}}
_CFG_SQL = "SELECT * FROM (VALUES " + ", ".join(f"('{r}', '{k}', '{v}')" for r, c in _CFG.items() for k, v in c.items()) + ") t(run, key, value)"


def configs(spark):
    return spark.createDataFrame([(r, k, v) for r, c in _CFG.items() for k, v in c.items()], "run string, key string, value string")


@query(
    sql(
        "SELECT coalesce(a.key, b.key) AS key, a.value AS value_a, b.value AS value_b FROM (SELECT * FROM c WHERE run = 'r1') a FULL JOIN (SELECT * FROM c WHERE run = 'r3') b USING (key) WHERE a.value IS DISTINCT FROM b.value",
        c=_CFG_SQL,
    )
)
def join_config_diff(spark, d):
    c = configs(spark)
    return relate.config_diff(c.where("run = 'r1'"), c.where("run = 'r3'"))


@query(
    sql(
        "SELECT r.run, count(*) FILTER (r.v IS DISTINCT FROM q.v) AS n_diffs FROM (SELECT x.run, k.key, c.value AS v FROM (SELECT DISTINCT run FROM c WHERE run <> 'r1') x CROSS JOIN (SELECT DISTINCT key FROM c) k LEFT JOIN c ON c.run = x.run AND c.key = k.key) r LEFT JOIN (SELECT key, value AS v FROM c WHERE run = 'r1') q USING (key) GROUP BY r.run ORDER BY n_diffs, r.run LIMIT 5",
        c=_CFG_SQL,
    )
)
def topk_similar_configs(spark, d):
    from ..operators.registry import similar_configs

    return similar_configs(configs(spark), "r1", 5)


@query(
    "WITH r AS (SELECT l_returnflag || l_linestatus AS run, round(avg(l_quantity), 4) AS ppl FROM lineitem GROUP BY 1), b AS (SELECT ppl FROM r WHERE run = 'AF') SELECT r.run, round(100.0 * (r.ppl - b.ppl) / nullif(b.ppl, 0), 4) AS delta FROM r LEFT JOIN b ON true"
)
def join_baseline(spark, d):
    from ..operators.registry import degradation

    runs = table(spark, d, "lineitem").groupBy(F.concat("l_returnflag", "l_linestatus").alias("run")).agg(F.round(F.avg("l_quantity"), 4).alias("ppl"))
    return degradation(runs, "run", "AF", ["ppl"]).select("run", F.round("ppl_delta", 4).alias("delta"))


# --- aggregations ------------------------------------------------------------


@query(sql("SELECT iid, count(DISTINCT uid) AS users FROM beh WHERE action_bitmap > 0 GROUP BY iid", "beh"))
def agg_item_user_sets(spark, d):
    """The size of each item's user set; users are counted, not collected, as an item may have most of them."""
    return behavior(spark, d).where("action_bitmap > 0").groupBy("iid").agg(F.count_distinct("uid").alias("users"))


@query(sql("SELECT uid, count(*) FILTER (action_bitmap > 0) AS n_pos, count(*) FILTER (action_bitmap < 0) AS n_neg, array_to_string(list_sort(list(iid) FILTER (action_bitmap < 0)), ',') AS neg FROM beh GROUP BY uid HAVING count(*) FILTER (action_bitmap < 0) > 0", "beh"))
def agg_user_item_lists(spark, d):
    a = F.col("action_bitmap")
    g = behavior(spark, d).groupBy("uid").agg(F.count_if(a > 0).alias("n_pos"), F.count_if(a < 0).alias("n_neg"), F.array_join(F.array_sort(F.collect_list(F.when(a < 0, F.col("iid")))), ",").alias("neg"))
    return g.where("n_neg > 0")


@query(sql("SELECT iid, bit_or(action_bitmap)::INT AS bits, max(last_ts) AS last_ts FROM b2 GROUP BY iid", "b2"))
def agg_bitmap_or(spark, d):
    return behavior_v2(spark, d).groupBy("iid").agg(F.bit_or("action_bitmap").alias("bits"), F.max("last_ts").alias("last_ts"))


@query(
    sql(
        """SELECT count(*) AS users, sum(n)::BIGINT AS interactions, round(avg(n), 6) AS mean, quantile_cont(n, 0.5)::DOUBLE AS p50, quantile_cont(n, 0.95)::DOUBLE AS p95, max(n) AS most,
 round(100.0 * count(*) FILTER (n > 10) / count(*), 6) AS truncated_pct, round(100.0 * sum(greatest(n - 10, 0)) / sum(n), 6) AS lost_pct, count(*) FILTER (n >= 2) AS trainable FROM u""",
        "beh",
        u="SELECT uid, count(*) AS n FROM beh WHERE action_bitmap > 0 GROUP BY uid",
    )
)
def agg_user_stats(spark, d):
    u = behavior(spark, d).where("action_bitmap > 0").groupBy("uid").agg(F.count(F.lit(1)).alias("n"))
    n = F.col("n")
    return u.agg(
        F.count(F.lit(1)).alias("users"), F.sum("n").alias("interactions"), F.round(F.avg("n"), 6).alias("mean"), F.percentile("n", 0.5).alias("p50"), F.percentile("n", 0.95).alias("p95"), F.max("n").alias("most"),
        F.round(100.0 * F.count_if(n > 10) / F.count(F.lit(1)), 6).alias("truncated_pct"), F.round(100.0 * F.sum(F.greatest(n - 10, F.lit(0))) / F.sum(n), 6).alias("lost_pct"), F.count_if(n >= 2).alias("trainable"),
    )


@query("SELECT round(avg(n), 6) AS mean, floor(quantile_cont(n, 0.5))::BIGINT AS p50, floor(quantile_cont(n, 0.99))::BIGINT AS p99, max(n) AS most, count(*) FILTER (n > 50) AS truncated FROM (SELECT len(tokens) // 3 AS n FROM sequences WHERE tokens IS NOT NULL)")
def agg_seq_stats(spark, d):
    n = table(spark, d, "sequences").where("tokens IS NOT NULL").select(F.floor(F.size("tokens") / 3).alias("n"))
    return n.agg(F.round(F.avg("n"), 6).alias("mean"), F.percentile("n", 0.5).cast("bigint").alias("p50"), F.percentile("n", 0.99).cast("bigint").alias("p99"), F.max("n").alias("most"), F.count_if(F.col("n") > 50).alias("truncated"))


@query("SELECT count(*) FILTER (split_pos >= len(tokens)) AS train_only, count(*) FILTER (split_pos = 0) AS eval_only, count(*) FILTER (split_pos > 0 AND split_pos < len(tokens)) AS both_sides FROM sequences WHERE tokens IS NOT NULL")
def agg_split_counts(spark, d):
    s, n = F.col("split_pos"), F.size("tokens")
    return table(spark, d, "sequences").where("tokens IS NOT NULL").agg(F.count_if(s >= n).alias("train_only"), F.count_if(s == 0).alias("eval_only"), F.count_if((s > 0) & (s < n)).alias("both_sides"))


@query(sql(f"SELECT CASE WHEN action_bitmap < 0 THEN 'negative' WHEN action_bitmap & {sum(bits.STRONG)} <> 0 THEN 'strong' WHEN action_bitmap & {sum(bits.WEAK)} <> 0 THEN 'weak' ELSE 'neutral' END AS tier, count(*) AS n FROM b2 GROUP BY 1", "b2"))
def agg_tier_counts(spark, d):
    return behavior_v2(spark, d).groupBy(bits.tier(F.col("action_bitmap")).alias("tier")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, status")
def agg_status_counts(spark, d):
    return table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "status")


@query("SELECT create_date AS dt, count(*) AS n, count(*) FILTER (text IS NULL) AS null_texts, count(*) FILTER (source IS NULL) AS null_sources FROM documents GROUP BY 1")
def agg_day_verify(spark, d):
    return table(spark, d, "documents").groupBy(F.col("create_date").alias("dt")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("text").isNull()).alias("null_texts"), F.count_if(F.col("source").isNull()).alias("null_sources"))


@query(sql("SELECT iid, n, row_number() OVER (ORDER BY n DESC, iid) AS rank FROM (SELECT iid, count(*) AS n FROM b2 WHERE action_bitmap > 0 GROUP BY iid)", "b2"))
def agg_popularity(spark, d):
    """Frequency and rank of every item: places inside range partitions, plus the sizes of those before."""
    n = behavior_v2(spark, d).where("action_bitmap > 0").groupBy("iid").agg(F.count(F.lit(1)).alias("n"))
    cut = scratch.keep(n.repartitionByRange(F.desc("n"), "iid").withColumn("p", F.spark_partition_id()), "popularity")
    sizes = cut.groupBy("p").agg(F.count(F.lit(1)).alias("c"))
    first = sizes.select("p", (F.sum("c").over(Window.orderBy("p")) - F.col("c")).alias("skip"))
    place = F.row_number().over(Window.partitionBy("p").orderBy(F.desc("n"), "iid"))
    return cut.join(F.broadcast(first), "p").select("iid", "n", (place + F.col("skip")).cast("bigint").alias("rank"))


@query(r"SELECT iid, n, CASE WHEN n < 3 THEN 'cold' WHEN n < 10 THEN 'warm' ELSE 'hot' END AS bucket FROM (SELECT lower(trim(e, E' \t\r\n')) AS iid, count(*) AS n FROM (SELECT unnest(eval_cids) AS e FROM sequences) WHERE e IS NOT NULL GROUP BY 1) WHERE iid <> ''")
def agg_item_freq_bucket(spark, d):
    e = table(spark, d, "sequences").select(F.explode("eval_cids").alias("e")).select(item_key("e").alias("iid")).where("iid <> ''").groupBy("iid").agg(F.count(F.lit(1)).alias("n"))
    return e.withColumn("bucket", F.when(F.col("n") < 3, "cold").when(F.col("n") < 10, "warm").otherwise("hot"))


@query("SELECT label, pos - 1 AS pos, round(avg(x::DOUBLE), 5) AS mean FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY ALL")
def agg_sid_mean_embedding(spark, d):
    e = table(spark, d, "embeddings").select("label", F.posexplode("embedding"))
    return e.groupBy("label", F.col("pos").cast("bigint").alias("pos")).agg(F.round(F.avg(F.col("col").cast("double")), 5).alias("mean"))


@query(sql("SELECT max(a) + 1 AS size_1, max(b) + 1 AS size_2, max(c) + 1 AS size_3 FROM sid", "sid"))
def agg_codebook_sizes(spark, d):
    return sids(spark, d).agg(*[(F.max(x) + 1).alias(f"size_{i}") for i, x in enumerate("abc", 1)])


@query(sql("SELECT depth, a, b, c, n FROM (SELECT (3 - (grouping(b) + grouping(c)))::INT AS depth, a, b, c, count(*) AS n FROM sid GROUP BY GROUPING SETS ((a), (a, b), (a, b, c)))", "sid"))
def agg_sid_prefix_rollup(spark, d):
    s = sids(spark, d)
    rolled = s.groupingSets([["a"], ["a", "b"], ["a", "b", "c"]], "a", "b", "c").agg(F.count(F.lit(1)).alias("n"), (3 - (F.grouping("b") + F.grouping("c"))).cast("int").alias("depth"))
    return rolled.select("depth", "a", "b", "c", "n")


_HIST = "CASE WHEN k = 0 THEN '0' WHEN k <= 5 THEN '1-5' WHEN k <= 10 THEN '6-10' WHEN k <= 15 THEN '11-15' WHEN k <= 20 THEN '16-20' ELSE '21+' END"


@query(f"SELECT {_HIST} AS bucket, count(*) AS n, round(avg(k), 6) AS mean FROM (SELECT len(coalesce(eval_cids, [])) AS k FROM sequences) GROUP BY 1")
def agg_pref_histogram(spark, d):
    k = table(spark, d, "sequences").select(F.size(F.coalesce("eval_cids", F.array().cast("array<string>"))).alias("k"))
    b = F.when(F.col("k") == 0, "0").when(F.col("k") <= 5, "1-5").when(F.col("k") <= 10, "6-10").when(F.col("k") <= 15, "11-15").when(F.col("k") <= 20, "16-20").otherwise("21+")
    return k.groupBy(b.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("k"), 6).alias("mean"))


@query("SELECT l_shipdate::DATE AS day, count(*) FILTER (l_returnflag = 'A') AS a, count(*) FILTER (l_returnflag = 'N') AS n, count(*) FILTER (l_returnflag = 'R') AS r FROM lineitem GROUP BY 1")
def agg_status_summary(spark, d):
    p = table(spark, d, "lineitem").groupBy(F.to_date("l_shipdate").alias("day")).pivot("l_returnflag", ["A", "N", "R"]).agg(F.count(F.lit(1)))
    return p.select("day", *[F.coalesce(x, F.lit(0)).alias(x.lower()) for x in "ANR"])


_GRID = ("p_brand", "p_size", "p_type")
_MODES = ", ".join(f"(SELECT {c} FROM part GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1) AS m_{c}" for c in _GRID)


@query(f"WITH m AS (SELECT {_MODES}) " + " UNION ALL ".join(f"SELECT '{c}' AS vary, {c}::VARCHAR AS value, count(*) AS n, round(avg(p_retailprice), 4) AS price FROM part, m WHERE " + " AND ".join(f"{o} = m_{o}" for o in _GRID if o != c) + f" GROUP BY {c}" for c in _GRID))
def agg_grid_mode(spark, d):
    """For each parameter of a grid, its values where all other parameters have their most frequent value."""
    p, out = table(spark, d, "part"), None
    mode = {c: p.groupBy(c).agg(F.count(F.lit(1)).alias("k")).orderBy(F.desc("k"), c).limit(1).select(c) for c in _GRID}
    for c in _GRID:
        at = p
        for o in _GRID:
            at = at.join(F.broadcast(mode[o]), o, "left_semi") if o != c else at
        one = at.groupBy(F.col(c).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("p_retailprice"), 4).alias("price")).select(F.lit(c).alias("vary"), "value", "n", "price")
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT l_returnflag AS g, round(regr_slope(ln(l_extendedprice), ln(l_quantity)), 6) AS slope, round(regr_intercept(ln(l_extendedprice), ln(l_quantity)), 6) AS intercept FROM lineitem WHERE l_quantity > 0 AND l_extendedprice > 0 GROUP BY 1")
def agg_linreg_loglog(spark, d):
    x, y = F.log("l_quantity"), F.log("l_extendedprice")
    li = table(spark, d, "lineitem").where("l_quantity > 0 AND l_extendedprice > 0")
    return li.groupBy(F.col("l_returnflag").alias("g")).agg(F.round(F.regr_slope(y, x), 6).alias("slope"), F.round(F.regr_intercept(y, x), 6).alias("intercept"))


_PTS = [(7.0, 23.9), (14.0, 53.1), (31.0, 129.7), (62.0, 261.8), (66.0, 299.0)]
_PTS_SQL = "SELECT * FROM (VALUES " + ", ".join(f"({a}::DOUBLE, {b}::DOUBLE)" for a, b in _PTS) + ") t(x, y)"


@query(
    sql(
        """SELECT v, round(CASE WHEN v > 66 THEN 299.0 * v / 66 WHEN v < 7 THEN 23.9 * v / 7 ELSE (SELECT lo.y + (hi.y - lo.y) * (v - lo.x) / (hi.x - lo.x) FROM s lo JOIN s hi ON hi.rn = lo.rn + 1 WHERE v >= lo.x AND (v < hi.x OR (v = hi.x AND hi.x = 66)) LIMIT 1) END, 6) AS y
 FROM (SELECT unnest([3.0, 7.0, 10.0, 31.0, 50.0, 65.0, 90.0])::DOUBLE AS v)""",
        s="SELECT *, row_number() OVER (ORDER BY x) AS rn FROM (" + _PTS_SQL + ")",
    )
)
def agg_interp_tokens(spark, d):
    from ..operators.registry import interpolate

    at = spark.createDataFrame([(float(v),) for v in (3, 7, 10, 31, 50, 65, 90)], "v double")
    return interpolate(at, _PTS).select("v", F.round("y", 6).alias("y"))


_RUNS = [(f"r{i}", 10.0 ** (6 + i / 3), 10.0 ** (7 + (i % 4) / 2)) for i in range(9)]
_RUNS_SQL = "SELECT * FROM (VALUES " + ", ".join(f"('{r}', {p!r}::DOUBLE, {t!r}::DOUBLE)" for r, p, t in _RUNS) + ") t(run, params, tokens)"


@query(sql("SELECT arg_min(run, abs(ln(params) - ln(2e7)) + 0.3 * abs(ln(tokens) - ln(5e7))) AS run, count(*) AS runs FROM r", r=_RUNS_SQL))
def agg_nearest_run(spark, d):
    r = spark.createDataFrame(_RUNS, "run string, params double, tokens double")
    dist = F.abs(F.log("params") - F.log(F.lit(2e7))) + 0.3 * F.abs(F.log("tokens") - F.log(F.lit(5e7)))
    return r.agg(F.min_by("run", dist).alias("run"), F.count(F.lit(1)).alias("runs"))


_LAW = [(10.0 ** (5 + i / 2), 2.5 + 40.0 / (10.0 ** (5 + i / 2)) ** 0.3 + (0.002 if i % 2 else -0.002)) for i in range(9)]
_LAW_SQL = "SELECT * FROM (VALUES " + ", ".join(f"({a!r}::DOUBLE, {b!r}::DOUBLE)" for a, b in _LAW) + ") t(n, l)"


@query(
    sql(
        "SELECT round(alpha, 3) AS alpha, round(a, 4) AS a, round(b, 3) AS b FROM f ORDER BY sse, alpha LIMIT 1",
        p=_LAW_SQL,
        g="SELECT (i / 100.0)::DOUBLE AS alpha, n, l, pow(n, -(i / 100.0)::DOUBLE) AS x FROM range(5, 101) t(i), p",
        f="SELECT alpha, regr_intercept(l, x) AS a, regr_slope(l, x) AS b, regr_syy(l, x) - pow(regr_sxy(l, x), 2) / regr_sxx(l, x) AS sse FROM g GROUP BY alpha",
    )
)
def agg_power_law(spark, d):
    from ..operators.registry import power_law

    return power_law(spark.createDataFrame(_LAW, "n double, l double")).select(F.round("alpha", 3).alias("alpha"), F.round("a", 4).alias("a"), F.round("b", 3).alias("b"))


@query("SELECT 'p_partkey' AS name, count(p_partkey) AS n FROM part UNION ALL SELECT 'p_name', count(p_name) FROM part UNION ALL SELECT 'p_brand', count(p_brand) FROM part UNION ALL SELECT 'p_type', count(p_type) FROM part UNION ALL SELECT 'p_size', count(p_size) FROM part UNION ALL SELECT 'p_retailprice', count(p_retailprice) FROM part")
def agg_schema_profile(spark, d):
    from ..operators.registry import schema_profile

    return schema_profile(table(spark, d, "part")).select("name", "n")


@query("SELECT (('0x' || right(sha256(vec_id::VARCHAR), 1))::INT % 8)::INT AS shard, count(*) AS n FROM embeddings GROUP BY 1")
def agg_shard_counts(spark, d):
    return table(spark, d, "embeddings").groupBy(scalars.shard_of(F.col("vec_id").cast("string")).alias("shard")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT size, arg_min(bucket, (price, bucket)) AS best_low, arg_max(bucket, (price, bucket)) AS best_high FROM (SELECT p_size AS size, p_brand AS bucket, round(avg(p_retailprice), 4) AS price FROM part GROUP BY 1, 2) GROUP BY size")
def agg_window_best(spark, d):
    p = table(spark, d, "part").groupBy(F.col("p_size").alias("size"), F.col("p_brand").alias("bucket")).agg(F.round(F.avg("p_retailprice"), 4).alias("price"))
    return p.groupBy("size").agg(F.min_by("bucket", F.struct("price", "bucket")).alias("best_low"), F.max_by("bucket", F.struct("price", "bucket")).alias("best_high"))


@query("SELECT uid, split_pos, built_at FROM sequences WHERE uid IS NOT NULL AND tokens IS NOT NULL AND eval_cids IS NOT NULL AND split_pos IS NOT NULL AND built_at IS NOT NULL AND len(tokens) >= 30")
def agg_run_history(spark, d):
    return table(spark, d, "sequences").dropna(subset=["uid", "tokens", "eval_cids", "split_pos", "built_at"]).where(F.size("tokens") >= 30).select("uid", "split_pos", "built_at")


@query("SELECT p_brand || '|' || p_size AS config, max(p_partkey) AS run, arg_max(p_retailprice, p_partkey) FILTER (p_partkey % 2 = 0) AS result, count(*) - 1 AS replaced FROM part GROUP BY 1")
def agg_registry_upsert(spark, d):
    """Registrations by configuration: the last one stays, with the last result that was reported, and how many it replaced."""
    p = table(spark, d, "part").select(F.concat_ws("|", "p_brand", "p_size").alias("config"), F.col("p_partkey").alias("run"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_retailprice")).alias("result"))
    return registered(p)


def registered(runs):
    """(config, run, result, replaced) of rows (config, run, result): insert or replace; a missing result doesn't undo an older one."""
    last = F.max_by("result", F.when(F.col("result").isNotNull(), F.col("run"))).alias("result")
    return runs.groupBy("config").agg(F.max("run").alias("run"), last, (F.count(F.lit(1)) - 1).alias("replaced"))


# --- windows -----------------------------------------------------------------


@query(sql("SELECT uid, mid, okey, lno, rn FROM o", "ratings", o=ORDERED))
def win_user_order(spark, d):
    return seq.ordered(liked(spark, d), "uid", ORD).select("uid", "mid", "okey", "lno", F.col("rn").cast("bigint").alias("rn"))


@query(sql("SELECT uid, mid, okey, lno FROM o WHERE n - rn < 10", "ratings", o=ORDERED))
def win_truncate_recent(spark, d):
    return seq.ordered(liked(spark, d), "uid", ORD).where("n - rn < 10").select("uid", "mid", "okey", "lno")


_GAPS = "[" + ", ".join(map(str, scalars.GAPS)) + "]"


@query(
    sql(
        f"""SELECT uid, event_id, CASE WHEN g IS NULL THEN 0 ELSE len(list_filter({_GAPS}, lambda b: b <= greatest(g, 0))) END::INT AS vec_bucket,
 CASE WHEN g IS NULL THEN 0 ELSE len(list_filter({_GAPS}, lambda b: b < greatest(g, 0))) END::INT AS scalar_bucket FROM w""",
        "inter",
        w="SELECT uid, event_id, ts - lag(ts) OVER (PARTITION BY uid ORDER BY ts, event_id) AS g FROM inter",
    )
)
def win_time_gap(spark, d):
    i = interactions(spark, d).withColumn("g", F.col("ts") - F.lag("ts").over(Window.partitionBy("uid").orderBy("ts", "event_id")))
    b = lambda side: F.when(F.col("g").isNull(), 0).otherwise(scalars.time_bucket(F.col("g"), side))
    return i.select("uid", "event_id", b("right").alias("vec_bucket"), b("left").alias("scalar_bucket"))


@query(sql("SELECT uid, event_id, round((ts - first_value(ts) OVER (PARTITION BY uid ORDER BY ts, event_id)) / 3600.0::DOUBLE, 4) AS hours FROM inter", "inter"))
def win_rel_hours(spark, d):
    w = Window.partitionBy("uid").orderBy("ts", "event_id")
    return interactions(spark, d).select("uid", "event_id", F.round((F.col("ts") - F.first("ts").over(w)) / 3600, 4).alias("hours"))


_SPLIT = "SELECT first_ts AS s FROM (SELECT first_ts, row_number() OVER (ORDER BY first_ts) AS rn, count(*) OVER () AS n FROM b2) WHERE rn = least(greatest(n - 5000, 0), n - 1) + 1"


@query(sql("SELECT count(*) FILTER (first_ts > s) AS n_eval, count(*) FILTER (first_ts <= s) AS n_train, max(s) AS split_ts FROM b2, x", "b2", x=_SPLIT))
def win_time_split(spark, d):
    b = behavior_v2(spark, d)
    s = seq.split_time(b, "first_ts", 5000)
    return b.agg(F.count_if(F.col("first_ts") > s).alias("n_eval"), F.count_if(F.col("first_ts") <= s).alias("n_train"), F.max(s).alias("split_ts"))


@query(sql("SELECT uid, 3 * count(*) FILTER (first_ts <= s) AS split_pos FROM b2, x GROUP BY uid", "b2", x=_SPLIT))
def win_split_pos(spark, d):
    b = behavior_v2(spark, d)
    s = seq.split_time(b, "first_ts", 5000)
    return b.groupBy("uid").agg((3 * F.count_if(F.col("first_ts") <= s)).alias("split_pos"))


@query(sql("SELECT uid, event_id FROM w WHERE p IS NULL OR p <> iid", "inter", w="SELECT *, lag(iid) OVER (PARTITION BY uid ORDER BY ts, event_id) AS p FROM inter"))
def win_dedup_consecutive(spark, d):
    w = Window.partitionBy("uid").orderBy("ts", "event_id")
    return interactions(spark, d).withColumn("p", F.lag("iid").over(w)).where("p IS NULL OR p <> iid").select("uid", "event_id")


@query(sql("SELECT uid, max(mid) FILTER (rn = n) AS target, array_to_string(list(mid ORDER BY rn) FILTER (rn < n), ',') AS context FROM o GROUP BY uid HAVING max(n) >= 2", "ratings", o=ORDERED))
def win_leave_last_out(spark, d):
    """The context is all but the last."""
    return _leave_last_out(seq.ordered(liked(spark, d), "uid", ORD).where("n >= 2"))


def _leave_last_out(o):
    g = o.groupBy("uid").agg(F.max(F.when(F.col("rn") == F.col("n"), F.col("mid"))).alias("target"), F.array_sort(F.collect_list(F.when(F.col("rn") < F.col("n"), F.struct("rn", "mid")))).alias("c"))
    return g.select("uid", "target", F.array_join(F.transform("c", lambda x: x["mid"].cast("string")), ",").alias("context"))


@query(sql("SELECT uid, rn, array_to_string(list(mid) OVER (PARTITION BY uid ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), ',') AS context, mid AS target FROM o QUALIFY rn >= 3", "ratings", o=ORDERED))
def win_sliding_prefixes(spark, d):
    """Every prefix of a history as a context, the next item as target."""
    w = Window.partitionBy("uid").orderBy("rn").rowsBetween(Window.unboundedPreceding, -1)
    o = seq.ordered(liked(spark, d), "uid", ORD)
    return o.withColumn("c", F.collect_list("mid").over(w)).where("rn >= 3").select("uid", F.col("rn").cast("bigint").alias("rn"), F.array_join(F.col("c").cast("array<string>"), ",").alias("context"), F.col("mid").alias("target"))


@query(sql("SELECT uid, rn, array_to_string(list(mid) OVER (PARTITION BY uid ORDER BY rn ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), ',') AS context, mid AS target FROM o QUALIFY rn > 10", "ratings", o=ORDERED))
def win_sliding_fixed(spark, d):
    w = Window.partitionBy("uid").orderBy("rn").rowsBetween(-10, -1)
    o = seq.ordered(liked(spark, d), "uid", ORD)
    return o.withColumn("c", F.collect_list("mid").over(w)).where("rn > 10").select("uid", F.col("rn").cast("bigint").alias("rn"), F.array_join(F.col("c").cast("array<string>"), ",").alias("context"), F.col("mid").alias("target"))


@query(sql("SELECT uid, event_id, lag(bit, 1, 0) OVER (PARTITION BY uid ORDER BY ts, event_id) AS shifted FROM inter", "inter"))
def win_shift_features(spark, d):
    return interactions(spark, d).select("uid", "event_id", F.lag("bit", 1, 0).over(Window.partitionBy("uid").orderBy("ts", "event_id")).alias("shifted"))


@query(
    """WITH l AS (SELECT event_type AS run, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS step, count(*) OVER (PARTITION BY event_type) AS n, value FROM events)
SELECT run, step, round((sum(value) OVER w + greatest(3 - step, 0) * first_value(value) OVER (PARTITION BY run ORDER BY step) + greatest(step + 2 - n, 0) * last_value(value) OVER (PARTITION BY run ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) / 5, 5) AS smooth
FROM l WINDOW w AS (PARTITION BY run ORDER BY step ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)"""
)
def win_smooth(spark, d):
    """Centered moving average of 5, the ends repeated."""
    p = Window.partitionBy("run").orderBy("step")
    n = Window.partitionBy("run")
    e = table(spark, d, "events").select(F.col("event_type").alias("run"), F.row_number().over(Window.partitionBy("event_type").orderBy("event_id")).alias("step"), "value")
    total = F.sum("value").over(p.rowsBetween(-2, 2))
    head = F.greatest(3 - F.col("step"), F.lit(0)) * F.first("value").over(p)
    tail = F.greatest(F.col("step") + 2 - F.count(F.lit(1)).over(n), F.lit(0)) * F.last("value").over(p.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return e.select("run", F.col("step").cast("bigint").alias("step"), F.round((total + head + tail) / 5, 5).alias("smooth"))


_G = "SELECT l_orderkey AS g, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS pos, l_quantity AS r FROM lineitem"


def groups(spark, d):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("g"), F.row_number().over(w).alias("pos"), F.col("l_quantity").alias("r"))


@query(sql("SELECT g, pos, round(CASE WHEN count(*) OVER (PARTITION BY g) > 1 THEN 2.0::DOUBLE * (row_number() OVER (PARTITION BY g ORDER BY r, pos) - 1) / (count(*) OVER (PARTITION BY g) - 1) - 1 ELSE 0 END, 6) AS norm FROM x", x=_G))
def win_rank_norm(spark, d):
    from ..operators.losses import rank_norm

    return groups(spark, d).select("g", F.col("pos").cast("bigint").alias("pos"), F.round(rank_norm("g", "r", "pos"), 6).alias("norm"))


@query(sql("SELECT g, pos, round(greatest(-5, least(5, (r - avg(r) OVER w) / stddev_samp(r) OVER w)), 5) AS z FROM x WINDOW w AS (PARTITION BY g) QUALIFY stddev_samp(r) OVER w >= 1e-6", x=_G))
def win_zscore(spark, d):
    from ..operators.losses import zscore

    return groups(spark, d).withColumn("z", zscore("g", "r")).where("z IS NOT NULL").select("g", F.col("pos").cast("bigint").alias("pos"), F.round("z", 5).alias("z"))


# --- sort, limit, top-k, sets -------------------------------------------------


@query(sql("SELECT sid, count(*) AS n FROM sid GROUP BY sid ORDER BY n DESC, sid LIMIT 10", "sid"))
def topk_collisions(spark, d):
    return sids(spark, d).groupBy("sid").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "sid").limit(10)


@query(sql("SELECT item_a, item_b, score FROM (" + _SWING + ") ORDER BY score DESC, item_a, item_b LIMIT 100", "ratings", u=_SWING_U))
def topk_swing(spark, d):
    return relate.swing(ratings(spark, d).where("rating >= 5"), "uid", "mid").withColumn("score", F.round("score", 6)).orderBy(F.desc("score"), "item_a", "item_b").limit(100)


@query(
    sql(
        "SELECT a AS seed, b AS cand, w FROM (SELECT a.mid AS a, b.mid AS b, round(sum(1.0::DOUBLE / abs(b.rn - a.rn)), 6) AS w FROM o a JOIN o b ON a.uid = b.uid AND b.rn <> a.rn AND abs(b.rn - a.rn) <= 5 GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY a ORDER BY w DESC, b) <= 2000",
        "ratings",
        o=ORDERED,
    )
)
def topk_seed_candidates(spark, d):
    g = _window_weights(spark, d).select(F.col("a").alias("seed"), F.col("b").alias("cand"), F.col("weight").alias("w"))
    return g.withColumn("r", F.row_number().over(Window.partitionBy("seed").orderBy(F.desc("w"), "cand"))).where("r <= 2000").drop("r")


@query("SELECT p_brand, p_size, round(avg(p_retailprice), 4) AS recall FROM part GROUP BY 1, 2 ORDER BY coalesce(recall, 0) DESC, p_brand, p_size LIMIT 5")
def sort_grid(spark, d):
    g = table(spark, d, "part").groupBy("p_brand", "p_size").agg(F.round(F.avg("p_retailprice"), 4).alias("recall"))
    return g.orderBy(F.desc(F.coalesce("recall", F.lit(0.0))), "p_brand", "p_size").limit(5)


@query("SELECT iid FROM (SELECT DISTINCT p_name AS iid FROM part) ORDER BY sha256(iid || '42'), iid LIMIT 100")
def sample_seeded(spark, d):
    p = table(spark, d, "part").select(F.col("p_name").alias("iid")).distinct()
    return p.orderBy(F.sha2(F.concat("iid", F.lit("42")), 256), "iid").limit(100)


@query("SELECT p_partkey FROM part ORDER BY sha256(p_partkey::VARCHAR || 'pairs'), p_partkey LIMIT 50")
def first_max_pairs(spark, d):
    return table(spark, d, "part").orderBy(F.sha2(F.concat(F.col("p_partkey").cast("string"), F.lit("pairs")), 256), "p_partkey").limit(50).select("p_partkey")


@query("SELECT iid, arg_max(src, p) AS src FROM (SELECT p_partkey AS iid, 'old' AS src, 0 AS p FROM part UNION ALL SELECT p_partkey, 'new', 1 FROM part WHERE p_size > 25) GROUP BY iid")
def union_shards(spark, d):
    p = table(spark, d, "part")
    u = p.select(F.col("p_partkey").alias("iid"), F.lit("old").alias("src"), F.lit(0).alias("p")).unionByName(p.where("p_size > 25").select(F.col("p_partkey").alias("iid"), F.lit("new").alias("src"), F.lit(1).alias("p")))
    return u.groupBy("iid").agg(F.max_by("src", "p").alias("src"))


@query(
    sql(
        "SELECT item_a, item_b FROM adj UNION SELECT item_a, item_b FROM sw",
        "ratings",
        u=_SWING_U,
        sw=_SWING,
        adj=f"SELECT DISTINCT least(mid, p) AS item_a, greatest(mid, p) AS item_b FROM (SELECT mid, lag(mid) OVER (PARTITION BY uid ORDER BY {_ORD}) AS p FROM ratings WHERE rating >= 5) WHERE p IS NOT NULL AND p <> mid",
    )
)
def union_pairs(spark, d):
    five = ratings(spark, d).where("rating >= 5")
    sw = relate.swing(five, "uid", "mid").select("item_a", "item_b")
    return relate.adjacent_pairs(five, "uid", "mid", ORD).unionByName(sw).distinct()


@query(sql("SELECT content_id FROM ri INTERSECT SELECT iid FROM b2", "b2", ri=RI))
def intersect_exposed(spark, d):
    r = table(spark, d, "results").select(item_key("content_id").alias("content_id")).where("content_id IS NOT NULL")
    return r.intersect(behavior_v2(spark, d).select("iid"))


@query(sql("SELECT iid FROM b2 EXCEPT SELECT content_id FROM sid", "b2", "sid"))
def except_existing(spark, d):
    return behavior_v2(spark, d).select("iid").subtract(sids(spark, d).select("content_id"))


@query(sql("SELECT content_id, a || '_' || b || '_0' AS sid FROM sid WHERE c % 4 = 0 UNION ALL SELECT content_id, sid FROM sid WHERE c % 4 <> 0", "sid"))
def upsert_sid(spark, d):
    from ..operators.registry import upsert

    s = sids(spark, d)
    new = s.where("c % 4 = 0").select("content_id", F.concat_ws("_", "a", "b", F.lit("0")).alias("sid"))
    return upsert(s.select("content_id", "sid"), new, ["content_id"])


@query(
    sql(
        """SELECT p.item_a, p.item_b, round(p.k::DOUBLE / (a.n + b.n - p.k), 6) AS jaccard FROM p JOIN n a ON a.mid = p.item_a JOIN n b ON b.mid = p.item_b""",
        "ratings",
        l="SELECT DISTINCT uid, mid FROM ratings WHERE rating >= 4",
        n="SELECT mid, count(*) AS n FROM l GROUP BY mid",
        p="SELECT a.mid AS item_a, b.mid AS item_b, count(*) AS k FROM l a JOIN l b ON a.uid = b.uid AND a.mid < b.mid GROUP BY ALL",
    )
)
def jaccard_users(spark, d):
    """Every pair with a common user, of liked items."""
    return relate.jaccard(liked(spark, d), "uid", "mid").withColumn("jaccard", F.round("jaccard", 6))


@query("SELECT uid, built_at, array_to_string(list_slice(list_concat(list_concat(list_slice(tokens, 1, 2), list_slice(tokens, 4, 5)), list_slice(tokens, 7, 8)), 1, 5), ',') AS rejected FROM sequences WHERE len(tokens) > 0")
def union_arrays_difficulty(spark, d):
    t = F.col("tokens")
    merged = F.slice(F.concat(F.slice(t, 1, 2), F.slice(t, 4, 2), F.slice(t, 7, 2)), 1, 5)
    return table(spark, d, "sequences").where(F.size(t) > 0).select("uid", "built_at", F.array_join(merged.cast("array<string>"), ",").alias("rejected"))


QUERIES, SQL = Q, S
