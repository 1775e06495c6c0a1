"""Metrics (inventory 2.9)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import metrics as m
from ..operators import pairdist
from ..operators.registry import degradation
from ..util import item_key, table
from .base import behavior, behavior_v2, ratings, sids, sql

Q: dict = {}
S: dict = {}


def query(oracle: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if oracle:
            S[f.__name__] = oracle
        return f

    return add


def rounded(df, *names, to=6):
    return df.select(*[F.round(c, to).alias(c) if c in names else c for c in df.columns])


_PC = "SELECT 1::INT AS depth, a::VARCHAR AS prefix, count(*) AS n FROM sid GROUP BY a UNION ALL SELECT 2, a || '_' || b, count(*) FROM sid GROUP BY 2 UNION ALL SELECT 3, sid, count(*) FROM sid GROUP BY 2"


@query(sql("SELECT round(count(*) FILTER (n > 1) / count(*), 6) AS conflict_rate, round(count(*) FILTER (n = 1) / sum(n), 6)::DOUBLE AS exclusivity, coalesce(sum(n) FILTER (n > 1), 0)::BIGINT AS collided, round(1 - count(*) / sum(n), 6)::DOUBLE AS collision_rate FROM (SELECT sid, count(*) AS n FROM sid GROUP BY sid)", "sid"))
def m_collision(spark, d):
    return rounded(m.collision(sids(spark, d)), "conflict_rate", "exclusivity", "collision_rate")


@query(
    sql(
        "SELECT depth, count(*) AS unique_prefixes, round(1 - count(*) / sum(n), 6)::DOUBLE AS collision_rate, round(count(*) FILTER (n > 1) / count(*), 6) AS conflict_rate, round(avg(n), 6) AS mean, min(n) AS least, max(n) AS most, "
        + ", ".join(f"floor(quantile_cont(n, {p / 100}))::BIGINT AS p{p}" for p in (50, 90, 99))
        + ", "
        + ", ".join(f"count(*) FILTER (n <= {k}) AS le_{k}" for k in (1, 2, 5, 10, 50, 100, 500))
        + " FROM p GROUP BY depth",
        "sid",
        p=_PC,
    )
)
def m_collision_depth(spark, d):
    return rounded(m.collision_depth(sids(spark, d)), "collision_rate", "conflict_rate", "mean")


@query(sql("SELECT depth, count(*) AS unique_prefixes, cap::BIGINT AS capacity, round(count(*) / cap::DOUBLE, 9) AS utilization FROM p, (SELECT max(a) + 1 AS s1, max(b) + 1 AS s2, max(c) + 1 AS s3 FROM sid), LATERAL (SELECT CASE depth WHEN 1 THEN s1::BIGINT WHEN 2 THEN s1::BIGINT * s2 ELSE s1::BIGINT * s2 * s3 END AS cap) GROUP BY depth, cap", "sid", p=_PC))
def m_codebook_util(spark, d):
    return rounded(m.codebook_utilization(sids(spark, d)), "utilization", to=9)


@query(sql("SELECT depth, round(-sum(n / t * log2(n / t)), 6) AS bits, round(-sum(n / t * log2(n / t)) / log2(t), 6) AS of_items FROM p, (SELECT count(*)::DOUBLE AS t FROM sid) GROUP BY depth, t", "sid", p=_PC))
def m_entropy(spark, d):
    e = m.entropy(sids(spark, d))
    return e.select("depth", F.round("bits", 6).alias("bits"), F.round(F.col("bits") / F.log2("n_total"), 6).alias("of_items"))


@query(sql("SELECT depth, round(2 * sum(rk * n) / (count(*) * sum(n)) - (count(*) + 1) / count(*), 6)::DOUBLE AS gini, round(stddev_samp(n) / avg(n), 6) AS cv, min(n) AS least, max(n) AS most FROM (SELECT *, row_number() OVER (PARTITION BY depth ORDER BY n, prefix) AS rk FROM p) GROUP BY depth", "sid", p=_PC))
def m_gini(spark, d):
    return rounded(m.gini(sids(spark, d)), "gini", "cv")


@query(sql("SELECT depth, round(1 - count(*) / sum(n), 6)::DOUBLE AS collision, round(2 * sum(rk * n) / (count(*) * sum(n)) - (count(*) + 1) / count(*), 6)::DOUBLE AS gini FROM (SELECT *, row_number() OVER (PARTITION BY depth ORDER BY n, prefix) AS rk FROM p) GROUP BY depth", "sid", p=_PC))
def m_sid_registry(spark, d):
    s = sids(spark, d)
    return m.collision_depth(s).select("depth", F.round("collision_rate", 6).alias("collision")).join(m.gini(s).select("depth", F.round("gini", 6).alias("gini")), "depth")


_UNIT = "SELECT vec_id, label, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS v FROM embeddings"


def unit(spark, d):
    return table(spark, d, "embeddings").select("vec_id", "label", scalars.l2_normalize(F.col("embedding")).alias("v"))


@query(
    f"""WITH u AS ({_UNIT}), p AS (SELECT a.label, list_dot_product(a.v, b.v) AS s FROM u a JOIN u b ON a.label = b.label AND a.vec_id < b.vec_id),
g AS (SELECT label, count(*) AS pairs, round(avg(s), 5) AS mean, round(stddev_samp(s), 5) AS std, round(min(s), 5) AS least, round(max(s), 5) AS most, list_sort(list(round(s, 5))) AS x FROM p GROUP BY label)
SELECT label, pairs, mean, std, least, most, x[floor(pairs * 0.05)::BIGINT + 1] AS p5, x[floor(pairs * 0.25)::BIGINT + 1] AS p25, x[(pairs - 1) // 2 + 1] AS median, x[floor(pairs * 0.75)::BIGINT + 1] AS p75, x[floor(pairs * 0.95)::BIGINT + 1] AS p95 FROM g"""
)
def m_cosine_dist(spark, d):
    """The distribution over all pairs of a class, each pair once, with median and percentiles."""
    e = table(spark, d, "embeddings").where("exists(embedding, x -> x <> 0)")
    g = pairdist.cosine_distribution(e.select(F.col("label").cast("bigint").alias("g"), F.col("vec_id").cast("bigint").alias("id"), F.col("embedding").alias("v")))
    return rounded(g.withColumnRenamed("g", "label"), "mean", "std", "least", "most", to=5)


@query()
def m_effective_dim(spark, d):
    from ..operators.spectrum import effective_dim

    return effective_dim(unit(spark, d), "v")


_FIVE = "SELECT DISTINCT uid, iid FROM beh WHERE action_bitmap > 0"


@query(
    sql(
        """SELECT (SELECT count(*) FROM o) AS users, round((SELECT avg(o) FROM o), 6) AS observed, round(b.o, 6) AS baseline FROM b""",
        "beh",
        "sid",
        k=f"SELECT p.uid, p.iid, a, b, c FROM ({_FIVE}) p JOIN sid ON iid = content_id",
        l="SELECT uid, iid, 1 AS l, a AS x FROM k UNION ALL SELECT uid, iid, 2, b FROM k UNION ALL SELECT uid, iid, 3, c FROM k",
        o="SELECT uid, sum(m * (m - 1)) / (any_value(n) * (any_value(n) - 1) * 3.0::DOUBLE) AS o FROM (SELECT uid, l, x, count(*) AS m FROM l GROUP BY ALL) JOIN (SELECT uid, count(*) AS n FROM k GROUP BY uid) USING (uid) WHERE n >= 2 GROUP BY uid",
        i="SELECT DISTINCT iid, l, x FROM l",
        b="SELECT sum(m * (m - 1)) / (any_value(n) * (any_value(n) - 1) * 3.0::DOUBLE) AS o FROM (SELECT l, x, count(*) AS m FROM i GROUP BY ALL), (SELECT count(DISTINCT iid) AS n FROM i)",
    )
)
def m_user_consistency(spark, d):
    c = m.user_consistency(behavior(spark, d).where("action_bitmap > 0"), sids(spark, d))
    return rounded(c.select("users", "observed", "baseline"), "observed", "baseline")


_SNHR = dict(
    k=f"SELECT p.uid, p.iid, a, b FROM ({_FIVE}) p JOIN sid ON iid = content_id",
    u="SELECT iid, a, b, count(*) AS users FROM k GROUP BY ALL",
    s="SELECT a, b, count(*) AS size FROM u GROUP BY ALL",
    h="SELECT iid, count(*) AS hits FROM (SELECT DISTINCT x.iid, y.iid AS other FROM k x JOIN k y ON x.uid = y.uid AND x.a = y.a AND x.b = y.b AND x.iid <> y.iid) GROUP BY iid",
    f="SELECT u.iid, CASE WHEN size > 1 THEN coalesce(hits, 0) / (size - 1)::DOUBLE END AS r FROM u JOIN s USING (a, b) LEFT JOIN h USING (iid) WHERE users >= 2",
)


@query(sql("SELECT round(avg(r), 6) AS hit_rate, round(stddev_pop(r), 6) AS spread, round(count(r) / count(*), 6) AS coverage, count(*) AS items FROM f", "beh", "sid", **_SNHR))
def m_neighbor_hit_rate(spark, d):
    return rounded(m.neighbor_hit_rate(behavior(spark, d).where("action_bitmap > 0"), sids(spark, d)), "hit_rate", "spread", "coverage")


@query(sql("SELECT round(count(*) FILTER (n > 1) / count(*), 6) AS coverage, count(*) AS items FROM (SELECT count(*) OVER (PARTITION BY a, b) AS n FROM sid)", "sid"))
def m_neighbor_coverage(spark, d):
    g = sids(spark, d).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    return g.agg(F.round(F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)) / F.sum("n"), 6).alias("coverage"), F.sum("n").alias("items"))


@query(
    sql(
        """SELECT (SELECT count(*) FROM i) AS items, count(*) AS pairs, CASE WHEN (SELECT count(*) FROM i) >= 100 THEN count(*) FILTER (t > 0) END AS co_pairs, CASE WHEN (SELECT count(*) FROM i) >= 100 THEN round(corr(ra, rt), 6) END AS spearman FROM k""",
        "b2",
        e="""SELECT iid, v FROM (SELECT lower(trim(content_id, E' \\t\\r\\n')) AS iid, embedding::DOUBLE[] AS v, encoded_at FROM results WHERE content_id IS NOT NULL AND len(embedding) = 128)
 WHERE iid <> '' AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0 QUALIFY row_number() OVER (PARTITION BY iid ORDER BY encoded_at DESC NULLS LAST) = 1""",
        a="SELECT DISTINCT uid, iid FROM b2 WHERE action_bitmap > 0",
        n="SELECT iid, count(*) AS n FROM a GROUP BY iid HAVING count(*) >= 5",
        i="SELECT iid, n, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM e JOIN n USING (iid)",
        c="SELECT x.iid AS a, y.iid AS b, count(*) AS k FROM a x JOIN a y ON x.uid = y.uid AND x.iid < y.iid WHERE x.iid IN (SELECT iid FROM i) AND y.iid IN (SELECT iid FROM i) GROUP BY ALL",
        p="SELECT round(list_dot_product(x.v, y.v), 5) AS s, coalesce(c.k / (x.n + y.n - c.k)::DOUBLE, 0) AS t FROM i x JOIN i y ON x.iid < y.iid LEFT JOIN c ON c.a = x.iid AND c.b = y.iid",
        k="SELECT s, t, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0::DOUBLE AS ra, rank() OVER (ORDER BY t) + (count(*) OVER (PARTITION BY t) - 1) / 2.0::DOUBLE AS rt FROM p",
    )
)
def m_emb_behavior_corr(spark, d):
    """Spearman correlation of cosine and user-Jaccard over all pairs of items with at least 5 users."""
    v = F.col("v")
    rows = table(spark, d, "results").select(item_key("content_id").alias("iid"), F.col("embedding").cast("array<double>").alias("v"), "encoded_at")
    usable = rows.where("iid <> ''").where((F.size(v) == 128) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0))
    latest = usable.groupBy("iid").agg(F.max_by("v", F.struct("encoded_at", F.xxhash64("v"))).alias("v"))
    return rounded(pairdist.embedding_behavior_corr(latest, behavior_v2(spark, d).where("action_bitmap > 0")), "spearman")


_PN = "SELECT o_custkey AS uid, l_quantity > 25 AS pos, v FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN u ON vec_id = l_partkey"


@query(
    sql(
        "SELECT count(*) AS users, round(avg((pp - pq) / nullif(1 - pq, 0)), 5) AS separation FROM d JOIN e USING (uid)",
        u=_UNIT,
        r=_PN,
        l="SELECT uid, pos, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM r",
        s="SELECT uid, i, avg(x) FILTER (pos) AS p, avg(x) FILTER (NOT pos) AS q FROM l GROUP BY ALL",
        d="SELECT uid, sum(p * p) AS pp, sum(p * q) AS pq FROM s GROUP BY uid",
        e="SELECT uid FROM r GROUP BY uid HAVING count(*) FILTER (pos) >= 2 AND count(*) FILTER (NOT pos) >= 2",
    )
)
def m_pos_neg_separation(spark, d):
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    rows = o.join(li, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("uid"), (F.col("l_quantity") > 25).alias("pos"), F.col("l_partkey").alias("vec_id")).join(unit(spark, d), "vec_id")
    return m.pos_neg_separation(rows).select("users", F.round("separation", 5).alias("separation"))


@query(
    sql(
        """SELECT k, round(avg(hits / nn::DOUBLE), 6) AS hit_rate, count(*) AS items FROM (SELECT k, q, nn, count(c.item_b) FILTER (t.rk <= k) AS hits FROM (SELECT unnest([10, 50]) AS k), t JOIN n ON n.item_a = t.q LEFT JOIN co c ON c.item_a = t.q AND c.item_b = t.c GROUP BY ALL) GROUP BY k""",
        "ratings",
        u=_UNIT,
        l="SELECT DISTINCT uid, mid FROM ratings WHERE rating >= 5",
        co="SELECT DISTINCT a.mid AS item_a, b.mid AS item_b FROM l a JOIN l b ON a.uid = b.uid AND a.mid <> b.mid WHERE a.mid % 50 = 0",
        n="SELECT item_a, count(*) AS nn FROM co GROUP BY item_a",
        t="SELECT q.vec_id AS q, v.vec_id AS c, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_dot_product(q.v, v.v) DESC, v.vec_id) AS rk FROM u q JOIN u v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0 QUALIFY rk <= 50",
    )
)
def m_embedding_hit_rate(spark, d):
    from ..operators.vectors import topk_cosine

    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    top = topk_cosine(e.where("id % 50 = 0"), e, 50).withColumn("rk", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("cosine"), "c")))
    five = ratings(spark, d).where("rating >= 5").select("uid", "mid").distinct()
    co = five.where("mid % 50 = 0").select("uid", F.col("mid").alias("q")).join(five, "uid").where("q <> mid").select("q", F.col("mid").alias("c")).distinct()
    n = co.groupBy("q").agg(F.count(F.lit(1)).alias("nn"))
    hit = top.join(n, "q").join(co.withColumn("hit", F.lit(1)), ["q", "c"], "left")
    per = hit.groupBy("q", "nn").agg(*[F.count(F.when(F.col("rk") <= k, F.col("hit"))).alias(f"h{k}") for k in (10, 50)])
    long = per.select("nn", F.explode(F.create_map(F.lit(10), F.col("h10"), F.lit(50), F.col("h50"))).alias("k", "hits"))
    return long.groupBy("k").agg(F.round(F.avg(F.col("hits") / F.col("nn")), 6).alias("hit_rate"), F.count(F.lit(1)).alias("items"))


_EVAL_SQL = """SELECT model, metric, value, CASE WHEN metric = 'collision' THEN CASE WHEN value <= 0.05 THEN 'excellent' WHEN value <= 0.15 THEN 'good' WHEN value <= 0.3 THEN 'acceptable' ELSE 'poor' END
 ELSE CASE WHEN value >= 0.9 THEN 'excellent' WHEN value >= 0.8 THEN 'good' WHEN value >= 0.7 THEN 'acceptable' ELSE 'poor' END END AS status FROM (
 SELECT 'depth' || depth AS model, 'collision' AS metric, round(1 - count(*) / sum(n)::DOUBLE, 6) AS value FROM pc GROUP BY depth
 UNION ALL SELECT 'depth' || depth, 'entropy', round(-sum(n / t::DOUBLE * log2(n / t::DOUBLE)) / log2(any_value(t)), 6) FROM (SELECT *, sum(n) OVER (PARTITION BY depth) AS t FROM pc) GROUP BY depth)"""


def evals(spark, d):
    """(model, metric, value, status): SIDs cut to one, two and three codes, compared by collision and entropy."""
    n = m.prefix_counts(sids(spark, d))
    total = n.groupBy("depth").agg(F.sum("n").alias("t"))  # three rows
    p = F.col("n") / F.col("t")
    g = n.join(F.broadcast(total), "depth").groupBy("depth").agg(F.round(1 - F.count(F.lit(1)) / F.sum("n"), 6).alias("collision"), F.round(-F.sum(p * F.log2(p)) / F.log2(F.first("t")), 6).alias("entropy"))
    rows = F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("value"), scalars.quality_status(F.col(c), steps, low).alias("status")) for c, steps, low in (("collision", [0.05, 0.15, 0.3], True), ("entropy", [0.9, 0.8, 0.7], False))]))
    return g.select(F.concat(F.lit("depth"), F.col("depth").cast("string")).alias("model"), rows)


@query(sql("SELECT model, max(value) FILTER (metric = 'collision') AS collision, max(value) FILTER (metric = 'entropy') AS entropy, sum(CASE status WHEN 'excellent' THEN 3 WHEN 'good' THEN 2 WHEN 'acceptable' THEN 1 ELSE 0 END)::BIGINT AS score FROM e GROUP BY model", "sid", pc=_PC, e=_EVAL_SQL))
def m_compare_table(spark, d):
    points = F.when(F.col("status") == "excellent", 3).when(F.col("status") == "good", 2).when(F.col("status") == "acceptable", 1).otherwise(0)
    e = evals(spark, d)
    return e.groupBy("model").pivot("metric", ["collision", "entropy"]).agg(F.max("value")).join(e.groupBy("model").agg(F.sum(points).alias("score")), "model")


@query(sql("SELECT metric, CASE WHEN regexp_matches(metric, 'utilization|entropy|dimension|similarity') THEN arg_max(model, value) ELSE arg_min(model, value) END AS best FROM e GROUP BY metric", "sid", pc=_PC, e=_EVAL_SQL))
def m_compare_best(spark, d):
    up = F.col("metric").rlike("utilization|entropy|dimension|similarity")
    g = evals(spark, d).groupBy("metric").agg(F.max_by("model", "value").alias("hi"), F.min_by("model", "value").alias("lo"))
    return g.select("metric", F.when(up, F.col("hi")).otherwise(F.col("lo")).alias("best"))


_RUN = [("base", 20.0, 0.14, 0.70), ("small", 26.5, 0.11, 0.61), ("large", 20.7, 0.128, 64.1), ("empty", None, None, 0.2)]
_RUN_SQL = "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join("NULL" if x is None else f"'{x}'" if isinstance(x, str) else f"{x}::DOUBLE" for x in r) + ")" for r in _RUN) + ") t(run, ppl, r10, r500)"


def runs(spark):
    return spark.createDataFrame(_RUN, "run string, ppl double, r10 double, r500 double")


@query(sql("SELECT r.run, round(100 * (r.ppl - 20.0) / 20.0, 6)::DOUBLE AS ppl_delta, round(100 * (r.r10 - 0.14) / 0.14, 6)::DOUBLE AS r10_delta FROM r", r=_RUN_SQL))
def m_degradation(spark, d):
    return rounded(degradation(runs(spark), "run", "base", ["ppl", "r10"]).select("run", "ppl_delta", "r10_delta"), "ppl_delta", "r10_delta")


@query(sql("SELECT run, ppl, round(CASE WHEN r500 <= 1 THEN r500 * 100 ELSE r500 END, 6)::DOUBLE AS recall FROM r a WHERE ppl IS NOT NULL AND NOT EXISTS (SELECT 1 FROM r b WHERE b.ppl <= a.ppl AND CASE WHEN b.r500 <= 1 THEN b.r500 * 100 ELSE b.r500 END >= CASE WHEN a.r500 <= 1 THEN a.r500 * 100 ELSE a.r500 END AND (b.ppl < a.ppl OR CASE WHEN b.r500 <= 1 THEN b.r500 * 100 ELSE b.r500 END > CASE WHEN a.r500 <= 1 THEN a.r500 * 100 ELSE a.r500 END))", r=_RUN_SQL))
def m_pareto_points(spark, d):
    """Runs that no other run beats on both measures: a running best in the order of perplexity."""
    p = runs(spark).where("ppl IS NOT NULL").select("run", "ppl", F.when(F.col("r500") <= 1, F.col("r500") * 100).otherwise(F.col("r500")).alias("recall"))
    level = p.groupBy("ppl").agg(F.max("recall").alias("l"))  # one row per perplexity
    level = level.withColumn("b", F.max("l").over(Window.orderBy("ppl").rowsBetween(Window.unboundedPreceding, -1)))
    return p.join(level, "ppl").where("recall = l AND (b IS NULL OR recall > b)").select("run", "ppl", F.round("recall", 6).alias("recall"))


@query("SELECT stage, pos, round(v, 4)::DOUBLE AS ppl FROM (VALUES ('ntp', 1, 20.0), ('sp', 2, 19.1), ('rf-a', 3, 18.5), ('rf-b', 3, 18.7)) t(stage, pos, v)")
def m_stage_waterfall(spark, d):
    one = lambda *r: spark.createDataFrame([r], "stage string, pos int, ppl double")
    u = one("ntp", 1, 20.0).unionByName(one("sp", 2, 19.1)).unionByName(one("rf-a", 3, 18.5)).unionByName(one("rf-b", 3, 18.7))
    return u.orderBy("pos", "stage")


@query("SELECT run, coalesce(r500, found) AS r500, coalesce(r10, depth_hit[-1]) AS r10 FROM (VALUES ('a', 0.7::DOUBLE, 0.5::DOUBLE, 0.1::DOUBLE, [0.3, 0.2]::DOUBLE[]), ('b', NULL, 0.6, NULL, [0.4, 0.15])) t(run, r500, found, r10, depth_hit)")
def m_eval_fallbacks(spark, d):
    t = spark.createDataFrame([("a", 0.7, 0.5, 0.1, [0.3, 0.2]), ("b", None, 0.6, None, [0.4, 0.15])], "run string, r500 double, found double, r10 double, depth_hit array<double>")
    return t.select("run", F.coalesce("r500", "found").alias("r500"), F.coalesce("r10", F.element_at("depth_hit", -1)).alias("r10"))



@query(sql("SELECT model, score, rank() OVER (ORDER BY score DESC)::INT AS place FROM (SELECT model, sum(CASE status WHEN 'excellent' THEN 3 WHEN 'good' THEN 2 WHEN 'acceptable' THEN 1 ELSE 0 END)::BIGINT AS score FROM e GROUP BY model)", "sid", pc=_PC, e=_EVAL_SQL))
def m_compare_ranking(spark, d):
    points = F.when(F.col("status") == "excellent", 3).when(F.col("status") == "good", 2).when(F.col("status") == "acceptable", 1).otherwise(0)
    s = evals(spark, d).groupBy("model").agg(F.sum(points).alias("score"))  # a row per model
    return s.withColumn("place", F.rank().over(Window.orderBy(F.desc("score"))))


@query(sql("SELECT metric, count(*) AS n, string_agg(model, ',' ORDER BY model) AS models FROM e GROUP BY metric", "sid", pc=_PC, e=_EVAL_SQL))
def sink_reports(spark, d):
    """A report written as JSON and CSV and read again."""
    import uuid

    from .. import scratch

    at = f"{scratch.folder(spark)}/report-{uuid.uuid4().hex}"
    report = evals(spark, d)
    report.write.json(f"{at}/json")
    report.write.option("header", True).csv(f"{at}/csv")
    j = spark.read.schema("model string, metric string, value double, status string").json(f"{at}/json")
    c = spark.read.schema("model string, metric string, value double, status string").option("header", True).csv(f"{at}/csv")
    both = j.intersect(c)
    return both.groupBy("metric").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list("model")), ",").alias("models"))


QUERIES, SQL = Q, S
