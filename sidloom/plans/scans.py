"""Sources, sinks, filters and projections (inventory 2.1 and 2.2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import scratch
from ..functions import bits, scalars
from ..sources import readers
from ..util import item_key, table
from .base import behavior, behavior_v2, movies, ratings, sids, sql

Q: dict = {}
S: dict = {}


def query(oracle: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if oracle:
            S[f.__name__] = oracle
        return f

    return add


_STRONG, _WEAK, _TRADE = sum(bits.STRONG), sum(bits.WEAK), sum(bits.TRADE)


@query("SELECT content_id, coalesce(full_text, '') AS full_text, content_language, array_to_string(coalesce(images, []), ',') AS images FROM pinned_content")
def scan_content(spark, d):
    c = readers.read_content(spark, f"{d}/pinned_content.parquet")
    return c.select("content_id", F.coalesce("full_text", F.lit("")).alias("full_text"), "content_language", F.array_join("images", ",").alias("images"))


@query("SELECT content_id, full_text FROM pinned_content WHERE full_text IS NOT NULL AND full_text <> ''")
def scan_content_map(spark, d):
    return readers.read_content_map(spark, f"{d}/pinned_content.parquet")


@query("SELECT vec_id, len(embedding)::INT AS dim, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 4) AS total FROM embeddings")
def scan_embeddings(spark, d):
    e = table(spark, d, "embeddings")
    return e.select("vec_id", F.size("embedding").alias("dim"), F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double")), 4).alias("total"))


@query("SELECT ingested_at::DATE AS dt, count(*) AS n FROM behavior_v2 WHERE ingested_at::DATE BETWEEN DATE '2025-01-05' AND DATE '2025-01-12' GROUP BY 1")
def date_partition_prune(spark, d):
    return readers.days(table(spark, d, "behavior_v2"), "ingested_at", "2025-01-05", "2025-01-12").groupBy("dt").agg(F.count(F.lit(1)).alias("n"))


@query(r"SELECT DISTINCT lower(trim(iid, E' \t\r\n')) AS iid FROM behavior_v2 WHERE iid IS NOT NULL")
def scan_exposed_ids(spark, d):
    return table(spark, d, "behavior_v2").select(item_key("iid").alias("iid")).where("iid IS NOT NULL").distinct()


@query("SELECT uid, iid, action_bitmap, coalesce(first_ts, 0) AS first_ts FROM behavior_v2")
def scan_behavior(spark, d):
    return readers.read_behavior(spark, f"{d}/behavior_v2.parquet")


@query(
    sql(
        """SELECT count(DISTINCT uid) AS users, count(DISTINCT iid) AS items, count(*) FILTER (action_bitmap > 0) AS positives, count(*) FILTER (action_bitmap < 0) AS negatives
 FROM b2 WHERE iid IN (SELECT content_id FROM sid)""",
        "b2",
        "sid",
    )
)
def scan_behavior_filtered(spark, d):
    kept = behavior_v2(spark, d).join(sids(spark, d), F.col("iid") == F.col("content_id"), "left_semi")
    return kept.agg(F.count_distinct("uid").alias("users"), F.count_distinct("iid").alias("items"), F.count_if(F.col("action_bitmap") > 0).alias("positives"), F.count_if(F.col("action_bitmap") < 0).alias("negatives"))


@query(sql("SELECT uid, session_id, count(DISTINCT iid) FILTER (action_bitmap <> 0) AS n_pos, array_to_string(list_sort(list(DISTINCT iid) FILTER (action_bitmap = 0)), ',') AS negatives FROM b2 GROUP BY uid, session_id HAVING count(*) FILTER (action_bitmap = 0) > 0", "b2"))
def scan_behavior_v2(spark, d):
    g = behavior_v2(spark, d).groupBy("uid", "session_id")
    out = g.agg(F.count_distinct(F.when(F.col("action_bitmap") != 0, F.col("iid"))).alias("n_pos"), F.array_sort(F.collect_set(F.when(F.col("action_bitmap") == 0, F.col("iid")))).alias("neg"))
    return out.where(F.size("neg") > 0).select("uid", "session_id", "n_pos", F.array_join("neg", ",").alias("negatives"))


@query(
    sql(
        "SELECT p.uid, p.session_id, p.iid, p.first_ts, p.last_ts, p.event_cnt, coalesce(n.n, 0) AS n_neg FROM b2 p LEFT JOIN neg n USING (uid, session_id) WHERE p.action_bitmap > 0",
        "b2",
        neg="SELECT uid, session_id, count(DISTINCT iid) AS n FROM b2 WHERE action_bitmap = 0 GROUP BY uid, session_id",
    )
)
def scan_exposure_neg(spark, d):
    b = behavior_v2(spark, d)
    neg = b.where("action_bitmap = 0").groupBy("uid", "session_id").agg(F.collect_set("iid").alias("neg_iids"))
    pos = b.where("action_bitmap > 0").join(neg, ["uid", "session_id"], "left")
    return pos.select("uid", "session_id", "iid", "first_ts", "last_ts", "event_cnt", F.when(F.col("neg_iids").isNull(), 0).otherwise(F.size("neg_iids")).cast("bigint").alias("n_neg"))


@query("SELECT count(*) AS n, count(DISTINCT semantic_id) AS n_sids FROM (SELECT * FROM results ORDER BY sha256(concat(content_id, '42')), encoded_at LIMIT 500)")
def scan_results_sampled(spark, d):
    r = table(spark, d, "results")
    kept = r.orderBy(F.sha2(F.concat(F.col("content_id"), F.lit("42")), 256), "encoded_at").limit(500)
    return kept.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("semantic_id").alias("n_sids"))


@query(sql("SELECT r.uid, r.mid, r.rating::DOUBLE AS rating, r.ts, m.title FROM ratings r JOIN movies m USING (mid)", "ratings", "movies"))
def scan_csv_dat(spark, d):
    """Ratings and movies written as ``::``-separated and as headed text, and read again."""
    at = f"{scratch.folder(spark)}/text-{spark.sparkContext.applicationId}-{abs(hash(d))}"
    movies(spark, d).write.mode("overwrite").option("header", True).csv(f"{at}/movies.csv")
    readers.write_dat(ratings(spark, d).select("uid", "mid", "rating", "ts"), f"{at}/ratings.dat")
    m, r = readers.read_movies_csv(spark, f"{at}/movies.csv"), readers.read_ratings_dat(spark, f"{at}/ratings.dat")
    return r.join(m.select("mid", "title"), "mid").select("uid", "mid", "rating", "ts", "title")


_H = "concat('0x', substr(sha256({}), 1, 8))::UBIGINT::BIGINT"


@query(
    f"""WITH u AS (SELECT unnest(range(0, 240))::BIGINT AS uid), s AS (SELECT uid, unnest(range(1, 9 + {_H.format("uid || 'n'")} % 21))::BIGINT AS t FROM u),
g AS (SELECT uid, t, {_H.format("uid || 'g'")} % 6 AS own, {_H.format("uid || '_' || t || 'p'")} % 4 < 3 AS likes, {_H.format("uid || '_' || t || 'q'")} % 6 AS other, {_H.format("uid || '_' || t || 'm'")} % 20 AS k FROM s)
SELECT uid, (k * 6 + CASE WHEN likes THEN own ELSE other END)::BIGINT AS mid, CASE WHEN likes OR own = other THEN 4.0 ELSE 3.0 END::DOUBLE AS rating, 1700000000 + uid * 1000 + t AS ts FROM g"""
)
def gen_synthetic(spark, d):
    return readers.synthetic_ratings(spark)


@query("SELECT vec_id, min(p)::INT AS source FROM (SELECT vec_id, 0 AS p FROM embeddings WHERE vec_id % 3 = 0 UNION ALL SELECT vec_id, 1 FROM embeddings WHERE vec_id % 2 = 0 UNION ALL SELECT vec_id, 2 FROM embeddings) GROUP BY vec_id")
def scan_embedding_shards(spark, d):
    e = table(spark, d, "embeddings")
    return readers.merge_by_priority([e.where("vec_id % 3 = 0"), e.where("vec_id % 2 = 0"), e], "vec_id").select("vec_id", F.col("_source").alias("source"))


@query("SELECT DISTINCT vec_id FROM embeddings WHERE vec_id % 3 = 0 OR vec_id % 2 = 0")
def scan_cached_ids(spark, d):
    e = table(spark, d, "embeddings")
    return e.where("vec_id % 3 = 0").select("vec_id").union(e.where("vec_id % 2 = 0").select("vec_id")).distinct()


@query("SELECT * FROM (VALUES ('wide', 'dim', '128'), ('wide', 'layers', '3'), ('wide', 'lr', '0.2'), ('deep', 'dim', '64'), ('deep', 'layers', '4'), ('deep', 'lr', '0.2')) t(name, key, value)")
def scan_config_yaml(spark, d):
    """Variants of a configuration: the base, what the variants share, and each one's own keys; later ones win."""
    found = readers.resolve_variants({"dim": 32, "layers": 3, "lr": 0.1}, {"base": "_base.yaml", "description": "x", "dim": 64, "lr": 0.2, "variants": [{"name": "wide", "dim": 128}, {"name": "deep", "layers": 4}]}, "file")
    return spark.createDataFrame([(n, k, str(v)) for n, c in found for k, v in c.items()], "name string, key string, value string")


@query("SELECT 'run' || i AS run, 1000000 * i AS total_tokens, 20.0::DOUBLE - i AS ppl, 4::BIGINT AS last_step, 5.6::DOUBLE AS last_loss FROM (SELECT unnest([1, 2, 3])::BIGINT AS i)")
def scan_runs(spark, d):
    return readers.read_runs(spark, readers.write_sample_runs(spark))


@query(r"""SELECT DISTINCT p.content_id, CASE WHEN full_text IS NULL OR full_text = '' THEN p.content_id ELSE concat(p.content_id, chr(10), substring(full_text, 1, 4096)) END AS full_text, coalesce(nullif(content_language, ''), 'und') AS lang
 FROM pinned_content p JOIN (SELECT DISTINCT lower(trim(iid, E' \t\r\n')) AS iid FROM behavior_v2) e ON e.iid = p.content_id WHERE coalesce(nullif(content_language, ''), 'und') IN ('en', 'de', 'und') AND create_date >= DATE '2025-01-01'""")
def hive_sql_scan(spark, d):
    """The export of exposed content as one SQL statement."""
    table(spark, d, "pinned_content").createOrReplaceTempView("pinned_content")
    table(spark, d, "behavior_v2").select(item_key("iid").alias("iid")).createOrReplaceTempView("exposed")
    return spark.sql("""SELECT DISTINCT p.content_id, IF(full_text IS NULL OR full_text = '', p.content_id, CONCAT(p.content_id, '\n', SUBSTRING(full_text, 1, 4096))) AS full_text, COALESCE(NULLIF(content_language, ''), 'und') AS lang
        FROM pinned_content p INNER JOIN (SELECT DISTINCT iid FROM exposed) e ON e.iid = p.content_id WHERE COALESCE(NULLIF(content_language, ''), 'und') IN ('en', 'de', 'und') AND create_date >= DATE '2025-01-01'""")


@query("SELECT count(*) AS n, count(DISTINCT l_orderkey) AS orders, round(sum(l_quantity), 2) AS qty FROM lineitem")
def sink_parquet_sorted(spark, d):
    back = readers.write_sorted(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), "l_orderkey", 8)
    return back.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("l_orderkey").alias("orders"), F.round(F.sum("l_quantity"), 2).alias("qty"))


@query("SELECT semantic_id, count(*) AS n FROM results WHERE semantic_id IS NOT NULL GROUP BY 1 ORDER BY n DESC, semantic_id LIMIT 10")
def sink_results(spark, d):
    back = scratch.keep(table(spark, d, "results").select("content_id", "semantic_id", "embedding"), "results")
    return back.where("semantic_id IS NOT NULL").groupBy("semantic_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "semantic_id").limit(10)


@query("SELECT shard, count(*) AS n, min(p_partkey) AS first_key, max(p_partkey) AS last_key FROM (SELECT p_partkey, least((row_number() OVER (ORDER BY p_partkey) - 1) // (SELECT count(*) // 7 FROM part), 6)::INT AS shard FROM part) GROUP BY shard")
def sink_shards(spark, d):
    sharded = readers.contiguous_shards(table(spark, d, "part").select("p_partkey"), "p_partkey", 7)
    return sharded.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.min("p_partkey").alias("first_key"), F.max("p_partkey").alias("last_key"))


@query("SELECT count(*) AS n, sum(len(tokens))::BIGINT AS n_tokens, sum(list_sum(tokens))::BIGINT AS total FROM sequences")
def sink_seq_codec(spark, d):
    back = scratch.keep(table(spark, d, "sequences").select("uid", "tokens", "split_pos", "eval_cids"), "sequences")
    return back.agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("tokens").isNotNull(), F.size("tokens"))).alias("n_tokens"), F.sum(F.aggregate("tokens", F.lit(0), lambda a, x: a + x)).alias("total"))


@query("SELECT count(*) AS n, sum(len(tokens) // 3)::BIGINT AS n_sids FROM sequences WHERE len(tokens) >= 3")
def sink_pref_codec(spark, d):
    """Nested arrays of SIDs through parquet and back."""
    t = F.col("tokens")
    nested = table(spark, d, "sequences").where(F.size(t) >= 3).select("uid", F.transform(F.sequence(F.lit(0), F.floor(F.size(t) / 3).cast("int") - 1), lambda i: F.slice(t, i * 3 + 1, 3)).alias("sids"))
    return scratch.keep(nested, "pairs").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("sids")).alias("n_sids"))


@query("SELECT bucket, key, bucket || '/' || key AS path FROM (SELECT regexp_extract(u, '^s3://([^/]+)/(.*)$', 1) AS bucket, regexp_extract(u, '^s3://([^/]+)/(.*)$', 2) AS key FROM (SELECT 's3://' || lower(replace(p_brand, '#', '-')) || '/' || p_partkey || '/x.npy' AS u FROM part))")
def sync_object_store(spark, d):
    u = table(spark, d, "part").select(F.concat(F.lit("s3://"), F.lower(F.replace("p_brand", F.lit("#"), F.lit("-"))), F.lit("/"), F.col("p_partkey").cast("string"), F.lit("/x.npy")).alias("u"))
    return u.select(*readers.parse_object_path(F.col("u"))).withColumn("path", F.concat_ws("/", "bucket", "key"))


# --- filters and projections -------------------------------------------------


@query(sql("SELECT uid, iid, action_bitmap FROM b2 WHERE action_bitmap > 0", "b2"))
def filter_positive_raw(spark, d):
    return behavior_v2(spark, d).where("action_bitmap > 0").select("uid", "iid", "action_bitmap")


@query(sql(f"SELECT uid, iid, action_bitmap FROM b2 WHERE (action_bitmap & ~{bits.VIEW_EXIT}) > 0", "b2"))
def filter_positive_masked(spark, d):
    return behavior_v2(spark, d).where(bits.masked(F.col("action_bitmap")) > 0).select("uid", "iid", "action_bitmap")


@query(sql("SELECT uid, iid, action_bitmap FROM b2 WHERE action_bitmap <> 0", "b2"))
def filter_any_signal(spark, d):
    return behavior_v2(spark, d).where("action_bitmap <> 0").select("uid", "iid", "action_bitmap")


@query(sql(f"SELECT uid, iid, first_ts, CASE WHEN action_bitmap < 0 THEN 'negative' WHEN action_bitmap & {_STRONG} <> 0 THEN 'strong' WHEN action_bitmap & {_WEAK} <> 0 THEN 'weak' ELSE 'neutral' END AS tier FROM beh", "beh"))
def action_tier(spark, d):
    return behavior(spark, d).select("uid", "iid", "first_ts", bits.tier(F.col("action_bitmap")).alias("tier"))


_LEVEL = f"CASE WHEN (action_bitmap & ~4096) & {_TRADE} <> 0 THEN 3 WHEN (action_bitmap & ~4096) & {_STRONG} <> 0 THEN 2 ELSE 1 END"


@query(sql(f"SELECT uid, iid, {_LEVEL}::INT AS level FROM beh WHERE action_bitmap > 0", "beh"))
def action_level(spark, d):
    return behavior(spark, d).where("action_bitmap > 0").select("uid", "iid", bits.level(F.col("action_bitmap")).alias("level"))


@query(sql(f"SELECT uid, iid FROM beh WHERE (action_bitmap & ~4096) > 0 AND {_LEVEL} >= 2", "beh"))
def filter_min_level(spark, d):
    b = F.col("action_bitmap")
    return behavior(spark, d).where((bits.masked(b) > 0) & (bits.level(b) >= 2)).select("uid", "iid")


@query(sql("SELECT uid, iid FROM beh WHERE iid IN (SELECT content_id FROM sid)", "beh", "sid"))
def filter_known_items(spark, d):
    return behavior(spark, d).join(sids(spark, d), F.col("iid") == F.col("content_id"), "left_semi").select("uid", "iid")


@query(sql("SELECT content_id, count(*) AS n FROM (SELECT lower(trim(content_id, E' \\t\\r\\n')) AS content_id FROM results) WHERE content_id IN (SELECT iid FROM b2) GROUP BY 1", "b2"))
def filter_exposed(spark, d):
    exposed = behavior_v2(spark, d).select(F.col("iid").alias("content_id"))
    return table(spark, d, "results").select(item_key("content_id").alias("content_id")).join(exposed, "content_id", "left_semi").groupBy("content_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    sql(
        "SELECT * FROM (SELECT uid, mid, ts, okey, lno FROM k QUALIFY count(*) OVER (PARTITION BY uid) >= 5) QUALIFY dense_rank() OVER (ORDER BY uid) <= 2000",
        "ratings",
        r="SELECT *, lag(mid) OVER (PARTITION BY uid ORDER BY ts, okey, lno, mid) AS prev FROM ratings WHERE rating >= 4",
        k="SELECT * FROM r WHERE prev IS NULL OR prev <> mid",
    )
)
def filter_ratings(spark, d):
    from ..operators.sequences import filter_ratings as run

    return run(ratings(spark, d), 4, 5, 2000).select("uid", "mid", "ts", "okey", "lno")


@query(sql("SELECT iid, count(DISTINCT uid) AS users FROM beh WHERE action_bitmap > 0 GROUP BY iid HAVING count(DISTINCT uid) >= 5", "beh"))
def filter_min_count(spark, d):
    return behavior(spark, d).where("action_bitmap > 0").groupBy("iid").agg(F.count_distinct("uid").alias("users")).where("users >= 5")


@query("SELECT doc_id, CASE WHEN source IS NULL OR source = '' THEN substring(text, 1, 4096) ELSE substring(concat(source, chr(10), text), 1, 4096) END AS full_text FROM documents WHERE text IS NOT NULL")
def project_text(spark, d):
    from ..functions.project import full_text

    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", full_text(F.col("source"), F.col("text")).alias("full_text"))


@query("SELECT content_id, coalesce(nullif(images[1], ''), content_language, 'none') AS image FROM pinned_content")
def project_image(spark, d):
    from ..functions.project import first_image

    return table(spark, d, "pinned_content").select("content_id", first_image(F.get("images", F.lit(0)), F.col("content_language"), F.lit("none")).alias("image"))


@query("SELECT content_id, len(list_filter(coalesce(images, []), lambda x: x IS NOT NULL AND x <> ''))::INT AS n_images FROM pinned_content")
def normalise_images(spark, d):
    from ..functions.project import image_list

    p = table(spark, d, "pinned_content")
    return p.select("content_id", F.size(image_list(p, "images")).alias("n_images"))


@query(
    sql(
        "SELECT count(*) AS n FROM w WHERE last_mid <> target",
        "ratings",
        o="SELECT uid, mid, row_number() OVER (PARTITION BY uid ORDER BY ts, okey, lno, mid) AS rn, count(*) OVER (PARTITION BY uid) AS n FROM ratings WHERE rating >= 4",
        t="SELECT uid, mid AS target FROM o WHERE rn = n",
        w="SELECT o.uid, o.mid AS last_mid, t.target FROM o JOIN t USING (uid) WHERE o.rn < o.n",
    )
)
def contained_in_recent(spark, d):
    from ..operators.sequences import ordered, train_prefixes_without_target

    return train_prefixes_without_target(ordered(ratings(spark, d).where("rating >= 4"), "uid", ["ts", "okey", "lno", "mid"]), "uid", "mid").agg(F.count(F.lit(1)).alias("n"))


QUERIES, SQL = Q, S
