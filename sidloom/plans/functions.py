"""Scalar functions (inventory 2.8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import bits, scalars
from ..functions.textrules import consistency, scan_rules
from ..util import table
from .base import behavior, interactions, movies, sids, sql

Q: dict = {}
S: dict = {}


def query(oracle: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if oracle:
            S[f.__name__] = oracle
        return f

    return add


def seqs(spark, d):
    return table(spark, d, "sequences").where("uid IS NOT NULL AND size(tokens) >= 9").select("uid", "built_at", "tokens")


SEQ = "SELECT uid, built_at, tokens FROM sequences WHERE uid IS NOT NULL AND len(tokens) >= 9"


@query(sql("SELECT content_id, string_split(sid, '_')[1]::INT AS a, string_split(sid, '_')[3]::INT AS c, len(string_split(sid, '_'))::INT AS n FROM sid", "sid"))
def fn_sid_parse(spark, d):
    t = sids(spark, d).select("content_id", scalars.sid_parse(F.col("sid")).alias("t"))
    return t.select("content_id", F.col("t")[0].alias("a"), F.col("t")[2].alias("c"), F.size("t").alias("n"))


@query("SELECT uid, built_at, array_to_string(list_slice(tokens, 1, 3), '_') AS sid FROM (" + SEQ + ")")
def fn_sid_format(spark, d):
    return seqs(spark, d).select("uid", "built_at", scalars.sid_format(F.slice("tokens", 1, 3)).alias("sid"))


@query(sql("SELECT DISTINCT regexp_extract(sid, '^([^_]*_[^_]*)', 1) AS prefix FROM sid", "sid"))
def fn_sid_prefix(spark, d):
    return sids(spark, d).select(scalars.sid_prefix(F.col("sid"), 2).alias("prefix")).distinct()


_DEPTH = "CASE WHEN a[1] <> b[1] THEN 0 WHEN a[2] <> b[2] THEN 1 WHEN a[3] <> b[3] THEN 2 ELSE 3 END"
_PAIR = "SELECT uid, built_at, list_slice(tokens, 1, 3) AS a, [tokens[1], tokens[5], tokens[3]] AS b FROM (" + SEQ + ")"


def sid_pairs(spark, d):
    t = F.col("tokens")
    return seqs(spark, d).select("uid", "built_at", F.slice(t, 1, 3).alias("a"), F.array(t[0], t[4], t[2]).alias("b"))


@query(f"SELECT uid, built_at, {_DEPTH}::INT AS depth FROM ({_PAIR})")
def fn_prefix_match_depth(spark, d):
    return sid_pairs(spark, d).select("uid", "built_at", scalars.match_depth(F.col("a"), F.col("b")).alias("depth"))


@query(f"SELECT uid, built_at, round(((a[1] = b[1])::INT + (a[2] = b[2])::INT + (a[3] = b[3])::INT) / 3.0::DOUBLE, 6) AS overlap FROM ({_PAIR})")
def fn_token_overlap(spark, d):
    return sid_pairs(spark, d).select("uid", "built_at", F.round(scalars.token_overlap(F.col("a"), F.col("b")), 6).alias("overlap"))


@query(f"SELECT uid, built_at, CASE WHEN a = b THEN NULL WHEN {_DEPTH} = 0 THEN 'easy' WHEN {_DEPTH} = 1 THEN 'medium' ELSE 'hard' END AS difficulty FROM ({_PAIR})")
def fn_reject_difficulty(spark, d):
    return sid_pairs(spark, d).select("uid", "built_at", scalars.reject_difficulty(F.col("a"), F.col("b")).alias("difficulty"))


_QUAL = "CASE WHEN action_bitmap < 0 THEN -1.0 ELSE log10(1.0 + " + " + ".join(f"CASE WHEN action_bitmap & {b} <> 0 THEN {w} ELSE 0.0 END" for b, w in bits.QUALITY.items()) + ") END"


@query(sql(f"SELECT uid, iid, round(({_QUAL})::DOUBLE, 6) AS quality FROM beh", "beh"))
def fn_bitmap_quality(spark, d):
    return behavior(spark, d).select("uid", "iid", F.round(bits.quality(F.col("action_bitmap")), 6).alias("quality"))


@query(sql("SELECT uid, iid, round(exp(-greatest((1738368000 - last_ts) / 3600.0::DOUBLE, 0.0) / 24.0), 6) AS fresh FROM beh", "beh"))
def fn_freshness(spark, d):
    return behavior(spark, d).select("uid", "iid", F.round(scalars.freshness((F.lit(1738368000) - F.col("last_ts")) / 3600.0), 6).alias("fresh"))


_B = "[" + ", ".join(map(str, scalars.GAPS)) + "]"


@query(f"SELECT x AS delta, len(list_filter({_B}, lambda b: b <= greatest(x, 0)))::INT AS vec_bucket, len(list_filter({_B}, lambda b: b < greatest(x, 0)))::INT AS scalar_bucket FROM (SELECT unnest([-5, 0, 29, 30, 31, 120, 1209600, 1209601])::BIGINT AS x)")
def fn_time_bucket(spark, d):
    x = spark.createDataFrame([(v,) for v in (-5, 0, 29, 30, 31, 120, 1209600, 1209601)], "delta bigint")
    return x.select("delta", scalars.time_bucket(F.col("delta"), "right").alias("vec_bucket"), scalars.time_bucket(F.col("delta"), "left").alias("scalar_bucket"))


@query(sql("SELECT content_id, (a % 8 + 8 * (b % 5) + 40 * (c % 6))::BIGINT AS code FROM sid", "sid"))
def fn_mixed_radix_encode(spark, d):
    digits = F.array(F.col("a") % 8, F.col("b") % 5, F.col("c") % 6)
    return sids(spark, d).select("content_id", scalars.mixed_radix_encode(digits, [8, 5, 6]).alias("code"))


@query("SELECT p_partkey, (p_partkey % 8)::INT AS x, ((p_partkey // 8) % 5)::INT AS y, ((p_partkey // 40) % 6)::INT AS z FROM part")
def fn_mixed_radix_decode(spark, d):
    t = table(spark, d, "part").select("p_partkey", scalars.mixed_radix_decode(F.col("p_partkey"), [8, 5, 6]).alias("t"))
    return t.select("p_partkey", *[F.col("t")[i].alias(n) for i, n in enumerate("xyz")])


@query(
    """SELECT vec_id, least(greatest(round_even(tanh(embedding[1]::DOUBLE * 8) * 2, 0) + 2, 0), 4)::INT AS odd, least(greatest(round_even(tanh(embedding[2]::DOUBLE * 8) * 2 - 0.5, 0) + 2, 0), 3)::INT AS even,
 least(greatest(round_even(tanh(embedding[3]::DOUBLE * 8) * 1 - 0.5, 0) + 1, 0), 1)::INT AS two FROM embeddings"""
)
def fn_fsq_quantize(spark, d):
    z = lambda i: F.col("embedding")[i].cast("double") * 8
    return table(spark, d, "embeddings").select("vec_id", scalars.fsq_quantize(z(0), 5).alias("odd"), scalars.fsq_quantize(z(1), 4).alias("even"), scalars.fsq_quantize(z(2), 2).alias("two"))


@query("SELECT p_partkey, (p_size % 5 - 2)::DOUBLE AS odd, (p_size % 4 - 2 + 1)::DOUBLE AS even FROM part")
def fn_fsq_dequantize(spark, d):
    return table(spark, d, "part").select("p_partkey", scalars.fsq_dequantize(F.col("p_size") % 5, 5).alias("odd"), scalars.fsq_dequantize(F.col("p_size") % 4, 4).alias("even"))


@query("SELECT n, prod::BIGINT AS size, floor(2 * log2(4096) + total)::INT AS bits FROM (SELECT * FROM (VALUES ('a', 8*5*5*5, log2(8)+3*log2(5)), ('b', 4*4*4, 3*log2(4)), ('c', 1024, 10.0)) t(n, prod, total))")
def fn_codebook_size(spark, d):
    lv = spark.createDataFrame([("a", [8, 5, 5, 5]), ("b", [4, 4, 4]), ("c", [2] * 10)], "n string, levels array<int>")
    size = F.aggregate("levels", F.lit(1).cast("bigint"), lambda a, x: a * x)
    total = F.aggregate("levels", F.lit(0.0), lambda a, x: a + F.log2(x))
    return lv.select("n", size.alias("size"), F.floor(2 * F.log2(F.lit(4096)) + total).cast("int").alias("bits"))


@query(sql("SELECT content_id, (a | (b << 8) | (c << 16))::BIGINT AS by8, ((a & 15) | ((b & 15) << 4) | ((c & 15) << 8))::BIGINT AS by4, (a | (b::BIGINT << 10) | (c::BIGINT << 20))::BIGINT AS by10 FROM sid", "sid"))
def fn_bit_pack(spark, d):
    c = F.array("a", "b", "c")
    low = F.transform(c, lambda x: x.bitwiseAND(F.lit(15)))
    return sids(spark, d).select("content_id", scalars.pack_bits(c, 8, 3).alias("by8"), scalars.pack_bits(low, 4, 3).alias("by4"), scalars.pack_bits(c, 10, 3).alias("by10"))


@query("SELECT p_partkey, (p_partkey & 15)::INT AS x, ((p_partkey >> 4) & 15)::INT AS y, ((p_partkey >> 8) & 15)::INT AS z FROM part")
def fn_bit_unpack(spark, d):
    t = table(spark, d, "part").select("p_partkey", scalars.unpack_bits(F.col("p_partkey"), 4, 3).alias("t"))
    return t.select("p_partkey", *[F.col("t")[i].alias(n) for i, n in enumerate("xyz")])


@query("SELECT vec_id, round(embedding[1]::DOUBLE / greatest(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 1e-12), 5) AS first FROM embeddings")
def fn_l2_normalize(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.round(scalars.l2_normalize(F.col("embedding"))[0], 5).alias("first"))


_V2 = "SELECT a.vec_id, a.embedding::DOUBLE[] AS x, b.embedding::DOUBLE[] AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"


@query(f"SELECT vec_id, round(list_dot_product(x, y), 5) AS dot, round(list_dot_product(x, y) / (sqrt(list_dot_product(x, x)) * sqrt(list_dot_product(y, y))), 5) AS cosine, round(list_dot_product(x, x) + list_dot_product(y, y) - 2 * list_dot_product(x, y), 4) AS sqdist FROM ({_V2})")
def fn_cosine(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("x"))
    two = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("y")), "vec_id")
    x, y = F.col("x"), F.col("y")
    return two.select("vec_id", F.round(scalars.dot(x, y), 5).alias("dot"), F.round(scalars.cosine(x, y), 5).alias("cosine"), F.round(scalars.squared_distance(x, y), 4).alias("sqdist"))


@query("SELECT p_partkey, (('0x' || right(sha256(p_partkey::VARCHAR), 1))::INT % 8)::INT AS shard FROM part")
def fn_shard_sha(spark, d):
    return table(spark, d, "part").select("p_partkey", scalars.shard_of(F.col("p_partkey").cast("string")).alias("shard"))


@query("SELECT p_partkey, concat('0x', substr(sha256(p_name), 1, 16))::UBIGINT::VARCHAR AS h FROM part")
def fn_hash64(spark, d):
    return table(spark, d, "part").select("p_partkey", scalars.hash64(F.col("p_name")).cast("string").alias("h"))


@query("SELECT p_partkey, (h % 64)::INT AS index, CASE WHEN (h // 256) % 2 = 0 THEN -1.0 ELSE 1.0 END::DOUBLE AS sign FROM (SELECT p_partkey, concat('0x', substr(sha256(p_name), 1, 16))::UBIGINT AS h FROM part)")
def fn_hash_feature(spark, d):
    return table(spark, d, "part").select("p_partkey", scalars.hash_feature(F.col("p_name"), 64).alias("f")).select("p_partkey", "f.index", "f.sign")


@query("SELECT doc_id, len(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x <> ''))::INT AS n FROM documents WHERE text IS NOT NULL")
def fn_tokenize(spark, d):
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.size(scalars.tokenize(F.col("text"))).alias("n"))


@query(sql("SELECT mid, 'genre:' || lower(string_split(genres, '|')[1]) || ',genre:' || lower(string_split(genres, '|')[2]) AS tokens FROM movies", "movies"))
def fn_genre_tokens(spark, d):
    return movies(spark, d).select("mid", F.array_join(scalars.genre_tokens(F.col("genres")), ",").alias("tokens"))


@query("SELECT title, CASE WHEN regexp_matches(title, '\\((\\d{4})\\)') THEN 'year:' || substr(regexp_extract(title, '\\((\\d{4})\\)', 1), 1, 3) || '0s' END AS decade FROM (SELECT p_name || CASE WHEN p_size % 2 = 0 THEN ' (' || (1950 + p_size)::VARCHAR || ')' ELSE '' END AS title FROM part)")
def fn_decade(spark, d):
    t = table(spark, d, "part").select(F.concat("p_name", F.when(F.col("p_size") % 2 == 0, F.concat(F.lit(" ("), (1950 + F.col("p_size")).cast("string"), F.lit(")"))).otherwise("")).alias("title"))
    return t.select("title", scalars.decade(F.col("title")).alias("decade"))


@query(sql("SELECT mid, 'Movie title: ' || title || chr(10) || 'Genres: ' || replace(genres, '|', ', ') AS prompt FROM movies", "movies"))
def fn_prompt_text(spark, d):
    return movies(spark, d).select("mid", scalars.prompt_text(F.col("title"), F.col("genres")).alias("prompt"))


@query("SELECT u, substr(md5(u), 1, 2) || '/' || md5(u) || '.jpg' AS key FROM (SELECT unnest(images) AS u FROM pinned_content)")
def fn_image_key(spark, d):
    u = table(spark, d, "pinned_content").select(F.explode("images").alias("u"))
    return u.select("u", scalars.image_key(F.col("u")).alias("key"))


@query("SELECT DISTINCT create_date, strftime(create_date, '%Y%m%d')::INT AS date_key FROM documents")
def fn_date_key(spark, d):
    return table(spark, d, "documents").select("create_date", scalars.date_key(F.col("create_date")).alias("date_key")).distinct()


@query("SELECT d::DATE AS day FROM (SELECT unnest(generate_series(min(create_date), max(create_date), INTERVAL 1 DAY)) AS d FROM documents)")
def fn_date_range(spark, d):
    return table(spark, d, "documents").agg(F.min("create_date").alias("a"), F.max("create_date").alias("b")).select(F.explode(F.sequence("a", "b")).alias("day"))


@query("SELECT p_partkey, substr(sha256('{\"brand\":\"' || p_brand || '\",\"size\":' || p_size || ',\"type\":\"' || p_type || '\"}'), 1, 12) AS hash FROM part")
def fn_config_hash(spark, d):
    """Hash of the configuration in key order, without keys that don't count."""
    canon = F.to_json(F.struct(F.col("p_brand").alias("brand"), F.col("p_size").alias("size"), F.col("p_type").alias("type")))
    return table(spark, d, "part").select("p_partkey", F.substring(F.sha2(canon, 256), 1, 12).alias("hash"))


@query("SELECT p_partkey, CASE WHEN p_size <= 5 THEN 'excellent' WHEN p_size <= 15 THEN 'good' WHEN p_size <= 30 THEN 'acceptable' ELSE 'poor' END AS low, CASE WHEN p_size >= 40 THEN 'excellent' WHEN p_size >= 30 THEN 'good' WHEN p_size >= 10 THEN 'acceptable' ELSE 'poor' END AS high FROM part")
def fn_quality_status(spark, d):
    s = F.col("p_size").cast("double")
    return table(spark, d, "part").select("p_partkey", scalars.quality_status(s, [5, 15, 30]).alias("low"), scalars.quality_status(s, [40, 30, 10], False).alias("high"))


@query("SELECT name, CASE WHEN regexp_matches(name, 'rate|utilization|coverage') THEN printf('%.2f%%', v * 100) ELSE printf('%.4f', v) END AS shown FROM (VALUES ('collision_rate', 0.0175), ('gini', 0.3914), ('codebook_utilization', 0.98), ('entropy', 0.87654)) t(name, v)")
def fn_format_value(spark, d):
    t = spark.createDataFrame([("collision_rate", 0.0175), ("gini", 0.3914), ("codebook_utilization", 0.98), ("entropy", 0.87654)], "name string, v double")
    pct = F.col("name").rlike("rate|utilization|coverage")
    return t.select("name", F.when(pct, F.format_string("%.2f%%", F.col("v") * 100)).otherwise(F.format_string("%.4f", "v")).alias("shown"))


@query(
    r"""SELECT doc_id, rule, count(*) AS lines FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL), (VALUES ('email', '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}'), ('bucket', 's3://[a-z0-9.-]+'), ('token', '\b(?:ghp|hf|sk)_[A-Za-z0-9]{16,}'), ('run', '\brun-r\d{3}\b'), ('seed', '\bSeed \d+ and seed \d+\b')) r(rule, pattern)
 WHERE regexp_matches(line, pattern) GROUP BY ALL"""
)
def fn_regex_scan(spark, d):
    rules = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"), ("bucket", r"s3://[a-z0-9.-]+"), ("token", r"\b(?:ghp|hf|sk)_[A-Za-z0-9]{16,}"), ("run", r"\brun-r\d{3}\b"), ("seed", r"\bSeed \d+ and seed \d+\b")]
    return scan_rules(table(spark, d, "documents"), "doc_id", "text", rules)


@query("SELECT doc_id FROM documents WHERE len(list_filter(string_split(text, chr(10)), lambda l: contains(l, 'ntp_loss') AND contains(l, '\"step\": 50') AND contains(l, 'grad_norm'))) > 0")
def fn_numeric_consistency(spark, d):
    return consistency(table(spark, d, "documents"), "doc_id", "text", "ntp_loss", ['"step": 50', "grad_norm"])


@query("SELECT uid, built_at, len(list_filter(range(1, len(tokens) - 4), lambda j: list_slice(tokens, 4, len(tokens))[j:j+2] = list_slice(tokens, 1, 3))) > 0 AS seen FROM (" + SEQ + ")")
def fn_contains_subsequence(spark, d):
    t = F.col("tokens")
    return seqs(spark, d).select("uid", "built_at", scalars.contains_run(F.slice(t, F.lit(4), F.size(t)), F.slice(t, 1, 3)).alias("seen"))



@query("SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]), 5) AS dot FROM embeddings")
def fn_dot(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.round(scalars.dot(F.col("embedding"), F.col("embedding")), 5).alias("dot"))


@query(f"SELECT vec_id, round(list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - y[i]) * (x[i] - y[i]))), 4) AS sqdist FROM ({_V2})")
def fn_sqdist(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("x"))
    two = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("y")), "vec_id")
    return two.select("vec_id", F.round(scalars.squared_distance(F.col("x"), F.col("y")), 4).alias("sqdist"))


QUERIES, SQL = Q, S
