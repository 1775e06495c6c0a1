"""Sequences, preferences, rewards, recall, quantisers and losses (inventory 2.10 to 2.12)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import scratch
from ..functions import bits, scalars
from ..operators import losses, prefs, relate, vq
from ..operators import sequences as seq
from ..util import table
from .base import behavior, behavior_v2, sids, sql
from .relations import _GAPS, ORD, ORDERED, liked

Q: dict = {}
S: dict = {}


def query(oracle: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if oracle:
            S[f.__name__] = oracle
        return f

    return add


_LV = f"CASE WHEN (action_bitmap & ~4096) & {sum(bits.TRADE)} <> 0 THEN 3 WHEN (action_bitmap & ~4096) & {sum(bits.STRONG)} <> 0 THEN 2 ELSE 1 END"
N_EVAL = 3000


def _seq_sql(rows: str, negatives: bool = False, **ctes: str) -> str:
    """Sequences from rows (uid, iid, first_ts, tie, level, a, b, c[, neg])."""
    back, there = "first_ts DESC, iid DESC, tie DESC", "first_ts, iid, tie"
    per = lambda x: f"array_to_string(flatten(list([{x}, {x}, {x}] ORDER BY {there})), ',')"
    more = f", array_to_string(flatten(list(neg ORDER BY {there})), ',') AS neg_l0" if negatives else ""
    return sql(
        f"""SELECT uid, array_to_string(flatten(list([a, b, c] ORDER BY {there})), ',') AS tokens, (3 * count(*) FILTER (first_ts <= s))::INT AS split_pos, coalesce(array_to_string(list(iid ORDER BY {there}) FILTER (first_ts > s), ','), '') AS eval_cids,
 {per("g")} AS time_gaps, {per("level")} AS action_levels, (max(first_ts) - min(first_ts))::BIGINT AS span{more} FROM r, x GROUP BY uid""",
        "b2" if negatives else "beh",
        "sid",
        **ctes,
        p=rows,
        x=f"SELECT first_ts AS s FROM (SELECT first_ts, row_number() OVER (ORDER BY first_ts) AS rn, count(*) OVER () AS n FROM p) WHERE rn = least(greatest(n - {N_EVAL}, 0), n - 1) + 1",
        t=f"SELECT * FROM p QUALIFY count(*) OVER (PARTITION BY uid) >= 2 AND row_number() OVER (PARTITION BY uid ORDER BY {back}) <= {seq.MAX_ITEMS}",
        r=f"SELECT *, CASE WHEN lag(first_ts) OVER w IS NULL THEN 0 ELSE len(list_filter({_GAPS}, lambda b: b <= greatest(first_ts - lag(first_ts) OVER w, 0))) END AS g FROM t WINDOW w AS (PARTITION BY uid ORDER BY {there})",
    )


def _flat(df):
    s = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return df.select("uid", s("tokens"), "split_pos", F.array_join("eval_cids", ",").alias("eval_cids"), s("time_gaps"), s("action_levels"), "span", *([s("neg_l0")] if "neg_l0" in df.columns else []))


@query(_seq_sql(f"SELECT uid, iid, first_ts, 0 AS tie, {_LV}::INT AS level, a, b, c FROM beh JOIN sid ON iid = content_id WHERE (action_bitmap & ~4096) > 0"))
def seq_build(spark, d):
    return _flat(seq.dispatch(scratch.keep(sids(spark, d), "sids"), behavior=behavior(spark, d), n_eval=N_EVAL))


_V2NEG = "SELECT uid, session_id, list_sort(list(DISTINCT {'iid': iid, 'a': a})) AS neg FROM b2 JOIN sid ON iid = content_id WHERE action_bitmap = 0 GROUP BY uid, session_id"
_V2 = "SELECT uid, session_id, iid, bit_or(action_bitmap)::INT AS action_bitmap, min(first_ts) AS first_ts FROM b2 GROUP BY ALL"


def _session_rows(spark, d):
    """One row per user, session and item; repeated deliveries are one."""
    return behavior_v2(spark, d).groupBy("uid", "session_id", "iid").agg(F.bit_or("action_bitmap").alias("action_bitmap"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"), F.sum("event_cnt").alias("event_cnt"))


@query(
    _seq_sql(
        f"SELECT p.uid, p.iid, p.first_ts, p.session_id AS tie, {_LV}::INT AS level, a, b, c, list_resize(list_slice(list_transform(list_filter(coalesce(neg, []), lambda x: x.iid <> p.iid), lambda x: x.a), 1, 5), 5, -1) AS neg FROM v2 p JOIN sid ON p.iid = content_id LEFT JOIN neg n ON p.uid = n.uid AND p.session_id = n.session_id WHERE (action_bitmap & ~4096) > 0",
        True,
        v2=_V2,
        neg=_V2NEG.replace("FROM b2", "FROM v2"),
    )
)
def seq_build_v2(spark, d):
    """Sequences of session rows with the first codes of each item's session negatives."""
    return _flat(seq.dispatch(scratch.keep(sids(spark, d), "sids"), b2=_session_rows(spark, d), n_eval=N_EVAL))


_EXPOSURE = "SELECT p.uid, p.iid, p.first_ts, n.neg_iids FROM v2 p LEFT JOIN (SELECT uid, session_id, list_sort(list(DISTINCT iid)) AS neg_iids FROM v2 WHERE action_bitmap = 0 GROUP BY uid, session_id) n ON p.uid = n.uid AND p.session_id = n.session_id WHERE p.action_bitmap > 0"


def _exposure(spark, d):
    """Positives with all exposed items of their session as an array, the form of an export."""
    b = _session_rows(spark, d)
    neg = b.where("action_bitmap = 0").groupBy("uid", "session_id").agg(F.array_sort(F.collect_set("iid")).alias("neg_iids"))
    rows = b.where("action_bitmap > 0").select("uid", "session_id", "iid", "first_ts").join(neg, ["uid", "session_id"], "left")
    one = rows.groupBy("uid", "iid").agg(F.min(F.struct("first_ts", "session_id", "neg_iids")).alias("x"))  # an item's first session
    return one.select("uid", "iid", "x.first_ts", "x.neg_iids")


@query(
    _seq_sql(
        "SELECT e.uid, e.iid, e.first_ts, 0 AS tie, 1 AS level, a, b, c, list_resize(list_slice(coalesce(l0, []), 1, 5), 5, -1) AS neg FROM e JOIN sid ON e.iid = content_id LEFT JOIN l USING (uid, iid)",
        True,
        v2=_V2,
        e=_EXPOSURE.replace("SELECT p.uid, p.iid, p.first_ts, n.neg_iids", "SELECT p.uid, p.iid, p.first_ts, n.neg_iids, p.session_id") + " QUALIFY row_number() OVER (PARTITION BY p.uid, p.iid ORDER BY p.first_ts, p.session_id) = 1",
        l="SELECT uid, x.iid, list(a ORDER BY x.neg) AS l0 FROM (SELECT uid, iid, unnest(neg_iids) AS neg FROM e) x JOIN sid ON x.neg = content_id GROUP BY uid, x.iid",
    )
)
def seq_build_exposure(spark, d):
    """Sequences of rows that carry their negatives as an array; the item itself is not left out."""
    return _flat(seq.dispatch(scratch.keep(sids(spark, d), "sids"), exposure=_exposure(spark, d), n_eval=N_EVAL))


@query(
    sql(
        "SELECT 'session' AS source, count(*) AS users, sum(n)::BIGINT AS items FROM v UNION ALL SELECT 'exposure', count(*), sum(n)::BIGINT FROM e UNION ALL SELECT 'behavior', count(*), sum(n)::BIGINT FROM h",
        "b2",
        "beh",
        "sid",
        v2=_V2,
        v=f"SELECT uid, least(count(*), {seq.MAX_ITEMS}) AS n FROM v2 SEMI JOIN sid ON iid = content_id WHERE (action_bitmap & ~4096) > 0 GROUP BY uid HAVING count(*) >= 2",
        e=f"SELECT uid, least(count(DISTINCT iid), {seq.MAX_ITEMS}) AS n FROM v2 SEMI JOIN sid ON iid = content_id WHERE action_bitmap > 0 GROUP BY uid HAVING count(DISTINCT iid) >= 2",
        h=f"SELECT uid, least(count(*), {seq.MAX_ITEMS}) AS n FROM beh SEMI JOIN sid ON iid = content_id WHERE (action_bitmap & ~4096) > 0 GROUP BY uid HAVING count(*) >= 2",
    )
)
def seq_dispatch(spark, d):
    """What each choice of sources leads to: session rows come before inline negatives, and these before plain behavior."""
    s = scratch.keep(sids(spark, d), "sids")
    given = {"behavior": behavior(spark, d), "exposure": _exposure(spark, d), "b2": _session_rows(spark, d)}
    choices = [("session", ["behavior", "exposure", "b2"]), ("exposure", ["behavior", "exposure"]), ("behavior", ["behavior"])]
    out = [seq.dispatch(s, n_eval=N_EVAL, **{k: given[k] for k in names}).agg(F.count(F.lit(1)).alias("users"), (F.sum(F.size("tokens")) / seq.LAYERS).cast("bigint").alias("items")).select(F.lit(n).alias("source"), "users", "items") for n, names in choices]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("SELECT uid, built_at, array_to_string(list_transform(action_levels, lambda x, i: CASE WHEN i % 3 = 0 THEN x ELSE 0 END), ',') AS levels FROM sequences WHERE action_levels IS NOT NULL")
def seq_action_l2_only(spark, d):
    a = F.transform("action_levels", lambda x, i: F.when((i + 1) % 3 == 0, x).otherwise(0))
    return table(spark, d, "sequences").where("action_levels IS NOT NULL").select("uid", "built_at", F.array_join(a.cast("array<string>"), ",").alias("levels"))


@query("SELECT uid, built_at, greatest(least(split_pos, len(tokens)) - 1, 0)::INT AS n_train, (greatest(len(tokens) - 1, 0) - greatest(least(split_pos, len(tokens)) - 1, 0))::INT AS n_eval FROM sequences WHERE tokens IS NOT NULL")
def seq_masks(spark, d):
    return prefs.masks(table(spark, d, "sequences"))


@query("SELECT uid, built_at, i * 3 - 1 AS pos, tokens[i * 3 + 1] AS neg FROM (SELECT uid, built_at, tokens, unnest(range(1, len(tokens) // 3)) AS i FROM sequences WHERE len(tokens) >= 6)")
def seq_neg_alignment(spark, d):
    """Row of item i at the position before its first token; the first item has none."""
    s = table(spark, d, "sequences").where("size(tokens) >= 6").select("uid", "built_at", "tokens", F.explode(F.sequence(F.lit(1), F.floor(F.size("tokens") / 3).cast("int") - 1)).alias("i"))
    return s.select("uid", "built_at", (F.col("i").cast("bigint") * 3 - 1).alias("pos"), F.get("tokens", F.col("i") * 3).alias("neg"))


_EV = "SELECT uid, built_at, tokens, unnest(range(greatest(split_pos // 3, 1), len(tokens) // 3)) AS i FROM sequences WHERE len(tokens) >= 3"


@query("SELECT uid, built_at, i::INT AS item, (i * 3)::INT AS n_context, array_to_string(list_slice(tokens, i * 3 + 1, i * 3 + 3), '_') AS target FROM (" + _EV + ")")
def eval_items(spark, d):
    e = prefs.eval_items(table(spark, d, "sequences"))
    return e.select("uid", "built_at", "item", F.size("context").alias("n_context"), scalars.sid_format(F.col("target")).alias("target"))


@query("SELECT uid, built_at, array_to_string(list_slice(list_slice(tokens, 1, split_pos), -510, -1), ',') AS context FROM sequences WHERE split_pos > 0 AND len(tokens) > 0")
def eval_context_pool(spark, d):
    """With the whole window of the inventory."""
    return _context_pool(spark, d, seq.LAYERS * seq.MAX_ITEMS)


def _context_pool(spark, d, most):
    t = F.slice("tokens", F.lit(1), F.col("split_pos"))
    last = F.when(F.size(t) > most, F.slice(t, -most, most)).otherwise(t)
    return table(spark, d, "sequences").where("split_pos > 0 AND size(tokens) > 0").select("uid", "built_at", F.array_join(last.cast("array<string>"), ",").alias("context"))


_TIER = f"CASE WHEN action_bitmap < 0 THEN 'negative' WHEN action_bitmap & {sum(bits.STRONG)} <> 0 THEN 'strong' WHEN action_bitmap & {sum(bits.WEAK)} <> 0 THEN 'weak' ELSE 'neutral' END"
_HISTORY = dict(
    t=f"SELECT uid, iid, first_ts, {_TIER} AS tier FROM beh WHERE action_bitmap <> 0 AND iid IN (SELECT content_id FROM sid)",
    h="SELECT *, row_number() OVER (PARTITION BY uid ORDER BY first_ts, iid) AS rn FROM t QUALIFY row_number() OVER (PARTITION BY uid ORDER BY first_ts DESC, iid DESC) <= 170",
    g="SELECT uid, list(iid ORDER BY first_ts, iid) FILTER (tier = 'negative') AS neg, list(iid ORDER BY first_ts, iid) FILTER (tier = 'weak') AS weak FROM h GROUP BY uid",
    c="SELECT h.uid, h.iid, count(*) AS n_context FROM h JOIN h b ON b.uid = h.uid AND b.rn < h.rn AND b.tier IN ('strong', 'weak') WHERE h.tier = 'strong' GROUP BY ALL",
)


@query(sql("SELECT c.uid, c.iid, n_context::INT AS n_context, coalesce(array_to_string(list_slice(list_filter(neg, lambda x: x <> c.iid), 1, 5), ','), '') AS easy, coalesce(array_to_string(list_slice(list_filter(weak, lambda x: x <> c.iid), 1, 5), ','), '') AS hard FROM c JOIN g USING (uid)", "beh", "sid", **_HISTORY))
def pref_rf_pairs(spark, d):
    """With the whole window of the inventory."""
    return _rf_pairs(spark, d, seq.MAX_ITEMS)


def history(spark, d, most=seq.MAX_ITEMS):
    """The kept window of each user's known items with their tier, rn in the order of time."""
    b = behavior(spark, d).where("action_bitmap <> 0").join(sids(spark, d).select(F.col("content_id").alias("iid")), "iid", "left_semi")
    back = F.row_number().over(Window.partitionBy("uid").orderBy(F.desc("first_ts"), F.desc("iid")))
    return b.select("uid", "iid", "first_ts", bits.tier(F.col("action_bitmap")).alias("tier")).withColumn("back", back).where(F.col("back") <= most).withColumn("rn", -F.col("back"))


def _rf_pairs(spark, d, most):
    p = prefs.feedback_pairs(history(spark, d, most))
    return p.select("uid", "iid", F.size("context").alias("n_context"), F.array_join("easy", ",").alias("easy"), F.array_join("hard", ",").alias("hard"))


@query(sql("SELECT t, EXISTS (SELECT 1 FROM sid WHERE sid.sid = t) AS legal FROM (SELECT DISTINCT array_to_string(tokens[1:3], '_') AS t FROM sequences WHERE len(tokens) >= 3)", "sid"))
def rw_format(spark, d):
    t = table(spark, d, "sequences").where("size(tokens) >= 3").select(scalars.sid_format(F.slice("tokens", 1, 3)).alias("sid")).distinct()
    known = sids(spark, d).select("sid").distinct().withColumn("k", F.lit(True))
    return t.join(known, "sid", "left").select(F.col("sid").alias("t"), F.coalesce("k", F.lit(False)).alias("legal"))


@query("SELECT uid, built_at, CASE WHEN len(list_filter(range(1, len(tokens) - 4), lambda j: list_slice(tokens, j, j + 2) = list_slice(tokens, -3, -1))) > 0 THEN -1.0 ELSE 0.0 END::DOUBLE AS reward FROM sequences WHERE uid IS NOT NULL AND len(tokens) >= 9")
def rw_novelty(spark, d):
    t = F.col("tokens")
    seen = scalars.contains_run(F.slice(t, F.lit(1), F.size(t) - 3), F.slice(t, -3, 3))
    return table(spark, d, "sequences").where("uid IS NOT NULL AND size(tokens) >= 9").select("uid", "built_at", F.when(seen, -1.0).otherwise(0.0).alias("reward"))


@query(sql("SELECT content_id, round(0.7 * CASE WHEN c % 2 = 0 THEN 1.0 ELSE 0.0 END + 0.3 * (b / 255.0::DOUBLE), 6)::DOUBLE AS reward FROM sid", "sid"))
def rw_composite(spark, d):
    from ..operators.rewards import composite

    s = sids(spark, d).withColumn("r_format", F.when(F.col("c") % 2 == 0, 1.0).otherwise(0.0)).withColumn("r_score", F.col("b") / 255.0)
    return s.select("content_id", F.round(composite({"r_format": 0.7, "r_score": 0.3}), 6).alias("reward"))


@query(sql("SELECT 0 AS layer, '' AS prefix, a AS next FROM sid GROUP BY a UNION ALL SELECT 1, a::VARCHAR, b FROM sid GROUP BY a, b UNION ALL SELECT 2, a || '_' || b, c FROM sid GROUP BY a, b, c", "sid"))
def trie_build(spark, d):
    return prefs.trie(sids(spark, d))


@query(sql("SELECT prefix, array_to_string(list_sort(list(next)), ',') AS valid FROM (SELECT DISTINCT a || '_' || b AS prefix, c AS next FROM sid) GROUP BY prefix", "sid"))
def trie_valid(spark, d):
    t = prefs.trie(sids(spark, d)).where("layer = 2").groupBy("prefix").agg(F.array_sort(F.collect_list("next")).alias("v"))
    return t.select("prefix", F.array_join(F.col("v").cast("array<string>"), ",").alias("valid"))


# --- other model tables ------------------------------------------------------

_NLL = "SELECT 'layer' || layer AS part, ln(total / n::DOUBLE) AS nll, n FROM (SELECT 1 AS layer, count(*) AS n, (SELECT count(*) FROM sid) AS total FROM sid GROUP BY a UNION ALL SELECT 2, count(*), any_value(t) FROM (SELECT a, b, count(*) OVER (PARTITION BY a) AS t FROM sid) GROUP BY a, b UNION ALL SELECT 3, count(*), any_value(t) FROM (SELECT a, b, c, count(*) OVER (PARTITION BY a, b) AS t FROM sid) GROUP BY a, b, c)"


@query(sql("SELECT coalesce(part, 'all') AS part, round(exp(sum(nll * n) / sum(n)), 5) AS ppl, sum(n)::BIGINT AS n FROM x GROUP BY GROUPING SETS ((), (part))", "sid", x=_NLL))
def perplexity(spark, d):
    """exp of the mean negative log-probability of the codes of all items, by layer and in all, under the frequencies of continuations."""
    s, parts = sids(spark, d), None
    full = s.groupBy("a", "b", "c").agg(F.count(F.lit(1)).alias("n"))
    full = scratch.keep(full, "codes")
    for layer in (1, 2, 3):
        keys, up = list("abc"[:layer]), list("abc"[: layer - 1])
        n = full.groupBy(*keys).agg(F.sum("n").alias("n"))
        total = full.groupBy(*up).agg(F.sum("n").alias("t"))
        one = (n.join(total, up) if up else n.crossJoin(F.broadcast(total))).select(F.lit(f"layer{layer}").alias("part"), F.log(F.col("t") / F.col("n")).alias("nll"), "n")
        parts = one if parts is None else parts.unionByName(one)
    g = parts.select(F.explode(F.array(F.lit("all"), "part")).alias("part"), "nll", "n").groupBy("part")
    return g.agg(F.round(F.exp(F.sum(F.col("nll") * F.col("n")) / F.sum("n")), 5).alias("ppl"), F.sum("n").alias("n"))


@query(sql("SELECT a, sid, rank FROM (SELECT a, sid, row_number() OVER (PARTITION BY a ORDER BY count(*) DESC, sid)::INT AS rank FROM sid GROUP BY a, sid) WHERE rank <= 3", "sid"))
def topk_beam(spark, d):
    """The top-k of one beam step: best continuations of each first code by their number of items."""
    g = sids(spark, d).groupBy("a", "sid").agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("rank", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("n"), "sid"))).where("rank <= 3").select("a", "sid", "rank")


@query(
    sql(
        "SELECT g, pos::INT AS pos, sid, reward::DOUBLE AS reward FROM (SELECT content_id AS g, 0 AS pos, sid, 1.0 AS reward FROM p UNION ALL SELECT content_id, 1, n1, 0.0 FROM p WHERE n1 <> sid UNION ALL SELECT content_id, 2, n2, 0.0 FROM p WHERE n2 <> sid UNION ALL SELECT content_id, 3, n3, 0.0 FROM p WHERE n3 <> sid UNION ALL SELECT content_id, 4, n4, 0.0 FROM p WHERE n4 <> sid)",
        "sid",
        p="SELECT content_id, sid, lead(sid, 1) OVER w AS n1, lead(sid, 2) OVER w AS n2, lead(sid, 3) OVER w AS n3, lead(sid, 4) OVER w AS n4 FROM sid WINDOW w AS (PARTITION BY a ORDER BY sha256(sid), content_id)",
    )
)
def align_batch(spark, d):
    """A target and up to four other SIDs of its first code, picked by hash: reward 1 and 0."""
    s = sids(spark, d).select("content_id", "sid", "a")
    others = Window.partitionBy("a").orderBy(F.sha2("sid", 256), "content_id")
    picks = s.select(F.col("content_id").alias("g"), F.col("sid").alias("target"), *[F.lead("sid", k).over(others).alias(f"n{k}") for k in range(1, 5)])
    rows = F.array(F.struct(F.col("target").alias("sid"), F.lit(1.0).alias("reward")), *[F.struct(F.col(f"n{k}").alias("sid"), F.lit(0.0).alias("reward")) for k in range(1, 5)])
    return picks.select("g", "target", F.posexplode(rows).alias("pos", "r")).where("r.sid IS NOT NULL AND (pos = 0 OR r.sid <> target)").select("g", "pos", "r.sid", "r.reward")


# --- quantisers --------------------------------------------------------------

def _books(u):
    """Three residual codebooks of eight rows from the first 24 vectors."""
    first = vq.rows(u, "vec_id", "v", 0, 8)
    second = vq.residuals(vq.rows(u, "vec_id", "v", 8, 16), first)
    third = vq.residuals(vq.residuals(vq.rows(u, "vec_id", "v", 16, 24), first), second)
    return [first, second, third]


_CENT = "SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS v FROM embeddings"


@query(sql("SELECT u.vec_id, arg_max(c.vec_id, (round(list_dot_product(u.v, c.v), 9), -c.vec_id))::INT AS code FROM u JOIN u c ON c.vec_id < 8 GROUP BY u.vec_id", u=_CENT))
def vq_assign(spark, d):
    u = table(spark, d, "embeddings").select("vec_id", scalars.l2_normalize(F.col("embedding")).alias("v"))
    return vq.encode(u, "vec_id", "v", [vq.rows(u, "vec_id", "v", 0, 8)]).select("vec_id", F.element_at("codes", 1).alias("code"))


def _slices(u):
    """Four product codebooks of 16 rows from the first vectors."""
    c = vq.rows(u, "vec_id", "v", 0, 16)
    return [c[:, k * 16 : k * 16 + 16] for k in range(4)]


_DIST = "round(list_dot_product({0}.v, {0}.v) + list_dot_product({1}.v, {1}.v) - 2 * list_dot_product({0}.v, {1}.v), 8)"


def _level(left: str, book: str, codes: str, n: int) -> dict[str, str]:
    """CTEs r{n} (codes so far) and e{n} (what is left) of one residual codebook."""
    d = _DIST.format("x", "k")
    return {
        f"r{n}": f"SELECT x.vec_id, {codes}arg_min(k.j, ({d}, k.j)) AS c{n} FROM {left} x, {book} k GROUP BY ALL",
        f"e{n}": f"SELECT r.*, list_transform(range(1, 65), lambda i: x.v[i] - k.v[i]) AS v FROM r{n} r JOIN {left} x USING (vec_id) JOIN {book} k ON k.j = r.c{n}",
    }


_RQ = dict(
    u=_CENT,
    k1="SELECT vec_id AS j, v FROM u WHERE vec_id < 8",
    **_level("u", "k1", "", 1),
    k2="SELECT vec_id - 8 AS j, v FROM e1 WHERE vec_id BETWEEN 8 AND 15",
    **_level("e1", "k2", "x.c1, ", 2),
    k3="SELECT vec_id - 16 AS j, v FROM e2 WHERE vec_id BETWEEN 16 AND 23",
    **_level("e2", "k3", "x.c1, x.c2, ", 3),
)


@query(sql("SELECT vec_id, c1::VARCHAR || '_' || c2 || '_' || c3 AS sid FROM r3", **_RQ))
def vq_residual_ids(spark, d):
    u = table(spark, d, "embeddings").select("vec_id", scalars.l2_normalize(F.col("embedding")).alias("v"))
    return vq.encode(u, "vec_id", "v", _books(u)).select("vec_id", F.array_join(F.col("codes").cast("array<string>"), "_").alias("sid"))


@query(sql("SELECT vec_id, (code[1] + 5 * code[2] + 25 * code[3])::BIGINT AS code FROM (SELECT vec_id, list_transform([1, 2, 3], lambda i: least(greatest(round_even(tanh(embedding[i]::DOUBLE * 8) * 2, 0) + 2, 0), 4)::INT) AS code FROM embeddings)"))
def vq_fsq_predict(spark, d):
    codes = F.array(*[scalars.fsq_quantize(F.col("embedding")[i].cast("double") * 8, 5) for i in range(3)])
    return table(spark, d, "embeddings").select("vec_id", scalars.mixed_radix_encode(codes, [5, 5, 5]).alias("code"))


@query("SELECT p_partkey, (p_partkey % 5 - 2)::DOUBLE AS x, ((p_partkey // 5) % 5 - 2)::DOUBLE AS y FROM part")
def vq_fsq_decode(spark, d):
    t = table(spark, d, "part").select("p_partkey", scalars.mixed_radix_decode(F.col("p_partkey"), [5, 5, 5]).alias("t"))
    return t.select("p_partkey", scalars.fsq_dequantize(F.col("t")[0], 5).alias("x"), scalars.fsq_dequantize(F.col("t")[1], 5).alias("y"))


@query(
    sql(
        "SELECT vec_id, string_agg(code::VARCHAR, '_' ORDER BY s) AS pq FROM (SELECT u.vec_id, s, arg_min(c.vec_id, (round(list_dot_product(u.v[s*16+1:s*16+16] , u.v[s*16+1:s*16+16]) + list_dot_product(c.v[s*16+1:s*16+16], c.v[s*16+1:s*16+16]) - 2 * list_dot_product(u.v[s*16+1:s*16+16], c.v[s*16+1:s*16+16]), 8), c.vec_id)) AS code FROM u JOIN u c ON c.vec_id < 16, (SELECT unnest(range(0, 4)) AS s) GROUP BY u.vec_id, s) GROUP BY vec_id",
        u=_CENT,
    )
)
def vq_pq_encode(spark, d):
    u = table(spark, d, "embeddings").select("vec_id", scalars.l2_normalize(F.col("embedding")).alias("v"))
    return vq.encode(u, "vec_id", "v", _slices(u), slices=True).select("vec_id", F.array_join(F.col("codes").cast("array<string>"), "_").alias("pq"))


@query(sql("SELECT p_partkey, generate_subscripts(v, 1) AS pos, round(unnest(v), 5) + 0.0 AS x FROM (SELECT p_partkey, list_concat(list_concat(a.v[1:16], b.v[17:32]), list_concat(c.v[33:48], e.v[49:64])) AS v FROM part JOIN u a ON a.vec_id = p_partkey % 16 JOIN u b ON b.vec_id = p_partkey // 16 % 16 JOIN u c ON c.vec_id = p_partkey // 256 % 16 JOIN u e ON e.vec_id = p_partkey // 4096 % 16)", u=_CENT))
def vq_pq_decode(spark, d):
    """Vectors of the whole space from four codes."""
    u = table(spark, d, "embeddings").select("vec_id", scalars.l2_normalize(F.col("embedding")).alias("v"))
    codes = F.array(*[(F.floor(F.col("p_partkey") / 16**k) % 16).cast("int") for k in range(4)])
    v = vq.decode(table(spark, d, "part").select("p_partkey", codes.alias("codes")), "p_partkey", "codes", _slices(u), slices=True)
    return v.select("p_partkey", F.posexplode("v").alias("pos", "x")).select("p_partkey", (F.col("pos") + 1).cast("bigint").alias("pos"), (F.round("x", 5) + 0.0).alias("x"))


@query(sql("SELECT q.vec_id AS src, v.vec_id AS dst, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_dot_product(q.v, v.v), 9) DESC, v.vec_id)::INT AS rank FROM u q JOIN u v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0 QUALIFY rank <= 5", u=_CENT))
def vq_graph(spark, d):
    from ..operators.vectors import topk_cosine

    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    t = topk_cosine(e.where("id % 50 = 0"), e, 5)
    return t.select(F.col("q").alias("src"), F.col("c").alias("dst"), F.row_number().over(Window.partitionBy("q").orderBy(F.desc("cosine"), "c")).alias("rank"))


@query(sql("SELECT vec_id, CASE WHEN vec_id % 5 = 0 THEN '7_7_7' ELSE c1::VARCHAR || '_' || c2 || '_' || c3 END AS sid, vec_id % 5 <> 0 AS fresh FROM r3", **_RQ))
def vq_incremental(spark, d):
    """Ids with a code keep it; only the others are encoded."""
    u = table(spark, d, "embeddings").select("vec_id", scalars.l2_normalize(F.col("embedding")).alias("v"))
    old = u.where("vec_id % 5 = 0").select("vec_id", F.array(*[F.lit(7)] * 3).alias("codes"))
    return vq.incremental(old, u, "vec_id", "v", _books(u)).select("vec_id", F.array_join(F.col("codes").cast("array<string>"), "_").alias("sid"), "fresh")


@query()
def vq_kmeans_cache(spark, d):
    """A codebook is fitted once per configuration; a second request reads it again."""
    e, config = table(spark, d, "embeddings"), {"table": d, "k": 8, "rounds": 5}
    first, second = vq.cached_codebook(spark, e, "embedding", config), vq.cached_codebook(spark, e, "embedding", config)
    return spark.createDataFrame([(len(second[0]), bool((first[0] == second[0]).all()), second[1])], "codes int, same boolean, reused boolean")


@query()
def vq_kmeans_train(spark, d):
    return vq.kmeans(table(spark, d, "embeddings"), "vec_id", "embedding", 8)


@query()
def vq_kmeans_cpu(spark, d):
    return vq.lloyd(table(spark, d, "embeddings"), "vec_id", "embedding", 8, 5)


@query()
def vq_fsq_train(spark, d):
    return vq.pca(table(spark, d, "embeddings"), "vec_id", "embedding", 4)


@query()
def vq_pq_train(spark, d):
    """Cluster sizes of each slice of the vectors."""
    e = table(spark, d, "embeddings")
    coded = vq.encode(e, "vec_id", "embedding", vq.pq_train(e, "vec_id", "embedding", 4, 8), slices=True)
    return coded.select(F.posexplode("codes").alias("part", "code")).groupBy("part", "code").agg(F.count(F.lit(1)).alias("n"))


# --- losses ------------------------------------------------------------------

_GR = "SELECT l_orderkey AS g, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS pos, l_quantity / 50 AS reward, -l_discount * 10 AS policy_lp, -l_tax * 10 AS ref_lp FROM lineitem"


def scored(spark, d):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("g"), F.row_number().over(w).cast("bigint").alias("pos"), (F.col("l_quantity") / 50).alias("reward"), (-F.col("l_discount") * 10).alias("policy_lp"), (-F.col("l_tax") * 10).alias("ref_lp"),
        (F.col("l_partkey") % 3).alias("a"), (F.col("l_suppkey") % 2).alias("b"), (F.col("l_linenumber") % 2).alias("c"),
    )


@query(
    sql(
        """SELECT round(avg(ln(1 + exp(lse))), 5) AS loss, round(avg(c), 5) AS chosen_reward, round(avg(mean), 5) AS rejected_reward, round(avg(c - mean), 5) AS reward_margin, round(avg(CASE WHEN c > most THEN 1.0 ELSE 0.0 END), 5)::DOUBLE AS preference_acc,
 round((SELECT avg(policy_lp - ref_lp) FROM r), 5) AS kl, count(*) AS groups FROM l""",
        r=_GR,
        x="SELECT a.g, a.policy_lp - a.ref_lp AS c, b.policy_lp - b.ref_lp AS v, 0.1 * ((b.policy_lp - b.ref_lp) - (a.policy_lp - a.ref_lp)) AS x FROM r a JOIN r b ON a.g = b.g AND a.pos = 1 AND b.pos > 1",
        l="SELECT g, any_value(c) AS c, avg(v) AS mean, max(v) AS most, max(x) + ln(sum(exp(x - m))) AS lse FROM (SELECT *, max(x) OVER (PARTITION BY g) AS m FROM x) GROUP BY g",
    )
)
def loss_dpo(spark, d):
    got = losses.dpo_diagnostics(losses.softmax_dpo(scored(spark, d).withColumn("chosen", F.col("pos") == 1), 0.1))
    return got.select(*[F.round(c, 5).alias(c) for c in got.columns[:-1]], "groups")


_ADV = "SELECT *, greatest(-5, least(5, (reward - avg(reward) OVER w) / stddev_samp(reward) OVER w)) AS adv, exp(greatest(-10, least(10, policy_lp - ref_lp))) AS rho FROM r WINDOW w AS (PARTITION BY g) QUALIFY stddev_samp(reward) OVER w >= 1e-6"


@query(sql("SELECT g, pos, round(adv, 5) + 0.0 AS advantage, round(-least(rho * adv, least(greatest(rho, 0.8), 1.2) * adv), 5) + 0.0 AS loss FROM a", r=_GR, a=_ADV))
def loss_grpo(spark, d):
    x = losses.grpo(scored(spark, d))
    return x.select("g", "pos", F.round("advantage", 5).alias("advantage"), F.round("loss", 5).alias("loss"))


@query(sql("SELECT g, pos, round(-least(e * adv, least(greatest(e, 0.8), 1.2) * adv), 5) + 0.0 AS loss FROM (SELECT *, CASE WHEN adv < 0 THEN least(rho, 1.3) ELSE rho END AS e FROM a)", r=_GR, a=_ADV))
def loss_ecpo(spark, d):
    return losses.grpo(scored(spark, d), delta=0.1).select("g", "pos", F.round("loss", 5).alias("loss"))


@query(
    sql(
        """SELECT g, pos, round(gate, 6) AS gate, round(adv, 5) + 0.0 AS advantage, round(-least(rho * adv, least(greatest(rho, 0.8), 1.2) * adv), 5) + 0.0 AS loss FROM (SELECT * REPLACE (CASE WHEN adv < 0 THEN adv * (1 + 0.5 * gate) ELSE adv END AS adv) FROM z)""",
        r=_GR.replace("SELECT l_orderkey AS g", "SELECT l_partkey % 3 AS a, l_suppkey % 2 AS b, l_linenumber % 2 AS c, l_orderkey AS g"),
        best="SELECT g, pos, a, b, c FROM r QUALIFY row_number() OVER (PARTITION BY g ORDER BY reward DESC, pos) = 1",
        y=_ADV,
        z="SELECT y.*, CASE WHEN y.pos = k.pos OR y.a <> k.a THEN 0 WHEN y.b <> k.b THEN 1 WHEN y.c <> k.c THEN 2 ELSE 3 END / 3.0::DOUBLE AS gate FROM y JOIN best k USING (g)",
    )
)
def loss_a2po_gate(spark, d):
    """The group objective with negative advantages amplified by the codes shared with the best candidate (alpha 0.5)."""
    x = losses.grpo(scored(spark, d), alpha=0.5, codes=["a", "b", "c"])
    return x.select("g", "pos", F.round("gate", 6).alias("gate"), F.round("advantage", 5).alias("advantage"), F.round("loss", 5).alias("loss"))


_HALF = "SELECT vec_id, list_transform(x, lambda i: i / greatest(sqrt(list_dot_product(x, x)), 1e-12)) AS v FROM (SELECT vec_id, list_slice(embedding::DOUBLE[], {}, {}) AS x FROM embeddings)"


@query(
    sql(
        "SELECT batch, round((avg(la - s) + avg(lb - s)) / 2, 5) AS loss, count(*) AS n FROM (SELECT batch, i, max(s) FILTER (i = j) AS s, ln(sum(exp(s))) AS la FROM p GROUP BY batch, i) JOIN (SELECT batch, j AS i, ln(sum(exp(s))) AS lb FROM p GROUP BY batch, j) USING (batch, i) GROUP BY batch",
        a=_HALF.format(1, 32),
        b=_HALF.format(33, 64),
        p="SELECT a.vec_id // 32 AS batch, a.vec_id AS i, b.vec_id AS j, list_dot_product(a.v, b.v) / 0.05 AS s FROM a JOIN b ON a.vec_id // 32 = b.vec_id // 32",
    )
)
def loss_infonce(spark, d):
    """Symmetric cross-entropy between two views (halves) of the vectors of a batch of 32, temperature 0.05."""
    v = table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 32).alias("batch"), "vec_id", *[scalars.l2_normalize(F.slice("embedding", k, 32)).alias(n) for n, k in (("va", 1), ("vb", 33))])
    p = v.select("batch", F.col("vec_id").alias("i"), "va").join(v.select("batch", F.col("vec_id").alias("j"), "vb"), "batch").select("batch", "i", "j", (scalars.dot(F.col("va"), F.col("vb")) / 0.05).alias("s"))
    a = p.groupBy("batch", "i").agg(F.max(F.when(F.col("i") == F.col("j"), F.col("s"))).alias("s"), F.log(F.sum(F.exp("s"))).alias("la"))
    b = p.groupBy("batch", F.col("j").alias("i")).agg(F.log(F.sum(F.exp("s"))).alias("lb"))
    g = a.join(b, ["batch", "i"]).groupBy("batch")
    return g.agg(F.round((F.avg(F.col("la") - F.col("s")) + F.avg(F.col("lb") - F.col("s"))) / 2, 5).alias("loss"), F.count(F.lit(1)).alias("n"))


@query(sql("SELECT g, (pos - 1) // 3 AS item, round(sum(policy_lp), 5) AS lp, count(*) AS codes FROM r GROUP BY ALL", r=_GR))
def loss_sid_logprob(spark, d):
    """The log-probability of each SID: the sum over its three positions; a rest of fewer stands by itself."""
    return scored(spark, d).groupBy("g", F.floor((F.col("pos") - 1) / 3).alias("item")).agg(F.round(F.sum("policy_lp"), 5).alias("lp"), F.count(F.lit(1)).alias("codes"))


@query("SELECT l_returnflag AS f, round(-avg(ln(1 - l_discount)), 6) AS loss FROM lineitem GROUP BY 1")
def loss_entp(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("f")).agg(F.round(-F.avg(F.log(1 - F.col("l_discount"))), 6).alias("loss"))


@query(
    sql(
        "SELECT round(avg(c), 5) AS chosen, round(avg(m), 5) AS rejected, round(avg(d), 5) AS margin, round(avg(w), 5) AS accuracy, round(sum(d * n) / sum(n), 5) AS margin_weighted, count(*) AS batches FROM (SELECT g // 640 AS batch, avg(c) AS c, avg(mean) AS m, avg(c - mean) AS d, avg(CASE WHEN c > most THEN 1.0::DOUBLE ELSE 0.0 END) AS w, count(*) AS n FROM l GROUP BY 1)",
        r=_GR,
        l="SELECT a.g, any_value(a.policy_lp - a.ref_lp) AS c, avg(b.policy_lp - b.ref_lp) AS mean, max(b.policy_lp - b.ref_lp) AS most FROM r a JOIN r b ON a.g = b.g AND a.pos = 1 AND b.pos > 1 GROUP BY a.g",
    )
)
def align_eval(spark, d):
    """Rewards, margin and accuracy as means of batch means, as they are reported, and the margin weighted by batch size."""
    got = losses.softmax_dpo(scored(spark, d).withColumn("chosen", F.col("pos") == 1), 0.1).where("loss IS NOT NULL").withColumn("batch", F.floor(F.col("g") / 640))
    b = got.groupBy("batch").agg(F.avg("chosen_reward").alias("c"), F.avg("rejected_reward").alias("m"), F.avg(F.col("chosen_reward") - F.col("rejected_reward")).alias("d"), F.avg(F.col("win").cast("double")).alias("w"), F.count(F.lit(1)).alias("n"))
    return b.agg(
        F.round(F.avg("c"), 5).alias("chosen"), F.round(F.avg("m"), 5).alias("rejected"), F.round(F.avg("d"), 5).alias("margin"), F.round(F.avg("w"), 5).alias("accuracy"), F.round(F.sum(F.col("d") * F.col("n")) / F.sum("n"), 5).alias("margin_weighted"), F.count(F.lit(1)).alias("batches")
    )


# --- user functions, streaming ----------------------------------------------


_URL = "SELECT DISTINCT image, md5(image) AS h FROM (SELECT unnest(images) AS image FROM pinned_content) WHERE image IS NOT NULL"


@query(
    sql(
        """SELECT image, status, CASE WHEN status IN ('ok', 'cached') THEN 'img/' || h[1:2] || '/' || h || '.jpg' END AS path, CASE status WHEN 'cached' THEN 7 WHEN 'too_large' THEN 1001 WHEN 'empty_body' THEN 0 WHEN 'ok' THEN length(image) END::BIGINT AS size_bytes
 FROM (SELECT image, h, CASE WHEN image = '' THEN 'empty' WHEN h[3] IN ('0', '1') THEN 'cached' ELSE ['empty_body', 'too_large', 'timeout', 'http_404', 'error_ValueError', 'ok'][(concat('0x', h[1:2])::UBIGINT % 6 + 1)::INT] END AS status FROM u)""",
        u=_URL,
    )
)
def udf_url_status(spark, d):
    """The status of every image url; without a network the answers follow from the url's hash."""
    from ..operators.rewards import HttpError, fetch_images

    def fetch(url: str) -> bytes:
        import hashlib

        kind = int(hashlib.md5(url.encode(), usedforsecurity=False).hexdigest()[:2], 16) % 6
        if kind == 2:
            raise TimeoutError
        if kind == 3:
            raise HttpError(404)
        if kind == 4:
            raise ValueError(url)
        return b"" if kind == 0 else b"x" * (1001 if kind == 1 else len(url))

    u = table(spark, d, "pinned_content").select(F.explode("images").alias("image")).where("image IS NOT NULL").distinct()
    return fetch_images(u, "image", "img", fetch, lambda path: 7 if path.split("/")[-1][2] in "01" else None, lambda path, body: None, 1000)


@query("SELECT user_id, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_behavior_upsert(spark, d):
    from ..streaming.jobs import run_behavior_upsert

    return run_behavior_upsert(spark, f"{d}/events.parquet")


@query(
    """WITH w AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 12 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM w)
SELECT user_id, count(*) AS n, ((epoch_us(max(ts)) - epoch_us(min(ts))) // 1000000)::BIGINT AS span FROM s GROUP BY user_id, k"""
)
def session_windows(spark, d):
    e = table(spark, d, "events")
    g = e.groupBy("user_id", F.session_window(F.col("ts").cast("timestamp"), "12 hours")).agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("a"), F.max("ts").alias("b"))
    return g.select("user_id", "n", F.floor((F.unix_micros(F.col("b").cast("timestamp")) - F.unix_micros(F.col("a").cast("timestamp"))) / 1000000).alias("span"))


@query(
    """WITH w AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 12 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM w)
SELECT user_id, epoch_us(min(ts))::BIGINT AS start_us, (epoch_us(max(ts)) + 43200000000)::BIGINT AS end_us, count(*) AS n FROM s GROUP BY user_id, k HAVING epoch_us(max(ts)) + 43200000000 <= (SELECT epoch_us(max(ts)) FROM events) - 3600000000"""
)
def stream_sessions(spark, d):
    """Sessions by a stream with a watermark: those that it has closed when the source ends."""
    from ..streaming.jobs import run_sessions

    return run_sessions(spark, f"{d}/events.parquet").select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n")


QUERIES, SQL = Q, S
