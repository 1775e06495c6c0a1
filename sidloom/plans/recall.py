"""Candidates under a trie, recall, baselines, preference pairs from candidates, rewards by prefix, item features."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import scratch
from ..functions import bits, scalars
from ..operators import prefs, relate
from ..operators import sequences as seq
from ..util import item_key, table
from .base import behavior, behavior_v2, movies, ratings, sids, sql
from .pipelines import _HISTORY, history
from .relations import ORD, ORDERED, liked

Q: dict = {}
S: dict = {}
WIDTH = 10
KS = [1, 5, 10, 50, 100, 500]


def query(oracle: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if oracle:
            S[f.__name__] = oracle
        return f

    return add


# --- candidates ----------------------------------------------------------------
# A score table stands in for the model: the log-probability of a next code is a
# fixed function of the query's context, the layer and the code.

_LP = "((qh * 7 + {x} * 17 + {layer} * 31) % 101) / 10.0::DOUBLE"
_QUERIES = r"""SELECT uid AS q, list_sum(tokens[:len(tokens) - 3])::BIGINT % 1009 AS qh, tokens[len(tokens) - 2]::INT AS ta, tokens[len(tokens) - 1]::INT AS tb, tokens[len(tokens)]::INT AS tc, lower(trim(eval_cids[len(eval_cids)], E' \t\r\n')) AS cid
 FROM (SELECT uid, tokens, eval_cids FROM sequences WHERE uid IS NOT NULL QUALIFY row_number() OVER (PARTITION BY uid ORDER BY built_at DESC NULLS LAST, eval_cids DESC NULLS LAST, tokens DESC NULLS LAST) = 1)
 WHERE len(tokens) >= 6 AND len(tokens) % 3 = 0 AND len(list_filter(tokens, lambda t: t IS NULL)) = 0 AND trim(coalesce(eval_cids[len(eval_cids)], ''), E' \t\r\n') <> ''"""


def _beam_ctes(first: str = "SELECT DISTINCT a FROM s", k: int = WIDTH) -> dict[str, str]:
    top = f"QUALIFY row_number() OVER (PARTITION BY q ORDER BY lp DESC, path) <= {k}"
    return dict(
        s="SELECT DISTINCT a, b, c FROM items",
        b1=f"SELECT q.*, x.a, x.a::VARCHAR AS path, -{_LP.format(x='x.a', layer=0)} AS lp FROM q, ({first}) x {top}",
        b2_=f"SELECT * FROM (SELECT p.* EXCLUDE (path, lp), x.b, p.path || '_' || x.b AS path, p.lp - {_LP.format(x='x.b', layer=1)} AS lp FROM b1 p JOIN (SELECT DISTINCT a, b FROM s) x ON x.a = p.a) {top}",
        b3=f"SELECT * FROM (SELECT p.* EXCLUDE (path, lp), x.c, p.path || '_' || x.c AS path, p.lp - {_LP.format(x='x.c', layer=2)} AS lp FROM b2_ p JOIN s x ON x.a = p.a AND x.b = p.b) {top}",
        beam="SELECT *, row_number() OVER (PARTITION BY q ORDER BY lp DESC, path) AS rank, CASE WHEN a <> ta THEN 0 WHEN b <> tb THEN 1 WHEN c <> tc THEN 2 ELSE 3 END AS depth FROM b3",
    )


_ITEMS = "SELECT content_id AS item, sid, a, b, c FROM sid"


def _score():
    return -((F.col("qh") * 7 + F.col("next") * 17 + F.col("layer") * 31) % 101) / 10.0


def eval_queries(spark, d):
    """The last item of each user's latest sequence as target: q, qh (of the context), ta, tb, tc, cid."""
    s = table(spark, d, "sequences").where("uid IS NOT NULL").groupBy("uid").agg(F.max_by(F.struct("tokens", "eval_cids"), F.struct("built_at", "eval_cids", "tokens")).alias("v")).select("uid", "v.tokens", "v.eval_cids")
    t, cid = F.col("tokens"), item_key(F.element_at("eval_cids", -1))
    s = s.where((F.size(t) >= 6) & (F.size(t) % 3 == 0) & ~F.exists(t, lambda x: x.isNull()) & (F.size("eval_cids") > 0)).where(cid != "")
    context = F.aggregate(F.slice(t, F.lit(1), F.size(t) - 3), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return s.select(F.col("uid").alias("q"), (context % 1009).alias("qh"), *[F.element_at(t, k - 3).alias(n) for k, n in enumerate(("ta", "tb", "tc"))], cid.alias("cid"))


def items(spark, d):
    return sids(spark, d).select(F.col("content_id").alias("item"), "sid", "a", "b", "c")


def beams(queries, known, locked: int = 0):
    """Ranked SIDs of every query with their depth of agreement with the target; the first ``locked`` codes are the target's."""
    tree = scratch.keep(prefs.trie(known), "trie")
    start = queries.withColumn("prefix", F.concat_ws("_", *[f"t{c}" for c in "abc"[:locked]]) if locked else F.lit(""))
    found = prefs.beam_search(start, tree, _score(), WIDTH, first=locked)
    codes = F.split("path", "_")
    at = [F.get(codes, F.lit(i)).cast("int") == F.col(f"t{c}") for i, c in enumerate("abc")]
    depth = F.when(~at[0], 0).when(~at[1], 1).when(~at[2], 2).otherwise(3)
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("lp"), "path"))
    return found.select("q", F.col("path").alias("sid"), "lp", rank.alias("rank"), depth.alias("depth"), *[F.get(codes, F.lit(i)).cast("int").alias(c) for i, c in enumerate("abc")], "ta", "tb", "tc", "cid")


def _candidates(spark, d, locked: int = 0):
    return beams(eval_queries(spark, d), sids(spark, d), locked)


_BEAM = dict(items=_ITEMS, q=_QUERIES, **_beam_ctes())


@query(sql("SELECT q, path AS sid, round(lp, 6) AS lp, rank::INT AS rank FROM beam", "sid", **_BEAM))
def beam_search(spark, d):
    """The ten best SIDs of every query under the trie."""
    return _candidates(spark, d).select("q", "sid", F.round("lp", 6).alias("lp"), "rank")


_DRAWS = 3
_GUMBEL = "-ln(-ln((concat('0x', substr(sha256(concat_ws('|', q, k, {path}, x.{c})), 1, 8))::UBIGINT::BIGINT + 1) / 4294967297.0::DOUBLE))"


def _draw(n: int, c: str, left: str, on: str, path: str) -> str:
    up = ", ".join(f"p.{x}" for x in "abc"[: n - 1])
    codes = ", ".join("abc"[:n])
    return f"SELECT q, k, {codes}, lp FROM (SELECT p.q, p.k, {up + ', ' if up else ''}x.{c}, p.lp - (x.{c} % 7) / 7.0::DOUBLE AS lp, -(x.{c} % 7) / 7.0::DOUBLE + {_GUMBEL.format(path=path, c=c)} AS s FROM {left} p, (SELECT DISTINCT {codes} FROM items) x {on}) QUALIFY row_number() OVER (PARTITION BY q, k ORDER BY s DESC, {codes}) = 1"


@query(
    sql(
        "SELECT q, a || '_' || b || '_' || c AS sid, round(max(lp), 6) AS lp, count(*) AS draws FROM d3 GROUP BY ALL",
        "sid",
        items=_ITEMS,
        q=_QUERIES,
        d0=f"SELECT q, unnest(range(0, {_DRAWS})) AS k, 0.0::DOUBLE AS lp FROM q",
        d1=_draw(1, "a", "d0", "", "''"),
        d2=_draw(2, "b", "d1", "WHERE x.a = p.a", "p.a"),
        d3=_draw(3, "c", "d2", "WHERE x.a = p.a AND x.b = p.b", "p.a || '_' || p.b"),
    )
)
def constrained_sampling(spark, d):
    """Legal SIDs drawn by the Gumbel trick with hashed uniforms, repeated draws merged under their log-probability."""
    return prefs.sample_paths(eval_queries(spark, d).select("q"), scratch.keep(prefs.trie(sids(spark, d)), "trie"), -(F.col("next") % 7) / 7.0, _DRAWS).select("q", F.col("path").alias("sid"), F.round("lp", 6).alias("lp"), "draws")


_LP3 = "(-(a * 3 % 97) - (b * 5 % 97) - (c * 7 % 97))"
_GROW = "SELECT DISTINCT x.* FROM {0} p JOIN s x ON (x.a = p.a AND x.b = p.b) UNION SELECT * FROM {0}"
_CUT = "SELECT * FROM ({}) QUALIFY row_number() OVER (ORDER BY score DESC, sid) <= 30"


@query(
    sql(
        "SELECT sid, score FROM g2 QUALIFY row_number() OVER (ORDER BY score DESC, sid) <= 10",
        "sid",
        s=f"SELECT DISTINCT sid, a, b, c, {_LP3}::INT AS score FROM sid",
        g0="SELECT * FROM s QUALIFY row_number() OVER (ORDER BY -(a * 3 % 97) DESC, sid) <= 30",
        g1=_CUT.format(_GROW.format("g0")),
        g2=_CUT.format(_GROW.format("g1")),
    )
)
def graph_decode(spark, d):
    """Seeds by the first digit, two rounds of expansion to neighbours (two digits in common), the best 30 kept, 10 out."""
    lp = [-(F.col(c) * k % 97) for c, k in zip("abc", (3, 5, 7))]
    s = scratch.keep(sids(spark, d).select("sid", "a", "b", "c").distinct().withColumn("score", lp[0] + lp[1] + lp[2]), "scored")
    best = s.orderBy(F.desc(lp[0]), "sid").limit(30)
    for _ in range(2):
        near = best.select("a", "b").distinct().join(s, ["a", "b"]).select(*s.columns)
        best = best.unionByName(near).distinct().orderBy(F.desc("score"), "sid").limit(30)
    return best.select("sid", "score").orderBy(F.desc("score"), "sid").limit(10)


@query(sql("SELECT content_id, length(sid) / 11.0::DOUBLE AS reward FROM sid", "sid"))
def rw_external(spark, d):
    """Any function of a batch of SIDs as a reward; here their length."""
    from ..operators.rewards import external_reward

    return sids(spark, d).select("content_id", external_reward(lambda sid: sid.str.len() / 11.0)(F.col("sid")).alias("reward"))


@query(sql("SELECT q, path AS sid, CASE depth WHEN 0 THEN 'easy' WHEN 1 THEN 'medium' ELSE 'hard' END AS bucket FROM beam WHERE depth < 3 QUALIFY row_number() OVER (PARTITION BY q, bucket ORDER BY rank) <= 3", "sid", **_BEAM))
def pref_sp_pairs(spark, d):
    return prefs.candidate_pairs(_candidates(spark, d)).select("q", "sid", "bucket")


@query(
    sql(
        "SELECT q, sid, chosen, pos, place FROM (SELECT q, sid, chosen, row_number() OVER (PARTITION BY q ORDER BY o, rank) - 1 AS pos, row_number() OVER (ORDER BY q, o, rank) - 1 AS place FROM (SELECT q, ta || '_' || tb || '_' || tc AS sid, true AS chosen, 0 AS o, 0 AS rank FROM q WHERE q IN (SELECT q FROM j) UNION ALL SELECT q, path, false, 1 + depth, rank FROM j))",
        "sid",
        **_BEAM,
        j="SELECT * FROM beam WHERE depth IN (1, 2) QUALIFY row_number() OVER (PARTITION BY q, depth ORDER BY rank) <= 3",
    )
)
def pref_flatten(spark, d):
    """Packed training rows of the medium and hard pairs: the chosen SID, then the rejected; place is the row's offset in all."""
    from .extras import numbered

    pairs = prefs.candidate_pairs(_candidates(spark, d)).where("bucket IN ('medium', 'hard')")
    rejected = pairs.select("q", "sid", F.lit(False).alias("chosen"), (F.col("depth") + 1).alias("o"), "rank")
    chosen = pairs.select("q", F.concat_ws("_", "ta", "tb", "tc").alias("sid"), F.lit(True).alias("chosen"), F.lit(0).alias("o"), F.lit(0).alias("rank")).distinct()
    rows = numbered(chosen.unionByName(rejected), ["q", "o", "rank"])
    return rows.select("q", "sid", "chosen", (F.row_number().over(Window.partitionBy("q").orderBy("place")) - 1).cast("bigint").alias("pos"), "place")


def _renamed(k: int) -> dict[str, str]:
    """The CTEs of a beam whose first k codes are the target's."""
    where = " AND ".join(f"{c} = t{c}" for c in "abc"[:k])
    lp = " + ".join(_LP.format(x=f"x.{c}", layer=i) for i, c in list(enumerate("abc"))[k:])
    if k == 2:
        return {"l2": f"SELECT q, x.a || '_' || x.b || '_' || x.c AS path, x.a, x.b, x.c, ta, tb, tc, -({lp}) AS lp FROM q JOIN s x ON x.a = ta AND x.b = tb QUALIFY row_number() OVER (PARTITION BY q ORDER BY lp DESC, path) <= {WIDTH}"}
    return {
        "l1b": f"SELECT q, qh, ta, tb, tc, x.a, x.b, x.a || '_' || x.b AS path, -{_LP.format(x='x.b', layer=1)} AS lp FROM q JOIN (SELECT DISTINCT a, b FROM s) x ON {where.replace('a =', 'x.a =')} QUALIFY row_number() OVER (PARTITION BY q ORDER BY lp DESC, path) <= {WIDTH}",
        "l1": f"SELECT q, p.path || '_' || x.c AS path, p.a, p.b, x.c, ta, tb, tc, p.lp - {_LP.format(x='x.c', layer=2)} AS lp FROM l1b p JOIN s x ON x.a = p.a AND x.b = p.b QUALIFY row_number() OVER (PARTITION BY q ORDER BY p.lp - {_LP.format(x='x.c', layer=2)} DESC, p.path || '_' || x.c) <= {WIDTH}",
    }


_DEPTH = "CASE WHEN a <> ta THEN 0 WHEN b <> tb THEN 1 WHEN c <> tc THEN 2 ELSE 3 END"


@query(
    sql(
        "SELECT q, sid, bucket, pass::INT AS pass FROM (SELECT q, sid, pass, rank, CASE depth WHEN 0 THEN 'easy' WHEN 1 THEN 'medium' ELSE 'hard' END AS bucket FROM (SELECT * FROM m WHERE depth < 3 QUALIFY row_number() OVER (PARTITION BY q, sid ORDER BY pass) = 1)) QUALIFY row_number() OVER (PARTITION BY q, bucket ORDER BY pass, rank) <= 3",
        "sid",
        **_BEAM,
        **_renamed(2),
        **_renamed(1),
        m=f"SELECT q, path AS sid, 0 AS pass, {_DEPTH} AS depth, row_number() OVER (PARTITION BY q ORDER BY lp DESC, path) AS rank FROM l2 UNION ALL SELECT q, path, 1, {_DEPTH}, row_number() OVER (PARTITION BY q ORDER BY lp DESC, path) FROM l1 UNION ALL SELECT q, path, 2, depth, rank FROM beam",
    )
)
def pref_prefix_locked(spark, d):
    """Passes with 2, 1 and 0 codes of the target locked; a candidate counts in its first pass; three a bucket, by pass and rank."""
    asked, known = scratch.keep(eval_queries(spark, d), "queries"), scratch.keep(sids(spark, d), "sids")
    found = None
    for p, locked in enumerate((2, 1, 0)):
        one = beams(asked, known, locked).where("depth < 3").select("q", "sid", "depth", F.lit(p).alias("pass"), "rank")
        found = one if found is None else found.unionByName(one)
    first = found.groupBy("q", "sid").agg(F.min_by(F.struct("pass", "rank", "depth"), "pass").alias("v")).select("q", "sid", "v.pass", "v.depth", (F.col("v.pass") * 1_000_000 + F.col("v.rank")).alias("rank"))
    return prefs.candidate_pairs(first).select("q", "sid", "bucket", "pass")


# --- recall ----------------------------------------------------------------------

_FREQ = r"SELECT iid, count(*) AS n FROM (SELECT lower(trim(e, E' \t\r\n')) AS iid FROM (SELECT unnest(eval_cids) AS e FROM sequences) WHERE e IS NOT NULL) WHERE iid <> '' GROUP BY iid"


@query(
    sql(
        "SELECT coalesce(bucket, 'all') AS bucket, count(*) AS n, "
        + ", ".join(f"round(avg(CASE WHEN pos <= {k} THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS r{k}" for k in (10, 50, 100, 500))
        + ", "
        + ", ".join(f"round(avg(CASE WHEN top >= {k} THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS depth{k}" for k in (1, 2, 3))
        + ", round(avg(CASE WHEN best = 3 THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS sid_found FROM r GROUP BY GROUPING SETS ((), (bucket))",
        "sid",
        "b2",
        **_BEAM,
        f="SELECT iid, count(*) AS n FROM b2 GROUP BY iid",
        w=_FREQ,
        e="SELECT m.q, i.item, m.cid, row_number() OVER (PARTITION BY m.q ORDER BY m.rank, coalesce(f.n, 0) DESC, i.item) AS pos FROM beam m JOIN items i ON i.sid = m.path LEFT JOIN f ON f.iid = i.item",
        h="SELECT q, min(pos) AS pos FROM e WHERE item = cid GROUP BY q",
        g="SELECT q, any_value(cid) AS cid, max(depth) FILTER (rank = 1) AS top, max(depth) AS best FROM beam GROUP BY q",
        r="SELECT g.*, h.pos, CASE WHEN coalesce(w.n, 0) < 3 THEN 'cold' WHEN w.n < 10 THEN 'warm' ELSE 'hot' END AS bucket FROM g LEFT JOIN h USING (q) LEFT JOIN w ON w.iid = g.cid",
    )
)
def recall_at_k(spark, d):
    """Recall of the target item among the items of the beams, depth accuracy of the best beam, by how often the target occurs."""
    found = scratch.keep(_candidates(spark, d), "beams")
    freq = behavior_v2(spark, d).groupBy(F.col("iid").alias("item")).agg(F.count(F.lit(1)).alias("f"))
    e = found.join(items(spark, d).select("item", "sid"), "sid").join(freq, "item", "left")
    e = e.withColumn("pos", F.row_number().over(Window.partitionBy("q").orderBy("rank", F.desc(F.coalesce("f", F.lit(0))), "item"))).where("item = cid").groupBy("q").agg(F.min("pos").alias("pos"))
    g = found.groupBy("q").agg(F.first("cid").alias("cid"), F.max(F.when(F.col("rank") == 1, F.col("depth"))).alias("top"), F.max("depth").alias("best"))
    w = table(spark, d, "sequences").select(F.explode("eval_cids").alias("e")).select(item_key("e").alias("cid")).where("cid <> ''").groupBy("cid").agg(F.count(F.lit(1)).alias("w"))
    r = g.join(e, "q", "left").join(w, "cid", "left").withColumn("bucket", F.when(F.coalesce("w", F.lit(0)) < 3, "cold").when(F.col("w") < 10, "warm").otherwise("hot"))
    part = lambda x, n: F.round(F.avg(F.when(x, 1.0).otherwise(0.0)), 6).alias(n)
    out = r.select("*", F.explode(F.array(F.lit("all"), "bucket")).alias("of")).groupBy("of")
    return out.agg(F.count(F.lit(1)).alias("n"), *[part(F.col("pos") <= k, f"r{k}") for k in (10, 50, 100, 500)], *[part(F.col("top") >= k, f"depth{k}") for k in (1, 2, 3)], part(F.col("best") == 3, "sid_found")).withColumnRenamed("of", "bucket")


@query(sql("SELECT q, max(depth)::INT AS best_depth, bool_or(depth >= 1) AS hit1, bool_or(depth >= 2) AS hit2, bool_or(depth >= 3) AS hit3, bool_or(a = ta) AS any1, bool_or(b = tb) AS any2, bool_or(c = tc) AS any3 FROM beam WHERE rank <= 10 GROUP BY q", "sid", **_BEAM))
def hit_depth10(spark, d):
    """Whether one of ten beams has the first 1, 2, 3 codes of the target, and each code by itself."""
    hit = [F.bool_or(F.col("depth") >= n).alias(f"hit{n}") for n in (1, 2, 3)] + [F.bool_or(F.col(c) == F.col(f"t{c}")).alias(f"any{n}") for n, c in ((1, "a"), (2, "b"), (3, "c"))]
    return _candidates(spark, d).where("rank <= 10").groupBy("q").agg(F.max("depth").alias("best_depth"), *hit)


_PUBLIC = "SELECT mid AS item, a || '_' || b || '_' || c AS sid, a, b, c FROM (SELECT mid, (mid % 4)::INT AS a, (mid // 4 % 8)::INT AS b, (mid // 32 % 16)::INT AS c FROM movies)"
_TRAIN = f"SELECT * FROM ({ORDERED}) WHERE rn < n AND n > 2"
_EX = "SELECT uid AS q, max(mid) FILTER (rn = n) AS target FROM o WHERE n > 2 GROUP BY uid"
_RATES = "SELECT k::INT AS k, round(avg(CASE WHEN pos <= k THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS recall, count(*) AS queries FROM {}, (SELECT unnest([" + ", ".join(map(str, KS)) + "]) AS k) GROUP BY k"


def _rates(df):
    """df: a row per query with the place of its target, or null."""
    wide = df.agg(F.count(F.lit(1)).alias("queries"), *[F.avg(F.when(F.col("pos") <= k, 1.0).otherwise(0.0)).alias(f"k{k}") for k in KS])
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.round(f"k{k}", 6).alias("recall")) for k in KS])).alias("r")
    return wide.select("queries", rows).select("r.k", "r.recall", "queries")


def _protocol(spark, d):
    """(train, targets): all but the last liked item of users with more than two; the last one."""
    o = scratch.keep(seq.ordered(liked(spark, d), "uid", ORD).where("n > 2"), "histories")
    return o.where("rn < n"), o.where("rn = n").select(F.col("uid").alias("q"), F.col("mid").alias("target"))


@query(
    sql(
        _RATES.format("z"),
        "ratings",
        "movies",
        o=ORDERED,
        t=_TRAIN,
        x=_EX,
        items=_PUBLIC,
        q="SELECT x.q, x.target, sum(t.mid)::BIGINT % 1009 AS qh FROM x JOIN t ON t.uid = x.q GROUP BY ALL",
        **{k: v for k, v in _beam_ctes().items() if k != "beam"},
        f="SELECT mid, count(*) AS n FROM t GROUP BY mid",
        e="SELECT m.q, i.item, m.target, row_number() OVER (PARTITION BY m.q ORDER BY m.lp DESC, m.path, coalesce(f.n, 0) DESC, i.item) AS pos FROM b3 m JOIN items i ON i.sid = m.path LEFT JOIN f ON f.mid = i.item",
        z="SELECT q.q, h.pos FROM q LEFT JOIN (SELECT q, pos FROM e WHERE item = target) h USING (q)",
    )
)
def recall_public(spark, d):
    """The public protocol: beams to items, the popular ones of a SID first; recall of the last liked item.

    The lists of items are never formed: a target stands behind all items of the
    beams before its SID's, at its place among the items of its own. The scores
    of a context follow from qh, so beams are searched once for each qh.
    """
    train, targets = _protocol(spark, d)
    mid = F.col("mid")
    known = movies(spark, d).select(mid.alias("item"), (mid % 4).cast("int").alias("a"), (F.floor(mid / 4) % 8).cast("int").alias("b"), (F.floor(mid / 32) % 16).cast("int").alias("c")).withColumn("path", F.concat_ws("_", "a", "b", "c"))
    asked = scratch.keep(targets.join(train.groupBy(F.col("uid").alias("q")).agg((F.sum("mid") % 1009).alias("qh")), "q"), "asked")
    contexts = asked.select("qh").distinct().select(F.col("qh").alias("q"), "qh", F.lit("").alias("prefix"))
    found = prefs.beam_search(contexts, scratch.keep(prefs.trie(known), "trie"), _score(), WIDTH)
    ahead = Window.partitionBy("qh").orderBy(F.desc("lp"), "path").rowsBetween(Window.unboundedPreceding, -1)
    beam = found.join(known.groupBy("path").agg(F.count(F.lit(1)).alias("size")), "path").select("qh", "path", F.coalesce(F.sum("size").over(ahead), F.lit(0)).alias("before"))
    freq = train.groupBy(mid.alias("item")).agg(F.count(F.lit(1)).alias("f"))
    best = Window.partitionBy("path").orderBy(F.desc(F.coalesce("f", F.lit(0))), "item")
    places = known.join(freq, "item", "left").select(F.col("item").alias("target"), "path", F.row_number().over(best).alias("place"))
    hits = asked.join(places, "target").join(beam, ["qh", "path"]).select("q", (F.col("before") + F.col("place")).alias("pos"))
    return _rates(asked.join(hits, "q", "left"))


_POP = "SELECT mid, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, mid) AS pos FROM t GROUP BY mid"


@query(sql(_RATES.format("(SELECT x.q, p.pos FROM x LEFT JOIN p ON p.mid = x.target)"), "ratings", o=ORDERED, t=_TRAIN, x=_EX, p=_POP))
def base_popularity(spark, d):
    """All items by their frequency in the histories; the place of an item is the number of better ones, from counts of counts."""
    train, targets = _protocol(spark, d)
    return _rates(targets.join(_places(train), F.col("item") == F.col("target"), "left"))


def _places(train):
    """(item, n, pos) of every item, without sorting all items in one task."""
    n = scratch.keep(train.groupBy(F.col("mid").alias("item")).agg(F.count(F.lit(1)).alias("n")), "counts")
    cut = scratch.keep(n.repartitionByRange(F.desc("n"), "item").withColumn("part", F.spark_partition_id()), "popularity")
    skip = cut.groupBy("part").agg(F.count(F.lit(1)).alias("c")).select("part", (F.sum("c").over(Window.orderBy("part")) - F.col("c")).alias("skip"))  # a row per partition
    return cut.join(F.broadcast(skip), "part").select("item", "n", (F.row_number().over(Window.partitionBy("part").orderBy(F.desc("n"), "item")) + F.col("skip")).alias("pos"))


@query(sql(_RATES.format("(SELECT x.q, min(t.n - t.rn) AS pos FROM x LEFT JOIN t ON t.uid = x.q AND t.mid = x.target GROUP BY x.q)"), "ratings", o=ORDERED, t=_TRAIN, x=_EX))
def base_repeat(spark, d):
    """The context from its end: an item seen before is found at its distance."""
    train, targets = _protocol(spark, d)
    seen = train.select(F.col("uid").alias("q"), F.col("mid").alias("target"), (F.col("n") - F.col("rn")).alias("pos")).groupBy("q", "target").agg(F.min("pos").alias("pos"))
    return _rates(targets.join(seen, ["q", "target"], "left"))


@query(
    sql(
        _RATES.format("y"),
        "ratings",
        o=ORDERED,
        t=_TRAIN,
        x=_EX,
        p=_POP,
        w="SELECT * FROM (SELECT a.mid AS a, b.mid AS b, round(sum(1.0::DOUBLE / abs(b.rn - a.rn)), 6) AS w FROM t a JOIN t b ON a.uid = b.uid AND b.rn <> a.rn AND abs(b.rn - a.rn) <= 5 GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY a ORDER BY w DESC, b) <= 2000",
        r="SELECT t.uid AS q, w.b AS item, round(sum(w.w / (t.n - t.rn)), 6) AS s FROM t JOIN w ON w.a = t.mid WHERE t.n - t.rn <= 5 GROUP BY ALL",
        k="SELECT q, item, row_number() OVER (PARTITION BY q ORDER BY s DESC, item) AS pos FROM r",
        m="SELECT q, count(*) AS known FROM r GROUP BY q",
        # a target that no seed leads to follows all that are ranked, in the order of popularity
        y="SELECT x.q, coalesce(k.pos, coalesce(m.known, 0) + p.pos - (SELECT count(*) FROM r JOIN p b ON b.mid = r.item WHERE r.q = x.q AND b.pos < p.pos)) AS pos FROM x LEFT JOIN k ON k.q = x.q AND k.item = x.target LEFT JOIN m ON m.q = x.q LEFT JOIN p ON p.mid = x.target",
    )
)
def base_itemknn(spark, d):
    """Item-to-item by co-occurrence within five places: the last five items as seeds, weighed by recency, then all others by popularity."""
    train, targets = _protocol(spark, d)
    half = relate.band_pairs(train, "uid", "mid", "rn", 5)
    both = half.unionByName(half.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight"))
    w = relate.top_by_seed(both.groupBy("a", "b").agg(F.round(F.sum("weight"), 6).alias("w")), "a", "w", "b", 2000)
    seeds = train.where("n - rn <= 5").select(F.col("uid").alias("q"), F.col("mid").alias("a"), (F.col("n") - F.col("rn")).alias("back"))
    r = scratch.keep(seeds.join(w, "a").groupBy("q", F.col("b").alias("item")).agg(F.round(F.sum(F.col("w") / F.col("back")), 6).alias("s")), "scores")
    p = scratch.keep(_places(train), "places")
    ranked = r.withColumn("pos", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s"), "item"))).select("q", F.col("item").alias("target"), "pos")
    t = targets.join(ranked, ["q", "target"], "left").join(p.select(F.col("item").alias("target"), F.col("pos").alias("place")), "target", "left")
    # only targets without a score need the ranked items that are more popular than they are
    rest = t.where("pos IS NULL AND place IS NOT NULL").select("q", "place")
    before = rest.join(r.join(p.select("item", F.col("pos").alias("at")), "item").select("q", "at"), "q").groupBy("q").agg(F.count(F.lit(1)).alias("known"), F.count_if(F.col("at") < F.col("place")).alias("better"))
    out = t.join(before, "q", "left")
    return _rates(out.withColumn("pos", F.coalesce("pos", F.coalesce("known", F.lit(0)) + F.col("place") - F.coalesce("better", F.lit(0)))))


# --- rewards by prefix --------------------------------------------------------------

_PAIRS = dict(
    **_HISTORY,
    pick="SELECT s.sid AS good, list_slice(list_filter(neg, lambda x: x <> c.iid), 1, 5) AS easy FROM c JOIN g USING (uid) JOIN sid s ON s.content_id = c.iid",
    bad="SELECT DISTINCT s.sid FROM (SELECT unnest(easy) AS iid FROM pick) JOIN sid s ON s.content_id = iid",
    whole="SELECT sid, max(v) AS v FROM (SELECT good AS sid, 1.0 AS v FROM pick UNION ALL SELECT sid, -1.0 FROM bad) GROUP BY sid",
    parts="SELECT depth, array_to_string(list_slice(string_split(sid, '_'), 1, depth), '_') AS prefix, CASE WHEN v > 0 THEN 1 ELSE 0 END AS chosen FROM (SELECT good AS sid, 1.0 AS v FROM pick UNION ALL SELECT sid, -1.0 FROM bad), (SELECT unnest([1, 2]) AS depth)",
    map="SELECT 3 AS depth, sid AS prefix, v::DOUBLE AS score FROM whole UNION ALL SELECT depth, prefix, (max(chosen) - 0.5)::DOUBLE FROM parts GROUP BY depth, prefix",
)


def feedback_map(spark, d):
    """(depth, prefix, score): 1 for chosen SIDs, -1 for those only rejected, 0.5 and -0.5 for their prefixes; chosen wins."""
    s = sids(spark, d).select("content_id", "a", "b", "c")
    pairs = scratch.keep(prefs.feedback_pairs(history(spark, d)).select("iid", "easy"), "feedback")
    good = pairs.select(F.col("iid").alias("content_id"), F.lit(1).alias("chosen"))
    bad = pairs.select(F.explode("easy").alias("content_id"), F.lit(0).alias("chosen"))
    rows = good.unionByName(bad).join(s, "content_id").groupBy("a", "b", "c").agg(F.max("chosen").alias("chosen"))
    levels = F.inline(F.array(*[F.struct(F.lit(k).alias("depth"), F.concat_ws("_", *"abc"[:k]).alias("prefix"), F.lit(v).alias("scale")) for k, v in ((3, 1.0), (2, 0.5), (1, 0.5))]))
    return rows.select("chosen", levels).groupBy("depth", "prefix", "scale").agg(F.max("chosen").alias("c")).select("depth", "prefix", F.when(F.col("c") == 1, F.col("scale")).otherwise(-F.col("scale")).alias("score"))


@query(sql("SELECT depth::INT AS depth, prefix, score FROM map", "beh", "sid", **_PAIRS))
def rw_feedback_map(spark, d):
    return feedback_map(spark, d)


@query(
    sql(
        "SELECT s.content_id, coalesce(x.score, y.score * 0.5, z.score * 0.25, 0)::DOUBLE AS reward FROM (SELECT *, a || '_' || b AS ab, a::VARCHAR AS aa FROM sid) s LEFT JOIN m3 x ON x.prefix = s.sid LEFT JOIN m2 y ON y.prefix = s.ab LEFT JOIN m1 z ON z.prefix = s.aa",
        "beh",
        "sid",
        **_PAIRS,
        m3="SELECT * FROM map WHERE depth = 3",
        m2="SELECT * FROM map WHERE depth = 2",
        m1="SELECT * FROM map WHERE depth = 1",
    )
)
def rw_behavior(spark, d):
    """Reward of each item's SID by the feedback map; a shorter prefix counts half per missing code."""
    return relate.prefix_lookup(sids(spark, d), feedback_map(spark, d), ["a", "b", "c"]).select("content_id", F.col("score").alias("reward"))


_QW = "CASE WHEN b < 0 THEN -1.0 ELSE log10(1.0 + " + " + ".join(f"CASE WHEN b & {x} <> 0 THEN {w} ELSE 0.0 END" for x, w in bits.QUALITY.items()) + ") END"
_EVAL_TS = 1738368000


@query(
    sql(
        f"""SELECT content_id, depth::INT AS depth, round(CASE WHEN v <= 0 THEN v ELSE v * exp(-greatest(({_EVAL_TS} - ts) / 3600.0::DOUBLE, 0) / 24.0) END * scale, 9)::DOUBLE + 0.0 AS reward FROM (
 SELECT content_id, CASE WHEN x.prefix IS NOT NULL THEN 3 WHEN y.prefix IS NOT NULL THEN 2 WHEN z.prefix IS NOT NULL THEN 1 ELSE 0 END AS depth, CASE WHEN x.prefix IS NOT NULL THEN 1.0 WHEN y.prefix IS NOT NULL THEN 0.5 ELSE 0.1 END AS scale,
 coalesce(CASE WHEN x.prefix IS NOT NULL THEN x.v WHEN y.prefix IS NOT NULL THEN y.v ELSE z.v END, 0) AS v, CASE WHEN x.prefix IS NOT NULL THEN x.ts WHEN y.prefix IS NOT NULL THEN y.ts ELSE z.ts END AS ts
 FROM (SELECT *, a || '_' || b AS ab, a::VARCHAR AS aa FROM sid) s LEFT JOIN m3 x ON x.prefix = s.sid LEFT JOIN m2 y ON y.prefix = s.ab LEFT JOIN m1 z ON z.prefix = s.aa)""",
        "b2",
        "sid",
        i="SELECT iid, bit_or(action_bitmap)::INT AS bits, max(last_ts) AS ts FROM b2 GROUP BY iid HAVING max(last_ts) IS NOT NULL",
        j="SELECT iid, bits, ts, sid, a || '_' || b AS ab, a::VARCHAR AS aa FROM i JOIN sid ON iid = content_id",
        m=f"SELECT k, prefix, arg_max(b, (ts, iid)) AS b, max(ts) AS ts FROM (SELECT 3 AS k, sid AS prefix, bits AS b, ts, iid FROM j UNION ALL SELECT 2, ab, bits, ts, iid FROM j UNION ALL SELECT 1, aa, bits, ts, iid FROM j) GROUP BY k, prefix",
        m3=f"SELECT prefix, ts, {_QW} AS v FROM m WHERE k = 3",
        m2=f"SELECT prefix, ts, {_QW} AS v FROM m WHERE k = 2",
        m1=f"SELECT prefix, ts, {_QW} AS v FROM m WHERE k = 1",
    )
)
def rw_weighted(spark, d):
    """Quality times freshness of a SID's latest item; without one, of its longest prefix that has one, times 0.5 or 0.1."""
    s = sids(spark, d)
    i = behavior_v2(spark, d).groupBy("iid").agg(F.bit_or("action_bitmap").alias("bits"), F.max("last_ts").alias("ts")).where("ts IS NOT NULL")
    j = i.join(s, F.col("iid") == F.col("content_id"))
    levels = F.inline(F.array(*[F.struct(F.lit(k).alias("depth"), F.concat_ws("_", *"abc"[:k]).alias("prefix")) for k in (3, 2, 1)]))
    info = j.select("iid", "bits", "ts", levels).groupBy("depth", "prefix").agg(F.max_by("bits", F.struct("ts", "iid")).alias("b"), F.max("ts").alias("ts"))
    v = bits.quality(F.col("b"))
    fresh = F.when(v <= 0, v).otherwise(v * scalars.freshness((F.lit(_EVAL_TS) - F.col("ts")) / 3600.0))
    scores = info.select("depth", "prefix", fresh.alias("score"))
    found = relate.prefix_lookup(s, scores, ["a", "b", "c"], scales=[0.1, 0.5], depth="depth")
    return found.select("content_id", "depth", F.round("score", 9).alias("reward"))


@query(sql("SELECT component, round(avg(v), 6) AS mean, count(*) AS n FROM (SELECT 'format' AS component, CASE WHEN c % 2 = 0 THEN 1.0::DOUBLE ELSE 0.0 END AS v FROM sid UNION ALL SELECT 'score', b / 255.0::DOUBLE FROM sid UNION ALL SELECT 'total', 0.7 * CASE WHEN c % 2 = 0 THEN 1.0 ELSE 0.0 END + 0.3 * (b / 255.0::DOUBLE) FROM sid) GROUP BY component", "sid"))
def rw_composite_means(spark, d):
    """The mean of each component of a composite reward and of their weighted sum."""
    from ..operators.rewards import composite

    s = sids(spark, d).select(F.when(F.col("c") % 2 == 0, 1.0).otherwise(0.0).alias("format"), (F.col("b") / 255.0).alias("score")).withColumn("total", composite({"format": 0.7, "score": 0.3}))
    g = s.agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in s.columns])
    return g.select(F.explode(F.array(*[F.struct(F.lit(c).alias("component"), F.round(c, 6).alias("mean")) for c in s.columns])).alias("r"), "n").select("r.component", "r.mean", "n")


# --- features -----------------------------------------------------------------------

_SHA = "concat('0x', substr(sha256({}), 1, 16))::UBIGINT"
_TITLED = "SELECT mid, title || CASE WHEN mid % 3 = 0 THEN ' (' || (1950 + mid % 70)::VARCHAR || ')' ELSE '' END AS title, genres FROM movies"
_TEXT = dict(
    titled=_TITLED,
    tok="SELECT mid, unnest(list_concat(list_concat(list_filter(string_split_regex(lower(title), '[^a-z0-9]+'), lambda x: x <> ''), list_transform(list_filter(string_split(genres, '|'), lambda g: g <> '' AND g <> '(no genres listed)'), lambda g: 'genre:' || lower(g))), CASE WHEN regexp_matches(title, '\\((\\d{4})\\)') THEN ['year:' || substr(regexp_extract(title, '\\((\\d{4})\\)', 1), 1, 3) || '0s'] ELSE [] END)) AS w FROM titled",
    txt=f"SELECT mid, (h % 32)::INT AS index, sum(CASE WHEN (h // 256) % 2 = 0 THEN -1.0 ELSE 1.0 END)::DOUBLE AS value FROM (SELECT mid, {_SHA.format('w')} AS h FROM tok) GROUP BY ALL",
)
_COLLAB = dict(
    o=ORDERED,
    col=f"SELECT mid, (h % 16)::INT AS index, round(sum(w), 6) AS value FROM (SELECT a.mid AS mid, {_SHA.format('b.mid::VARCHAR')} AS h, 1.0::DOUBLE / abs(b.rn - a.rn) AS w FROM o a JOIN o b ON a.uid = b.uid AND b.rn <> a.rn AND abs(b.rn - a.rn) <= 3) GROUP BY ALL",
)
# sums are rounded before they are used, so their order doesn't matter
_UNIT = "SELECT mid, index, value / greatest(sqrt(round(sum(value * value) OVER (PARTITION BY mid), 6)), 1e-6) AS value FROM {}"
_NORM = "SELECT mid, index, round(value, 5) AS value FROM (" + _UNIT + ")"


def _normed(df):
    norm = F.sqrt(F.round(F.sum(F.col("value") * F.col("value")).over(Window.partitionBy("mid")), 6))
    return df.withColumn("value", F.col("value") / F.greatest(norm, F.lit(1e-6)))


def _text(spark, d):
    mid = F.col("mid")
    m = movies(spark, d).withColumn("title", F.concat("title", F.when(mid % 3 == 0, F.concat(F.lit(" ("), (1950 + mid % 70).cast("string"), F.lit(")"))).otherwise("")))
    year = scalars.decade(F.col("title"))
    words = F.concat(scalars.tokenize(F.col("title")), scalars.genre_tokens(F.col("genres")), F.when(year.isNotNull(), F.array(year)).otherwise(F.array().cast("array<string>")))
    w = m.select("mid", F.explode(words).alias("w")).select("mid", scalars.hash_feature(F.col("w"), 32).alias("f"))
    return w.groupBy("mid", F.col("f.index").alias("index")).agg(F.sum("f.sign").alias("value"))


def _collab(spark, d):
    half = relate.band_pairs(seq.ordered(liked(spark, d), "uid", ORD), "uid", "mid", "rn", 3)
    both = half.unionByName(half.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight"))
    return both.groupBy(F.col("a").alias("mid"), scalars.hash_feature(F.col("b").cast("string"), 16)["index"].alias("index")).agg(F.round(F.sum("weight"), 6).alias("value"))


@query(sql(_NORM.format("txt"), "movies", **_TEXT))
def feat_text(spark, d):
    """Signed hashes of title words, genres and decade, of unit length."""
    return _normed(_text(spark, d)).withColumn("value", F.round("value", 5))


@query(sql(_NORM.format("col"), "ratings", **_COLLAB))
def feat_collab(spark, d):
    """Hashed neighbours within three places of liked histories, weight 1 / distance, of unit length."""
    return _normed(_collab(spark, d)).withColumn("value", F.round("value", 5))


@query(
    sql(
        _NORM.format("u"),
        "movies",
        "ratings",
        **_TEXT,
        **_COLLAB,
        n1=_UNIT.format("txt"),
        n2=_UNIT.format("col"),
        u="SELECT mid, index, value FROM n1 UNION ALL SELECT mid, index + 32, value FROM n2 WHERE mid IN (SELECT mid FROM movies)",
    )
)
def feat_hybrid(spark, d):
    """Text features and, behind them, co-occurrence features, together of unit length."""
    c = _normed(_collab(spark, d)).join(movies(spark, d).select("mid"), "mid", "left_semi").withColumn("index", F.col("index") + 32)
    return _normed(_normed(_text(spark, d)).unionByName(c)).withColumn("value", F.round("value", 5))


QUERIES, SQL = Q, S
