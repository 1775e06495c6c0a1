"""Exact values and edge cases of the core operators."""

import math

import pytest
from pyspark.sql import functions as F

from sidloom.functions import bits, scalars
from sidloom.operators import losses, metrics, prefs, relate
from sidloom.operators.skew import Measure, heavy_hitters, latest_sids, parse_sid, prefix_stats, skew_aggregate, skew_join


def values(spark, rows, schema, *cols):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*cols).collect()]


def test_tiers_and_quality(spark):
    b = F.col("b")
    rows = [(x,) for x in (0, 1, 2, 3, -1, 16, 32, 4096, 4097, 262144, -2147483648, 6)]
    got = {r[0]: r[1:] for r in values(spark, rows, "b int", "b", bits.tier(b), bits.level(b), bits.quality(b))}
    assert [got[x][0] for x in (0, 1, 2, 3, -1, 16, 32, 4096, 4097, 262144)] == ["neutral", "weak", "strong", "strong", "negative", "weak", "neutral", "neutral", "weak", "strong"]
    assert got[262144][1] == 3 and got[2][1] == 2 and got[1][1] == 1
    assert got[-2147483648][2] == -1 and got[0][2] == 0 and got[4096][2] == 0
    assert math.isclose(got[262144][2], math.log10(4001)) and math.isclose(got[6][2], math.log10(5))


def test_time_gap_boundaries(spark):
    d = F.col("d")
    got = values(spark, [(x,) for x in (0, 29, 30, 31, 120, 1209600, 1209601)], "d bigint", scalars.time_bucket(d, "right"), scalars.time_bucket(d, "left"))
    assert got == [(1, 0), (1, 1), (2, 1), (2, 2), (3, 2), (15, 14), (15, 15)]


def test_sid_parsing(spark):
    rows = [("1_2_3",), (" 01 _ 2_003 ",), ("1_2",), ("1_2_256",), ("-1_2_3",), ("1_2_x",), ("",), (None,), ("0_0_0",), ("1_2_3_4",)]
    got = [r[0] for r in values(spark, rows, "s string", parse_sid(F.col("s")))]
    assert [g and tuple(g) for g in got] == [(1, 2, 3), (1, 2, 3), None, None, None, None, None, None, (0, 0, 0), None]


def test_latest_valid_assignment_counts(spark):
    rows = [("A ", "1_1_1", 1), ("a", "2_2_2", 2), ("a", "9_9", 3), (None, "3_3_3", 1), ("b", "4_4_4", None), ("b", "4_4_4", None), ("\tC", "5_5_5", 1), ("c", "5_5_6", 1)]
    got = {tuple(r) for r in latest_sids(spark.createDataFrame(rows, "content_id string, sid string, assigned_at int")).collect()}
    assert got == {("a", 2, 2, 2), ("b", 4, 4, 4), ("c", 5, 5, 6)}


def test_prefix_stats_with_a_heavy_key(spark):
    rows = [(f"c{i}", 7, i % 3, i % 50) for i in range(900)] + [(f"d{i}", i % 256, 1, 1) for i in range(300)]
    got = {(r.depth, r.prefix): r for r in prefix_stats(spark.createDataFrame(rows, "content_id string, a int, b int, c int"), share=0.1).collect()}
    assert got[(1, "7")].n_items == 902 and got[(1, "7")].n_sids == 150 and got[(1, "7")].first_item == "c0"
    assert sum(r.n_items for (d, _), r in got.items() if d == 1) == 1200 and got[(3, "7_1_1")].n_total == 1200
    assert prefix_stats(spark.createDataFrame([], "content_id string, a int, b int, c int")).count() == 0


def test_skew_operators_equal_the_plain_ones(spark):
    rows = [(1 if i % 3 else i, i % 10, "x") for i in range(3000)] + [(None, 1, "y")]
    df = spark.createDataFrame(rows, "k int, v int, salt string")  # a column named like an inner one
    n, heavy = heavy_hitters(df, F.col("k"), 0.1)
    assert n == 3000 and heavy == [1]
    got = skew_aggregate(df, ["k"], [Measure("n", F.count(F.lit(1)), F.sum), Measure("d", F.count_distinct("v"), F.sum)], F.col("v"), 0.1)
    assert sorted(map(str, got.collect())) == sorted(map(str, df.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("v").alias("d")).collect()))
    right = spark.createDataFrame([(1, "a"), (1, "b"), (3, "c"), (None, "z")], "k int, w string")
    for how in ("inner", "left"):
        want = sorted(map(str, df.join(right, "k", how).collect()))
        assert sorted(map(str, skew_join(df, right, "k", 0.1, how).collect())) == want
        assert sorted(map(str, skew_join(df, right, "k", 0.1, how, few=1, salts=4).collect())) == want  # too many rows to broadcast


def test_difficulty_and_novelty(spark):
    rows = [([3, 7, 1], c) for c in ([0, 0, 0], [3, 0, 0], [3, 7, 0], [3, 7, 1], [0, 7, 1])]
    a, b = F.col("a"), F.col("b")
    got = values(spark, rows, "a array<int>, b array<int>", scalars.reject_difficulty(a, b), scalars.match_depth(a, b), scalars.token_overlap(a, b))
    assert [g[0] for g in got] == ["easy", "medium", "hard", None, "easy"]
    assert [g[1] for g in got] == [0, 1, 2, 3, 0] and math.isclose(got[4][2], 2 / 3)
    ctx = [([1, 2, 3, 4], [2, 3]), ([1, 2], [1, 2, 3]), ([], [1]), ([5, 1, 2, 3], [1, 2, 3])]
    assert [g[0] for g in values(spark, ctx, "a array<int>, b array<int>", scalars.contains_run(a, b))] == [True, False, False, True]


def test_collision_edge_cases(spark):
    def m(sids):
        return metrics.collision(spark.createDataFrame([(f"c{i}", *s) for i, s in enumerate(sids)], "content_id string, a int, b int, c int")).first()

    assert m([(1, 2, 3)] * 10).conflict_rate == 1.0 and m([(i, 0, 0) for i in range(8)]).conflict_rate == 0.0
    half = m([(i, 0, 0) for i in range(1, 6)] + [(0, 0, 0)] * 5)
    assert math.isclose(half.conflict_rate, 1 / 6) and math.isclose(half.collision_rate, 0.4)


def test_prefix_lookup_scale(spark):
    scores = spark.createDataFrame([(2, "1_2", 0.6), (3, "5_5_5", 1.0)], "depth int, prefix string, score double")
    keys = spark.createDataFrame([(1, 2, 9), (5, 5, 5), (8, 8, 8)], "a int, b int, c int")
    got = {r.a: r.score for r in relate.prefix_lookup(keys, scores, ["a", "b", "c"]).collect()}
    assert got == {1: 0.3, 5: 1.0, 8: 0.0}


def test_early_clip_of_zero_changes_nothing(spark):
    rows = [(g, p, float((g * p) % 5), -p / 3, -p / 4) for g in range(5) for p in range(1, 6)]
    df = spark.createDataFrame(rows, "g int, pos int, reward double, policy_lp double, ref_lp double")
    assert sorted(map(tuple, losses.grpo(df).collect())) == sorted(map(tuple, losses.grpo(df, delta=0.0).collect()))
    assert losses.grpo(df.where("g = 0")).count() == 0  # a group of equal rewards is left out


def test_band_pairs_equal_a_self_join(spark):
    df = spark.createDataFrame([(u, (u * 7 + p * p) % 9, p) for u in range(4) for p in range(1, 12)], "uid int, iid int, rn int")
    a, b = df.alias("a"), df.alias("b")
    want = a.join(b, (F.col("a.uid") == F.col("b.uid")) & (F.col("b.rn") > F.col("a.rn")) & (F.col("b.rn") - F.col("a.rn") <= 3)).count()
    assert relate.band_pairs(df, "uid", "iid", "rn", 3).count() == want


def test_trie_and_beam_are_legal(spark):
    s = spark.createDataFrame([(1, 2, 3), (1, 2, 4), (2, 0, 0), (1, 2, 3)], "a int, b int, c int")
    t = prefs.trie(s)
    assert t.count() == 2 + 2 + 3
    got = prefs.beam_search(spark.range(1).withColumnRenamed("id", "q"), t, -F.col("next").cast("double"), 2).collect()
    assert [(r["path"], r["lp"]) for r in sorted(got, key=lambda r: -r["lp"])] == [("2_0_0", -2.0), ("1_2_3", -6.0)]


def test_jaccard_keeps_users_of_any_size(spark):
    """A user with more items than any cap adds their pairs; small chunks give what large ones give."""
    from itertools import combinations

    from sidloom.operators import relate

    rows = [("hot", i) for i in range(60)] + [("u", i) for i in range(5)] + [("v", 3), ("v", 70), (None, 1), ("w", None)]
    df = spark.createDataFrame(rows, "uid string, mid bigint")
    users = {}
    for u, i in rows:
        if u and i is not None:
            users.setdefault(i, set()).add(u)
    want = {(a, b): round(len(users[a] & users[b]) / len(users[a] | users[b]), 9) for a, b in combinations(sorted(users), 2) if users[a] & users[b]}
    assert {(r.item_a, r.item_b): round(r.jaccard, 9) for r in relate.jaccard(df, "uid", "mid").collect()} == want
    for chunk in (7, 512):
        got = relate.all_user_pairs(df, "uid", "mid", chunk).collect()
        assert len(got) == 60 * 59 // 2 + 10 + 1 and {(r.item_a, r.item_b) for r in got} == set(want)


def test_jaccard_users_has_no_user_cap(spark, monkeypatch):
    """The hot users of a table are paired whatever limit the capped operator would be given."""
    from sidloom.operators import relate
    from sidloom.plans import registry, relations

    rows = spark.createDataFrame([(u, i, 5) for u in (1, 2) for i in range(50)], "uid bigint, mid bigint, rating int")
    monkeypatch.setattr(relations, "ratings", lambda *_: rows)
    pairs = relate.user_pairs
    monkeypatch.setattr(relate, "user_pairs", lambda df, user, item, cap: pairs(df, user, item, cap // 1000))
    assert {r.jaccard for r in registry.QUERIES["jaccard_users"](spark, "").collect()} == {1.0}
    assert registry.QUERIES["jaccard_users"](spark, "").count() == 50 * 49 // 2


@pytest.mark.parametrize("block", [2048, 7])
def test_embedding_behavior_corr_equals_brute_force(spark, monkeypatch, block):
    """Real user sets, at least 5 users, every pair; small blocks give what one block gives."""
    import random
    from itertools import combinations

    import numpy as np

    from sidloom.operators import pairdist

    monkeypatch.setattr(pairdist, "BLOCK", block)
    r, rng = random.Random(4), np.random.default_rng(4)
    x = {f"c{i}": rng.standard_normal(8).tolist() for i in range(30)}
    acts = [(f"u{r.randrange(40)}", f"c{min(r.randrange(34), r.randrange(34))}") for _ in range(420)] + [(None, "c1")]
    users = {}
    for u, i in acts:
        if u:
            users.setdefault(i, set()).add(u)
    ids = sorted(i for i, us in users.items() if len(us) >= 5 and i in x)
    assert 5 < len(ids) < 30
    cos, jac = [], []
    for a, b in combinations(ids, 2):
        cos.append(round(float(np.dot(x[a], x[b]) / np.linalg.norm(x[a]) / np.linalg.norm(x[b])), 5))
        jac.append(len(users[a] & users[b]) / len(users[a] | users[b]))

    def ranks(v):
        v = np.array(v)
        return np.array([(v < y).sum() + ((v == y).sum() + 1) / 2 for y in v])

    vectors, actions = spark.createDataFrame(list(x.items()), "iid string, v array<double>"), spark.createDataFrame(acts, "uid string, iid string")
    got = pairdist.embedding_behavior_corr(vectors, actions, least_items=5).first()
    assert (got.items, got.pairs, got.co_pairs) == (len(ids), len(cos), sum(j > 0 for j in jac))
    assert abs(got.spearman - np.corrcoef(ranks(cos), ranks(jac))[0, 1]) < 1e-6
    assert pairdist.embedding_behavior_corr(vectors, actions).first().spearman is None


def test_long_histories_keep_the_whole_window(spark, tmp_path, monkeypatch):
    from sidloom.plans import pipelines, registry, relations

    strong = bits.STRONG[0]
    acts = spark.createDataFrame([("u", f"c{i:03}", strong, i, i, 1) for i in range(180)], "uid string, iid string, action_bitmap int, first_ts bigint, last_ts bigint, event_cnt bigint")
    codes = spark.createDataFrame([(f"c{i:03}", i, 1, 2, f"{i}_1_2") for i in range(180)], "content_id string, a int, b int, c int, sid string")
    monkeypatch.setattr(pipelines, "behavior", lambda *_: acts)
    monkeypatch.setattr(pipelines, "sids", lambda *_: codes)
    assert len(registry.QUERIES["seq_build"](spark, "").first().tokens.split(",")) == 510
    assert max(r.n_context for r in registry.QUERIES["pref_rf_pairs"](spark, "").collect()) == 169
    spark.createDataFrame([("u", 1, list(range(600)), 600)], "uid string, built_at bigint, tokens array<int>, split_pos int").write.parquet(f"{tmp_path}/sequences.parquet")
    assert registry.QUERIES["eval_context_pool"](spark, str(tmp_path)).first().context.split(",") == [str(i) for i in range(90, 600)]
    rated = spark.createDataFrame([(1, i, i, 5, i, 1) for i in range(300)], "uid bigint, mid bigint, ts bigint, rating int, okey bigint, lno int")
    monkeypatch.setattr(relations, "ratings", lambda *_: rated)
    row = registry.QUERIES["win_leave_last_out"](spark, "").first()
    assert row.target == 299 and row.context.split(",") == [str(i) for i in range(299)]


def test_all_pairs_and_ranks_are_kept(spark, monkeypatch):
    from sidloom.plans import registry, relations

    acts = spark.createDataFrame([(f"u{i % 7}", f"c{i:04}", 1) for i in range(1200)] + [("v", "c0007", 1)], "uid string, iid string, action_bitmap int")
    monkeypatch.setattr(relations, "behavior_v2", lambda *_: acts)
    got = sorted((r["rank"], r.iid, r.n) for r in registry.QUERIES["agg_popularity"](spark, "").collect())
    assert [r[0] for r in got] == list(range(1, 1201)) and got[0] == (1, "c0007", 2) and got[-1] == (1200, "c1199", 1)
    rated = spark.createDataFrame([(u, i, i, 5, i, 1) for i in range(8) for u in (1, 2)], "uid bigint, mid bigint, ts bigint, rating int, okey bigint, lno int")
    monkeypatch.setattr(relations, "ratings", lambda *_: rated)
    pairs = {(a, b) for a in range(8) for b in range(8) if 0 < abs(a - b) <= 5}
    assert {(r.a, r.b) for r in registry.QUERIES["self_window_cooccur"](spark, "").collect()} == pairs
    assert {(r.seed, r.cand) for r in registry.QUERIES["topk_seed_candidates"](spark, "").collect()} == pairs
    for name in ("self_swing", "union_pairs"):
        assert registry.QUERIES[name](spark, "").count() == 28
