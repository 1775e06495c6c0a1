"""Operators of the second round: exact values and edge cases on small fixtures."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sidloom import __main__ as cli
from sidloom import evaluate
from sidloom.operators import losses, prefs, relate, vectors, vq
from sidloom.operators import sequences as seq
from sidloom.plans import registry
from sidloom.sources import readers
from tests import oracle


def sids_of(spark, rows):
    return spark.createDataFrame([(f"c{i}", *map(int, s.split("_")), s) for i, s in enumerate(rows)], "content_id string, a int, b int, c int, sid string")


def test_report_skips_and_goes_on(spark, monkeypatch):
    monkeypatch.setattr(evaluate, "METRICS", dict(evaluate.METRICS))

    def fails(_):
        raise ZeroDivisionError("no rows\nmore")

    evaluate.register(evaluate.Metric("broken", fails, ()))
    evaluate.register(evaluate.Metric("empty", lambda _: None, ("sids",), (1, 2, 3)))
    got = {r.metric: r for r in evaluate.evaluate(evaluate.Inputs(sids=sids_of(spark, ["1_2_3"] * 3 + ["1_2_4"])), ["broken", "gini", "empty", "semantic_neighbor_hit_rate", "none"]).collect()}
    assert got["broken"].status == "error" and got["broken"].note == "ZeroDivisionError: no rows"
    assert got["gini"].value is not None and got["empty"].status == "unknown"
    assert got["semantic_neighbor_hit_rate"].note == "needs behavior" and got["none"].note == "unknown metric"
    text = evaluate.markdown(evaluate.evaluate(evaluate.Inputs(sids=sids_of(spark, ["1_2_3"])), ["gini", "none"]))
    assert text.startswith("# Metrics") and "| none |" in text and "1 skipped" in text
    with pytest.raises(ValueError):
        evaluate.evaluate(evaluate.Inputs(), ["gini"])
    up = evaluate.Metric("x", fails, (), (0.3, 0.2, 0.1), False)
    assert [up.status(v) for v in (0.4, 0.2, 0.15, 0.0, None)] == ["excellent", "good", "acceptable", "poor", "unknown"]


def test_command_line(spark, capsys, tmp_path):
    assert cli.main(["list"]) == 0 and "p1_found" in capsys.readouterr().out.split()
    assert cli.main(["run", "nothing", "--data", "x"]) == 2
    assert cli.main(["run", "trie_valid", "--data", "/root/testdata/sf0.001", "--out", f"{tmp_path}/t"]) == 0
    assert spark.read.parquet(f"{tmp_path}/t").count() > 0
    assert cli.main(["explain", "trie_valid", "--data", "/root/testdata/sf0.001"]) == 0 and "Physical Plan" in capsys.readouterr().out


def test_sequences_choose_their_source(spark):
    s = sids_of(spark, ["1_2_3", "4_5_6", "7_8_9"])
    b2 = spark.createDataFrame([("u", "s1", "c0", 2, 100, 100, 1), ("u", "s1", "c1", 0, 100, 100, 1), ("u", "s1", "c2", 1, 3700, 3700, 1), ("u", "s2", "c0", 4096, 9000, 9000, 1)], "uid string, session_id string, iid string, action_bitmap int, first_ts bigint, last_ts bigint, event_cnt bigint")
    exposure = spark.createDataFrame([("u", "c0", 100, ["zz", "c1", "c0"]), ("u", "c2", 200, None)], "uid string, iid string, first_ts bigint, neg_iids array<string>")
    one = seq.dispatch(s, behavior=b2, exposure=exposure, b2=b2, k=2, n_eval=1).first()
    assert one.tokens == [1, 2, 3, 7, 8, 9] and one.neg_l0 == [4, -1, 4, -1] and one.action_levels == [2] * 3 + [1] * 3
    assert one.split_pos == 6 and one.eval_cids == [] and one.span == 3600 and one.timestamps == [0.0] * 3 + [1.0] * 3
    two = seq.dispatch(s, behavior=b2, exposure=exposure, k=2).first()
    assert two.neg_l0 == [4, 1, -1, -1] and two.action_levels == [1] * 6
    three = seq.dispatch(s, behavior=b2).first()
    assert three.tokens == one.tokens and "neg_l0" not in three.asDict()
    with pytest.raises(ValueError):
        seq.dispatch(s)


def test_group_objective(spark):
    rows = [("g", 1, 3.0, -1.0, -1.0, 1, 2, 3), ("g", 2, 0.0, 50.0, -50.0, 1, 2, 9), ("g", 3, 0.0, -1.0, -1.0, 9, 2, 3), ("flat", 1, 1.0, 0.0, 0.0, 1, 1, 1), ("flat", 2, 1.0, 0.0, 0.0, 1, 1, 1)]
    df = spark.createDataFrame(rows, "g string, pos int, reward double, policy_lp double, ref_lp double, a int, b int, c int")
    got = {r.pos: r for r in losses.grpo(df, alpha=0.5, codes=["a", "b", "c"]).collect()}
    z = (0 - 1) / math.sqrt(3)
    assert set(got) == {1, 2, 3} and [round(got[p].gate, 6) for p in (1, 2, 3)] == [0, 0.666667, 0]
    assert math.isclose(got[2].advantage, z * (1 + 0.5 * 2 / 3)) and math.isclose(got[3].advantage, z)
    assert math.isclose(got[2].loss, -math.exp(10) * got[2].advantage)  # the log ratio of 100 counts as 10
    dpo = spark.createDataFrame([("x", True, 2.0, 0.0), ("x", False, 1.0, 0.0), ("x", False, 0.0, 0.0), ("alone", True, 5.0, 0.0), ("big", True, -9000.0, 0.0), ("big", False, 9000.0, 0.0)], "g string, chosen boolean, policy_lp double, ref_lp double")
    by = {r.g: r for r in losses.softmax_dpo(dpo, 0.1).collect()}
    assert math.isclose(by["x"].loss, math.log1p(math.exp(-0.1) + math.exp(-0.2))) and by["x"].win and by["alone"].loss is None
    assert math.isclose(by["big"].loss, 1800.0)
    d = losses.dpo_diagnostics(losses.softmax_dpo(dpo.where("g <> 'big'"), 0.1)).first()
    assert (d.groups, d.chosen_reward, d.rejected_reward, d.reward_margin, d.preference_acc, d.kl) == (1, 2.0, 0.5, 1.5, 1.0, 2.0)


def test_swing_leaves_single_users_out_first(spark):
    rows = [("u", f"x{i}") for i in range(250)] + [("u", "a"), ("u", "b"), ("v", "a"), ("v", "b"), ("v", None)]
    got = relate.swing(spark.createDataFrame(rows, "uid string, iid string"), "uid", "iid").collect()
    assert [(r.item_a, r.item_b) for r in got] == [("a", "b")] and math.isclose(got[0].score, 2 / 7)


def test_beams_under_a_locked_prefix(spark):
    tree = prefs.trie(sids_of(spark, ["1_2_3", "1_2_4", "1_5_6", "7_8_9"]))
    q = spark.createDataFrame([("q", "1", 9)], "q string, prefix string, extra int")
    got = prefs.beam_search(q, tree, -F.col("next").cast("double"), 2, first=1).orderBy(F.desc("lp")).collect()
    assert [(r.path, r.lp, r.extra) for r in got] == [("1_2_3", -5.0, 9), ("1_2_4", -6.0, 9)]
    whole = prefs.beam_search(q.drop("prefix"), tree, -F.col("next").cast("double"), 9)
    assert whole.count() == 4


def test_prefix_lookup_with_scales(spark):
    keys = sids_of(spark, ["1_2_3", "1_2_9", "1_9_9", "9_9_9"])
    scores = spark.createDataFrame([(3, "1_2_3", 8.0), (2, "1_2", 4.0), (1, "1", 2.0)], "depth int, prefix string, score double")
    got = {r.sid: (r.score, r.found) for r in relate.prefix_lookup(keys, scores, ["a", "b", "c"], scales=[0.1, 0.5], depth="found").collect()}
    assert got == {"1_2_3": (8.0, 3), "1_2_9": (2.0, 2), "1_9_9": (0.2, 1), "9_9_9": (0.0, 0)}


def test_codebooks(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.standard_normal((30, 4)) * 0.1 + c for c in ([5, 0, 0, 0], [0, 5, 0, 0], [0, 0, 5, 0])])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, []), (902, [1.0])], "id int, v array<double>")
    book, inertia, used = vq.fit(df.where("id < 900"), "v", 3, tries=3)
    assert used < 25 and inertia < 10 and len({int(r.argmax()) for r in book}) == 3
    coded = vq.encode(df, "id", "v", [book, np.zeros((1, 4))]).collect()
    assert len(coded) == 90 and all(np.allclose(x[r.id] - book[r.codes[0]], x[r.id] - book[vq.nearest(x[r.id : r.id + 1], book)[0]]) for r in coded)
    assert all(math.isclose(r.losses[0], ((x[r.id] - book[r.codes[0]]) ** 2).sum(), rel_tol=1e-9) for r in coded)
    back = {r.id: r.v for r in vq.decode(spark.createDataFrame([(1, [0, 1]), (2, [2, 0])], "id int, codes array<int>"), "id", "codes", [book, book]).collect()}
    assert np.allclose(back[1], book[0] + book[1])
    halves = [book[:, :2], book[:, 2:]]
    flat = {r.id: r.v for r in vq.decode(spark.createDataFrame([(1, [0, 1])], "id int, codes array<int>"), "id", "codes", halves, slices=True).collect()}
    assert np.allclose(flat[1], np.r_[book[0, :2], book[1, 2:]])
    with pytest.raises(ValueError):
        vq.rows(df, "id", "v", 0, vq.MAX_CODES + 1)
    five, _, _ = vq.fit(df.where("id < 3"), "v", 5, rounds=2)
    assert len(five) == 3  # fewer vectors than codes


@pytest.mark.parametrize("blocks", [(4096, 65536), (3, 7)])
def test_topk_in_blocks(spark, monkeypatch, blocks):
    monkeypatch.setattr(vectors, "QUERIES", blocks[0])
    monkeypatch.setattr(vectors, "VECTORS", blocks[1])
    x = np.random.default_rng(3).standard_normal((40, 8))
    x[39] = x[38]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(90, [0.0] * 8), (91, None), (92, [])], "id bigint, v array<double>")
    got = {}
    for r in vectors.topk_cosine(df.where("id < 12"), df, 4).collect():
        got.setdefault(r.q, []).append((-round(r.cosine, 9), r.c))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q in range(12):
        want = sorted((-round(float(u[q] @ u[j]), 9), j) for j in range(40) if j != q)[:4]
        assert sorted(got[q]) == want
    assert vectors.topk_cosine(df.limit(0), df, 4).count() == 0


def test_days_and_archives(spark, tmp_path):
    import io
    import zipfile

    spark.createDataFrame([("20250101", 1), ("20250103", 3)], "day string, n int").write.partitionBy("day").parquet(f"{tmp_path}/d")
    assert [r.n for r in readers.read_days(spark, f"{tmp_path}/d", "2025-01-02", "2025-01-04").collect()] == [3]
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        z.writestr("a/x.csv", 'id,t\n1,"a, b"\n')
        z.writestr("a/y.csv", "id\n")
    df = spark.createDataFrame([(bytearray(packed.getvalue()),)], "content binary")
    assert [tuple(r) for r in readers.read_zip_csv(df, "x.csv", "id int, t string").collect()] == [(1, "a, b")]
    assert readers.read_zip_csv(df, "y.csv", "id int").count() == 0


def test_late_rows_are_dropped(spark, tmp_path):
    """A row behind the watermark of an earlier batch is in no session."""
    from sidloom.streaming import jobs

    src, out = f"{tmp_path}/src", f"{tmp_path}/out"
    rows = [[(1, "2025-01-01 00:00:00"), (1, "2025-01-01 01:00:00"), (2, "2025-01-05 00:00:00")], [(1, "2025-01-01 02:00:00"), (2, "2025-01-05 01:00:00")], [(9, "2025-02-01 00:00:00")]]
    for part in rows:
        df = spark.createDataFrame(part, "user_id bigint, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
        df.coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(df.schema).parquet(src)
        q = jobs.sessions(stream, "12 hours", "1 hour").writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{tmp_path}/state").option("path", out).trigger(availableNow=True).start()
        q.awaitTermination()
    got = {(r.user_id, str(r.start), r.n) for r in spark.read.parquet(out).collect()}
    assert got == {(1, "2025-01-01 00:00:00", 2), (2, "2025-01-05 00:00:00", 2)}


def test_ratings_of_the_first_users(spark):
    rows = [(u, i, i, 5, i, 1) for u in (3, 1, 2) for i in range(4)] + [(1, 3, 9, 5, 9, 1), (4, 1, 1, 5, 1, 1)]
    df = spark.createDataFrame(rows, "uid int, mid int, ts int, rating int, okey int, lno int")
    got = seq.filter_ratings(df, 4, 2, 2)
    assert sorted({r.uid for r in got.collect()}) == [1, 2] and got.count() == 8 and seq.filter_ratings(df, 4, 2).count() == 12


def test_variants_of_a_configuration(tmp_path):
    base = {"a": 1, "b": 2}
    assert readers.resolve_variants(base, {"base": "x", "b": 3}, "stem") == [("stem", {"a": 1, "b": 3})]
    assert readers.resolve_variants(base, {"name": "n", "variants": [{"name": "v", "c": 4}]}, "stem") == [("v", {"a": 1, "b": 2, "c": 4})]
    (tmp_path / "c.json").write_text('{"a": [1, 2]}')
    assert readers.read_config(str(tmp_path / "c.json")) == {"a": [1, 2]}


def test_images_have_a_status_each(spark):
    from sidloom.operators.rewards import HttpError, fetch_images

    def fetch(url):
        if url == "slow":
            raise TimeoutError
        if url == "gone":
            raise HttpError(410)
        return {"none": b"", "big": b"x" * 9}.get(url, b"abc") if url != "odd" else 1 / 0

    df = spark.createDataFrame([(u,) for u in ("ok", "slow", "gone", "none", "big", "odd", "", None)], "image string")
    got = {r.image: (r.status, r.size_bytes, r.path is not None) for r in fetch_images(df, "image", "p", fetch, lambda path: None, lambda path, body: None, 5).collect()}
    assert got == {"ok": ("ok", 3, True), "slow": ("timeout", None, False), "gone": ("http_410", None, False), "none": ("empty_body", 0, False), "big": ("too_large", 9, False), "odd": ("error_ZeroDivisionError", None, False), "": ("empty", None, False), None: ("empty", None, False)}
    assert {r.status for r in fetch_images(df.limit(1), "image", "p", fetch, lambda path: 5, lambda path, body: None, 5).collect()} == {"cached"}


def most_rows(plan):
    """The largest number of rows that comes out of a node of a plan that has run."""
    if "AdaptiveSparkPlan" in plan.nodeName():
        return most_rows(plan.executedPlan())
    below = [plan.plan()] if "QueryStage" in plan.nodeName() else [plan.children().apply(i) for i in range(plan.children().size())]
    n = plan.metrics().get("numOutputRows")
    return max([n.get().value() if n.isDefined() else 0, *map(most_rows, below)])


def test_public_recall_of_sids_with_many_items(spark, tmp_path, monkeypatch):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    mid = "CASE WHEN l_orderkey % 3 = 0 THEN l_orderkey * l_orderkey % 911 ELSE l_orderkey * 7919 % 51200 END"
    tables = {
        "part": "SELECT p AS p_partkey, 'n' AS p_name, 't' AS p_type, 'b' AS p_brand FROM range(51200) t(p)",  # 100 items a SID
        "orders": "SELECT o AS o_orderkey, o // 5 AS o_custkey, TIMESTAMP '2024-01-01' + to_days((o * 37 % 400)::INT) AS o_orderdate FROM range(10000) t(o)",
        "lineitem": f"SELECT l_orderkey, ({mid})::BIGINT AS l_partkey, 1::INT AS l_linenumber, 45.0::DOUBLE AS l_quantity FROM range(10000) t(l_orderkey)",
    }
    for name, select in tables.items():
        con.execute(f"COPY ({select}) TO '{tmp_path}/{name}.parquet'")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    monkeypatch.setattr(oracle, "DATA", str(tmp_path))
    ran = []

    def query(*args):
        ran.append(registry.QUERIES["recall_public"](*args))
        return ran[0]

    oracle.check(spark, con, query, registry.SQL["recall_public"])
    rates = [r.recall for r in ran[0].orderBy("k").collect()]
    assert 0 < rates[2] < rates[3] < rates[5]
    assert most_rows(ran[0]._jdf.queryExecution().executedPlan()) < 300_000  # the beams' items are 2,000,000 rows
