"""Training-data operators against brute force, with edge cases."""

import random
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from sidloom.llm import cooccur, density, frequent, leakage, neighbors, packing, queries, residue, vectors
from tests.oracle import DATA, check, views


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_matches_sql(spark, name):
    check(spark, views(), queries.QUERIES[name], queries.SQL[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_runs(spark, name):
    assert queries.QUERIES[name](spark, DATA).count() > 0


# --- co-occurrence -----------------------------------------------------------


def brute_pairs(rows):
    baskets = defaultdict(set)
    for u, s, i in rows:
        if None not in (u, s, i):
            baskets[u, s].add(i.strip().lower())
    n = Counter(i for b in baskets.values() for i in b)
    return {(a, b): (c, n[a], n[b], len(baskets)) for (a, b), c in Counter(p for b in baskets.values() for p in combinations(sorted(b), 2)).items()}


@pytest.mark.parametrize("chunk", [512, 4])
def test_pairs_equal_brute_force(spark, monkeypatch, chunk):
    """With a small chunk every larger basket takes the way of the giant ones."""
    monkeypatch.setattr(cooccur, "CHUNK", chunk)
    r = random.Random(3)
    rows = [(f"u{r.randrange(9)}", f"s{r.randrange(3)}", f"{' ' * r.randrange(2)}{'cC'[r.randrange(2)]}{r.randrange(25)}") for _ in range(600)]
    rows += [(None, "s1", "c1"), ("u1", None, "c1"), ("u1", "s1", None)] + [("u1", "s1", "c1")] * 5
    df = spark.createDataFrame(rows, "uid string, session_id string, iid string").withColumn("item", F.lit(1)).withColumn("n_x", F.lit(2))
    got = {(x.iid_a, x.iid_b): (x.n_ab, x.n_a, x.n_b, x.n_baskets) for x in cooccur.cooccurrence(df, ["uid", "session_id"], "iid").collect()}
    assert got == brute_pairs(rows)
    few = cooccur.cooccurrence(df, ["uid", "session_id"], "iid", min_count=9, min_lift=1.1)
    assert {(x.iid_a, x.iid_b) for x in few.collect()} == {p for p, (c, a, b, n) in brute_pairs(rows).items() if c >= 9 and c * n / (a * b) >= 1.1}
    assert cooccur.cooccurrence(df.limit(0), ["uid", "session_id"], "iid").count() == 0


def test_rare_significant_pairs_are_found(spark, tmp_path):
    """One common basket of 100 is significant for two items seen nowhere else."""
    rows = [("u", f"s{i}", "often", 1) for i in range(99)] + [("u", "s99", "rare1", 1), ("u", "s99", "rare2", 1)]
    spark.createDataFrame(rows, "uid string, session_id string, iid string, action_bitmap int").write.parquet(f"{tmp_path}/behavior_v2.parquet")
    got = queries.QUERIES["p2_pair_significance"](spark, str(tmp_path)).collect()
    assert [(r.iid_a, r.iid_b, r.n_ab, r.n_a, r.n_b) for r in got] == [("rare1", "rare2", 1, 1, 1)]


@pytest.mark.parametrize("whole, hot", [(16, 0.01), (1, 0.5), (0, 2.0)])
def test_stripes_in_parts_are_the_same(spark, monkeypatch, whole, hot):
    """Stripes cut into parts, and items joined by broadcast or by shuffle, give the same pairs."""
    monkeypatch.setattr(cooccur, "WHOLE", whole)
    monkeypatch.setattr(cooccur, "HOT", hot)
    r = random.Random(8)
    rows = [(f"u{u}", "s", "top") for u in range(60)] + [(f"u{r.randrange(60)}", "s", f"c{r.randrange(40)}") for _ in range(900)]
    df = spark.createDataFrame(rows, "uid string, session_id string, iid string")
    got = {(x.iid_a, x.iid_b): (x.n_ab, x.n_a, x.n_b, x.n_baskets) for x in cooccur.cooccurrence(df, ["uid", "session_id"], "iid").collect()}
    assert got == brute_pairs(rows)


def test_stripes_are_merged_across_batches(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(cooccur, "BUFFER", 8)
    r = np.random.default_rng(4)
    triples = [(int(a), 0, int(b), 1) for a, b in sorted(zip(r.integers(0, 5, 300), r.integers(5, 12, 300)))]
    batches = [cooccur._rows(*(np.array(x, t) for x, t in zip(zip(*triples[i : i + 7]), (np.int64, np.int32, np.int64, np.int64)))) for i in range(0, 300, 7)]
    got = Counter()
    for b in cooccur._merge(1)(iter(batches)):
        for a, nbrs, cnts in zip(*(b.column(c).to_pylist() for c in ("item_a", "nbrs", "cnts"))):
            for x, n in zip(nbrs, cnts):
                assert (a, x) not in got
                got[a, x] = n
    assert got == Counter((a, b) for a, _, b, _ in triples) and isinstance(batches[0], pa.RecordBatch)


# --- vectors -----------------------------------------------------------------


def make_vectors(n=600, d=128, seed=5):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((12, d))
    x = centres[rng.integers(0, 12, n)] + rng.standard_normal((n, d)) * 0.45
    x[: n // 6] = rng.standard_normal((n // 6, d))
    x[n // 2 : n // 2 + 40] = x[:40] + rng.standard_normal((40, d)) * 0.15  # near copies
    x[n - 20 :] = x[0] * 3.0  # copies of one vector, of other length
    return x


def vector_rows(x):
    rows = [(f"c{i:05d}", v.tolist(), 1) for i, v in enumerate(x)]
    dirty = [("c00001", [9.0] * 128, 0), ("C00002 ", rows[2][1], 1), ("bad1", None, 1), ("bad2", [0.0] * 128, 1), ("bad3", [1.0] * 64, 1), ("bad4", [float("nan")] * 128, 1), (None, [1.0] * 128, 1), ("bad5", [float("inf")] + [1.0] * 127, 1)]
    return rows + dirty


def latest(spark, x):
    df = spark.createDataFrame(vector_rows(x), "content_id string, embedding array<float>, encoded_at int").withColumn("vec", F.lit("clash")).withColumn("sid", F.lit("1_2_3"))
    return vectors.latest_vectors(df, "content_id", "embedding", "encoded_at", 128, "sid")


def unit(x):
    x = x.astype(np.float32).astype(np.float64)
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def test_neighbors_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(neighbors, "GROUP", 200)  # groups are cut into chunks too
    x = make_vectors()
    got = defaultdict(dict)
    for r in neighbors.similar_items(latest(spark, x).select("cid", "vec"), 5).collect():
        got[r.content_id][r.neighbor_id] = r.cosine
    s = unit(x) @ unit(x).T
    np.fill_diagonal(s, -2)
    hits = total = 0
    for i in range(len(x)):
        best = sorted((-round(v, 6), f"c{j:05d}") for j, v in enumerate(s[i]))[:5]
        total += 5
        hits += sum(c in got[f"c{i:05d}"] for _, c in best)
        assert all(c in got[f"c{i:05d}"] for v, c in best if -v >= 0.95)
    assert hits / total >= 0.9
    assert all(abs(v - s[int(a[1:]), int(b[1:])]) < 1e-5 for a, m in got.items() for b, v in m.items())
    assert not any(k.startswith("bad") for k in got)


def test_perturbed_buckets_find_neighbours(spark, monkeypatch):
    """With small buckets there are hashes, probes and several tables; recall stays."""
    monkeypatch.setattr(neighbors, "BUCKET", 100)
    monkeypatch.setattr(neighbors, "GROUP", 60)
    assert neighbors.plan(600)[0] >= 2 and neighbors.plan(600)[1] >= 4 and neighbors.plan(600)[2] >= 1
    x = make_vectors()[100:580]
    s = unit(x) @ unit(x).T
    np.fill_diagonal(s, -2)
    got = defaultdict(set)
    for r in neighbors.similar_items(latest(spark, x).select("cid", "vec"), 5).collect():
        got[r.content_id].add(r.neighbor_id)
    best = [{f"c{j:05d}" for j in np.argsort(-row, kind="stable")[:5]} for row in s]
    near = [{f"c{j:05d}" for j in np.flatnonzero(row >= 0.95)} for row in s]
    assert sum(len(b & got[f"c{i:05d}"]) for i, b in enumerate(best)) / (5 * len(x)) >= 0.9
    assert all(len(n) > 5 or n <= got[f"c{i:05d}"] for i, n in enumerate(near))


def test_nearest_is_exact():
    rng = np.random.default_rng(6)
    x = rng.standard_normal((3000, 16)).astype(np.float32)
    ids = rng.permutation(3000)
    q, c, v = neighbors.nearest(ids[:50], x[:50], ids, x, 4)
    s = x[:50] @ x.T
    s[np.arange(50), np.arange(50)] = -9
    for i in range(50):
        assert set(c[q == ids[i]]) == set(ids[np.argsort(-s[i])[:4]])


def test_neighbors_of_one_item_or_none(spark):
    one = latest(spark, make_vectors()[:3]).where("cid = 'c00000'").select("cid", "vec")
    assert neighbors.similar_items(one).count() == 0 and neighbors.similar_items(one.limit(0)).count() == 0


def brute_clusters(x, t=0.7):
    s = unit(x) @ unit(x).T >= t
    label = list(range(len(x)))
    for _ in range(len(x)):
        new = [min(label[j] for j in np.flatnonzero(s[i])) for i in range(len(x))]
        if new == label:
            break
        label = new
    return {f"c{i:05d}": f"c{v:05d}" for i, v in enumerate(label)}, s.sum(axis=1) - 1


@pytest.mark.parametrize("chunk, sparse", [(8192, 32), (50, 32), (8192, 0), (50, 0), (50, 3)])
def test_clusters_equal_components(spark, monkeypatch, chunk, sparse):
    """Blocks that hand on their pairs, blocks that are compared again, and both."""
    monkeypatch.setattr(density, "CHUNK", chunk)
    run = density.BlockJoin.run

    def with_bound(self, items, pairs, schema, only=None):
        def bounded(*args):
            density.SPARSE = sparse  # in the worker
            return pairs(*args)

        return run(self, items, bounded, schema, only)

    monkeypatch.setattr(density.BlockJoin, "run", with_bound)
    x = make_vectors()
    # a chain in which only consecutive vectors belong together
    rng = np.random.default_rng(1)
    e, f = np.linalg.qr(rng.standard_normal((128, 2)))[0].T
    x[100:108] = [np.cos(k * 0.7) * e + np.sin(k * 0.7) * f for k in range(8)]
    want, rho = brute_clusters(x)
    rows = density.density_clusters(latest(spark, x), 0.7).collect()
    got = {r.content_id: r.cluster_id for r in rows}
    assert {k: v for k, v in got.items() if not k.startswith("bad")} == want
    assert all(r.rho == rho[int(r.content_id[1:])] for r in rows)
    d = density.describe_clusters(density.density_clusters(latest(spark, x), 0.7)).collect()
    assert sum(r["size"] for r in d) == len(x) and all(r.agreement == 1.0 for r in d)
    assert density.density_clusters(latest(spark, x).limit(0)).count() == 0


# --- frequent items ----------------------------------------------------------


def test_frequent_items_are_exact(spark):
    r = random.Random(1)
    values = ["hot"] * 900 + [f"w{r.randrange(30)}" for _ in range(3000)] + [f"rare{i}" for i in range(20000)] + [None] * 7
    df = spark.createDataFrame([(v, 1) for v in values], "item string, code int").repartition(5)
    n = Counter(v for v in values if v)
    got = {x.item: x.n for x in frequent.frequent_items(df, "item", 1 / 300).collect()}
    assert got == {k: c for k, c in n.items() if c >= sum(n.values()) / 300}
    assert frequent.frequent_items(df.limit(0), "item", 0.01).count() == 0


@pytest.mark.parametrize("nodes, share", [(3, 1 / 100), (4096, 1 / 7000)])
def test_small_shares_are_exact_too(spark, monkeypatch, nodes, share):
    """Too many heavy prefixes, or a share below what the counters tell: the descent stops early and the second scan counts more."""
    monkeypatch.setattr(frequent, "MAX_NODES", nodes)
    values = [f"w{i % 40}" for i in range(4000)] + [f"rare{i}" for i in range(3000)]
    df = spark.createDataFrame([(v,) for v in values], "item string")
    got = {x.item: (x.n, x.n_total) for x in frequent.frequent_items(df, "item", share).collect()}
    assert got == {v: (n, 7000) for v, n in Counter(values).items() if n >= 7000 * share}


def test_targets_of_the_latest_sequence(spark):
    rows = [("u", [" A", "b", None, " "], 2), ("u", ["old"], 1), ("v", None, 1), ("w", [], 1), (None, ["x"], 1), ("z", ["B\t", "b"], None)]
    df = spark.createDataFrame(rows, "uid string, eval_cids array<string>, built_at int")
    assert sorted(r.item for r in frequent.latest_targets(df).collect()) == ["a", "b", "b", "b"]


# --- packing -----------------------------------------------------------------


def test_first_fit_decreasing_equals_the_plain_loop():
    r = random.Random(2)
    sizes = np.array(sorted((r.randrange(1, 100) for _ in range(500)), reverse=True))
    rooms, want = [], []
    for s in sizes:
        i = next((i for i, room in enumerate(rooms) if room >= s), None)
        if i is None:
            rooms.append(100)
            i = len(rooms) - 1
        want.append((i, 100 - rooms[i]))
        rooms[i] -= s
    bins, offsets = packing.first_fit_decreasing(sizes, 100)
    assert list(zip(bins.tolist(), offsets.tolist())) == want


def test_windows_hold_every_text_once(spark):
    texts = [None, "", " ", "one", "word " * 5000, "x" * 9000] + [f"text {i} " * (i % 300) for i in range(200)] + ["same"] * 3
    df = spark.createDataFrame([(i % 205, t, "clash") for i, t in enumerate(texts)], "doc_id bigint, text string, key string")
    lengths = packing.scratch.keep(packing.token_lengths(df, "doc_id", "text"), "t")
    rows = packing.pack(lengths, group_tokens=20_000).collect()
    want = Counter((r.row_no, r.n_tokens) for r in lengths.collect())
    got = Counter()
    for r in rows:
        got[r.row_no] += r.n_tokens
    assert Counter(got.items()) == want
    per = defaultdict(list)
    for r in rows:
        if r.window_id is None:
            assert r.n_tokens == 0
        else:
            per[r.window_id].append((r.place, r.n_tokens))
    for w in per.values():
        at = 0
        for place, n in sorted(w):
            assert place == at
            at += n
        assert at <= packing.WINDOW
    pieces = defaultdict(list)
    for r in rows:
        pieces[r.row_no].append(r.n_tokens)
    assert all(len(p) == 1 or sum(p) > packing.WINDOW for p in pieces.values())


def test_windows_do_not_depend_on_partitions(spark):
    texts = [f"text {i} " * (i % 90) for i in range(150)] + ["same"] * 4
    df = spark.createDataFrame([(i % 151, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    got = [sorted(map(tuple, packing.pack(packing.scratch.keep(packing.token_lengths(df.repartition(n), "doc_id", "text"), "t"), group_tokens=9000).collect())) for n in (1, 7)]
    assert got[0] == got[1]


def test_copies_are_numbered_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(packing, "COPIES", 3)
    df = spark.createDataFrame([(1, "a b")] * 10 + [(2, None)], "doc_id bigint, text string")
    rows = packing.token_lengths(df, "doc_id", "text").collect()
    assert len(rows) == 11 and len({r.row_no for r in rows}) == 11 and Counter(r.key for r in rows) == {1: 10, 2: 1}


def test_long_texts_are_counted_whole(monkeypatch):
    text = "Some words, 12 numbers and\n\nbreaks 中文 here. " * 400
    whole = len(packing.encoder(packing.VOCABULARY).encode_ordinary(text))
    monkeypatch.setattr(packing, "PART", 500)
    assert packing.count_tokens(text) == whole


# --- leakage -----------------------------------------------------------------


@pytest.mark.parametrize("words", [leakage.BLOCK_WORDS, 0])
def test_leaks_equal_brute_force(spark, monkeypatch, words):
    """Passages that are broadcast, and passages that are joined."""
    monkeypatch.setattr(leakage, "BLOCK_WORDS", words)
    r = random.Random(4)
    vocab = [f"w{i}" for i in range(40)]
    passages = [(i, " ".join(r.choice(vocab) for _ in range(n))) for i, n in enumerate([3, 5, 8, 11, 12, 13, 40, 60])] + [(90, None), (91, " .. "), (92, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 w12")]
    docs = []
    for d in range(120):
        w = [r.choice(vocab) for _ in range(r.randrange(0, 80))]
        if d % 2:
            p = passages[r.randrange(8)][1].split()
            k = r.randrange(4, 14)
            s = r.randrange(max(1, len(p) - k + 1))
            w[len(w) // 2 : len(w) // 2] = p[s : s + k]
        docs.append((d, " ".join(w)))
    docs += [(200, None), (201, ""), (202, "<p>W1, w2<br/>w3 *w4* w5­ w6 wéé w7</p>"), (203, "W1, <b>w2</b>\nw3 (w4) w​5 — w6: W7. w8 w9 w10 &amp; w11 wˆ12 ".replace("wˆ12", "w12"))]
    want = set()
    for i, p in passages:
        q = leakage.words(p or "")
        m = min(12, len(q))
        runs = {tuple(q[k : k + m]) for k in range(len(q) - m + 1)} if m else set()
        for d, t in docs:
            w = leakage.words(t or "")
            if any(tuple(w[k : k + m]) in runs for k in range(len(w) - m + 1)) and m:
                want.add((d, i))
    ddf = spark.createDataFrame(docs * 2, "doc_id bigint, text string").withColumn("item_id", F.lit(1))
    idf = spark.createDataFrame(passages, "item_id bigint, passage string")
    rows = leakage.leaked_passages(ddf, "doc_id", "text", idf, "item_id", "passage").collect()
    assert len(rows) == len(want) and {tuple(x) for x in rows} == want and (203, 92) in want
    assert leakage.leaked_passages(ddf, "doc_id", "text", idf.limit(0), "item_id", "passage").count() == 0


def test_words():
    assert leakage.words("L'Été, <em>n</em>ul­le &eacute;té x_y") == ["l", "ete", "nulle", "ete", "x", "y"]


# --- residue -----------------------------------------------------------------

BAD = [
    "Title: {{ title }}\nPrice: [INSERT PRICE]", "A warm lamp for ${amount} coins in the market, said the seller with a smile.", "Please enable JavaScript to view this page.",
    "Für diese Seite wird JavaScript benötigt.", "Error 500: internal server error. ref 9c6352", "404 Not Found", "Access denied. You do not have permission to view this item.", "TODO\ntbd\nn/a\nxxxx",
    "asdf qwer zxcv asdfgh jkl", "undefined null NaN [object Object]", "Lorem ipsum dolor sit amet, bato miku ralo. pinu talo, miku.", "Text text text. Text text text.", "请打开 JavaScript 后再查看本页。",
    "Une erreur est survenue. Merci de réessayer plus tard.", "Esta página necesita JavaScript y cookies.",
]
GOOD = [
    None, "", "  \n ", "The card template uses `{{ price }}` and `${tag}`, which the renderer fills.", "```python\nmsg = f\"{user} opened {item}\"\nprint(\"%s\" % msg)\n```\nSeed 3 and seed 4 agree.",
    "Gracal found \"page not found\" in 627 texts of the crawl and dropped them from the checkpoint.", "Ohne JavaScript lädt der Laden schneller, schreibt Renbri, nur die Bilder fehlen.",
    "We painted the old harbour for three days and nobody minded the rain, which was warm and short. The lamp stayed on.\n\nComments are unavailable right now. Error 503.",
    "Mibri说旧列表里的 404 错误已经修好了。", "The set {x : x < 9} and the map {a: 1, b: 2} are examples.",
]


def test_residue_verdicts(spark):
    rows = [(i, t, "clash") for i, t in enumerate(BAD)] + [(100 + i, t, "clash") for i, t in enumerate(GOOD)] + [(7, BAD[7], "again"), (500, " ".join(f"word{i} and" for i in range(20000)), "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, m string")
    got = [r.doc_id for r in residue.residue_records(df, "doc_id", "text").where("residue").collect()]
    assert sorted(got) == sorted([*range(len(BAD)), 7])
    assert residue.residue_records(df.limit(0), "doc_id", "text").count() == 0


def test_other_messages_do_not_take_a_verdict_away(spark):
    rows = [(1, "The page was removed."), (2, "The page was renamed."), (3, "The page was deleted."), (4, "The page was printed.")]
    rows += [(10 + i, f"The page was {w}.") for i, w in enumerate("abcdefgh")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    for ids in ([1], [1, 2], [1, 2, 3, 4], [r[0] for r in rows]):
        got = residue.residue_records(df.where(F.col("doc_id").isin(ids)), "doc_id", "text").where("residue").collect()
        assert {r.doc_id for r in got} == {1, 3} & set(ids)


@pytest.mark.parametrize("parts", [1, 7])
def test_templates_decide(spark, parts):
    """A wording without a seed is found by the template it shares with others; without templates it is lost."""
    rows = [(i, f"The {a} {b} was {v}.") for i, (a, b, v) in enumerate((a, b, v) for a in ("old", "new", "long") for b in ("page", "list", "post") for v in ("removed", "blocked"))]
    rows = [(i, t.replace(f"{w} ", "", 1) if k else t) for k in (1,) for i, t in rows for w in ("old", "new", "long") if w in t]
    rows += [(100 + i, f"The {w} was blocked.") for i, w in enumerate(("shelf", "basket"))]
    rows += [(200 + i, f"Rated {i} of 100: {w} and a bit too warm.") for i, w in enumerate(("odd", "blue", "tidy", "calm"))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(parts)
    got = {r.doc_id for r in residue.residue_records(df, "doc_id", "text").where("residue").collect()}
    assert got == {i for i, _ in rows if i < 200}
    alone = df.where("doc_id >= 100")
    assert residue.residue_records(alone, "doc_id", "text").where("residue").count() == 0


def test_templates_have_slots(spark):
    texts = ["access denied for alpha on shelf", "access denied for beta on shelf", "access granted to all", " ".join("abcdefghijklmnop")]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("leaf", F.lit(1)).withColumn("m", F.lit("x"))
    mined = {r.template: (r.messages, r.seeded) for r in residue.mine_templates(residue.read_messages(df, "doc_id", "text")).collect()}
    assert mined == {"access denied for <*> on shelf": (2, 1.0), "access granted to all": (1, 0.0), "a b c d e f g h i j k l … p": (1, 0.0)}


def test_the_model_needs_two_words_and_learns_from_its_labels():
    texts = [f"the {w} could not be opened" for w in "abcdefgh"] + [f"the {w} looks warm" for w in "abcdefgh"]
    w = residue.fit(texts, np.arange(16) < 8)
    got = residue.chances(["that crate could not be opened", "that crate looks warm", "could <*>"], w)
    assert got[0] > 0.5 > got[1] and got[2] == 0
