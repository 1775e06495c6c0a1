"""Evaluation items, preference pairs, rewards and recall over sequence and candidate tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def eval_items(sequences: DataFrame, layers: int = 3) -> DataFrame:
    """(uid, built_at, item, context, target): one row per evaluation item that has a context.

    The i-th item of a sequence is predicted from the tokens before it.
    """
    t = F.col("tokens")
    first = F.floor(F.col("split_pos") / layers).cast("int")
    last = F.floor(F.size(t) / layers).cast("int") - 1
    at = sequences.where(F.size(t) >= layers).withColumn("item", F.explode(F.when(last >= F.greatest(first, F.lit(1)), F.sequence(F.greatest(first, F.lit(1)), last)).otherwise(F.array().cast("array<int>"))))
    return at.select("uid", "built_at", "item", F.slice(t, F.lit(1), F.col("item") * layers).alias("context"), F.slice(t, F.col("item") * layers + 1, F.lit(layers)).alias("target"))


def masks(sequences: DataFrame) -> DataFrame:
    """(uid, built_at, n_train, n_eval): positions whose next token is before, or from, the split."""
    n = F.size("tokens")
    train = F.greatest(F.least(F.col("split_pos"), n) - 1, F.lit(0))
    return sequences.where("tokens IS NOT NULL").select("uid", "built_at", train.alias("n_train"), (F.greatest(n - 1, F.lit(0)) - train).alias("n_eval"))


def feedback_pairs(history: DataFrame, rejected: int = 5) -> DataFrame:
    """(uid, iid, context, easy, hard) for each strong item with a context.

    ``history`` has uid, iid, first_ts, tier, rn (place in the user's kept
    window). The context are the strong and weak items before it; easy are the
    user's negatives, hard the user's weak items, over the whole window and
    other than the item itself, the first ``rejected`` by time, then id.
    """
    per = history.groupBy("uid").agg(
        F.array_sort(F.collect_list(F.when(F.col("tier") == "negative", F.struct("first_ts", "iid")))).alias("neg"),
        F.array_sort(F.collect_list(F.when(F.col("tier") == "weak", F.struct("first_ts", "iid")))).alias("weak"),
    )
    before = Window.partitionBy("uid").orderBy("rn").rowsBetween(Window.unboundedPreceding, -1)
    good = F.col("tier").isin("strong", "weak")
    ctx = history.withColumn("context", F.collect_list(F.when(good, F.col("iid"))).over(before)).where("tier = 'strong'").where(F.size("context") > 0)
    pick = lambda name: F.slice(F.filter(F.transform(name, lambda x: x["iid"]), lambda i: i != F.col("iid")), 1, rejected)
    return ctx.join(per, "uid").select("uid", "iid", "context", pick("neg").alias("easy"), pick("weak").alias("hard"))


def candidate_pairs(candidates: DataFrame, cap: int = 3) -> DataFrame:
    """Candidates (q, rank, depth) classified against the truth and cut to ``cap`` a bucket, best first."""
    bucket = F.when(F.col("depth") == 0, "easy").when(F.col("depth") == 1, "medium").otherwise("hard")
    c = candidates.where("depth < 3").withColumn("bucket", bucket)
    return c.withColumn("r", F.row_number().over(Window.partitionBy("q", "bucket").orderBy("rank"))).where(F.col("r") <= cap)


def trie(sids: DataFrame) -> DataFrame:
    """(layer, prefix, next) of all SIDs, distinct; prefix is '' on layer 0."""
    rows = F.array(
        F.struct(F.lit(0).alias("layer"), F.lit("").alias("prefix"), F.col("a").alias("next")),
        F.struct(F.lit(1).alias("layer"), F.concat_ws("_", "a").alias("prefix"), F.col("b").alias("next")),
        F.struct(F.lit(2).alias("layer"), F.concat_ws("_", "a", "b").alias("prefix"), F.col("c").alias("next")),
    )
    return sids.select("a", "b", "c").distinct().select(F.inline(rows)).distinct()


def beam_search(queries: DataFrame, tree: DataFrame, score: Column, width: int, layers: int = 3, first: int = 0) -> DataFrame:
    """The best ``width`` SIDs (path, lp) of each query under a trie, with the query's other columns.

    ``queries`` has q and, where the search starts below the root, prefix with
    its ``first`` codes. ``score`` gives the log-probability of ``next`` from
    the query's columns, layer, prefix and next. Each layer is one equi-join
    with the trie and one top-k, whose partial form runs before the shuffle.
    """
    own = [c for c in queries.columns if c != "prefix"]
    beams = (queries if "prefix" in queries.columns else queries.withColumn("prefix", F.lit(""))).withColumn("lp", F.lit(0.0))
    for k in range(first, layers):
        step = beams.join(tree.where(F.col("layer") == k), "prefix").withColumn("lp", F.col("lp") + score)
        path = F.when(F.lit(k == 0), F.col("next").cast("string")).otherwise(F.concat_ws("_", "prefix", "next"))
        step = step.select(*own, path.alias("prefix"), "lp")
        best = Window.partitionBy("q").orderBy(F.desc("lp"), "prefix")
        beams = step.withColumn("r", F.row_number().over(best)).where(F.col("r") <= width).select(*own, "prefix", "lp")
    return beams.withColumnRenamed("prefix", "path")


def sample_paths(queries: DataFrame, tree: DataFrame, logprob: Column, draws: int, layers: int = 3) -> DataFrame:
    """(q, path, lp, draws): ``draws`` samples a query under a trie, equal ones merged with their largest log-probability.

    A next code is the argmax of its log-probability plus Gumbel noise whose
    uniforms are hashes of query, draw and path, so equal runs draw alike.
    """
    paths = queries.select("q", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("k"), F.lit("").alias("prefix"), F.lit(0.0).alias("lp"))
    for layer in range(layers):
        step = paths.join(tree.where(F.col("layer") == layer), "prefix")
        h = F.conv(F.substring(F.sha2(F.concat_ws("|", "q", "k", "prefix", "next"), 256), 1, 8), 16, 10).cast("bigint")
        noisy = logprob - F.log(-F.log((h + 1) / F.lit(4294967297.0)))
        path = F.when(F.lit(layer == 0), F.col("next").cast("string")).otherwise(F.concat_ws("_", "prefix", "next"))
        best = F.max_by(F.struct(path.alias("prefix"), (F.col("lp") + logprob).alias("lp")), F.struct(noisy, -F.col("next")))
        paths = step.groupBy("q", "k").agg(best.alias("v")).select("q", "k", "v.prefix", "v.lp")
    return paths.groupBy("q", F.col("prefix").alias("path")).agg(F.max("lp").alias("lp"), F.count(F.lit(1)).alias("draws"))


def recall_at(ranked: DataFrame, truth: DataFrame, ks: list[int]) -> DataFrame:
    """(k, recall, queries): ranked has q, item, pos; truth has q, item; queries without a hit count as misses."""
    hits = truth.join(ranked, ["q", "item"], "left").groupBy("q").agg(F.min("pos").alias("pos"))
    wide = hits.agg(F.count(F.lit(1)).alias("queries"), *[F.avg(F.when(F.col("pos") <= k, 1.0).otherwise(0.0)).alias(f"k{k}") for k in ks])
    return wide.select("queries", F.explode(F.map_from_arrays(F.array(*[F.lit(k) for k in ks]), F.array(*[F.col(f"k{k}") for k in ks]))).alias("k", "recall")).select("k", "recall", "queries")
