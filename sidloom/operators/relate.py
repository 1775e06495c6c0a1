"""Joins the domain needs beyond plain equi-joins: bands, prefixes, diffs, co-users."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def band_pairs(df: DataFrame, user: str, item: str, place: str, width: int) -> DataFrame:
    """(item_a, item_b, weight) of items at most ``width`` places apart, weight 1 / distance.

    Each row reaches its next ``width`` rows by window offsets, so the join is
    one sort per user and has no quadratic step.
    """
    w = Window.partitionBy(user).orderBy(place)
    steps = F.array(*[F.struct(F.lead(item, k).over(w).alias("b"), F.lit(1.0 / k).alias("w")) for k in range(1, width + 1)])
    rows = df.select(F.col(item).alias("a"), steps.alias("steps")).select("a", F.explode("steps").alias("s")).where("s.b IS NOT NULL")
    return rows.select("a", F.col("s.b").alias("b"), F.col("s.w").alias("weight"))


def top_by_seed(pairs: DataFrame, seed: str, by: str, item: str, k: int) -> DataFrame:
    """The k best rows of each seed, ties to the smaller item."""
    w = Window.partitionBy(seed).orderBy(F.desc(by), item)
    return pairs.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def adjacent_pairs(df: DataFrame, user: str, item: str, by: list[str]) -> DataFrame:
    """Distinct unordered pairs of consecutive different items of a user."""
    prev = F.lag(item).over(Window.partitionBy(user).orderBy(*by))
    pairs = df.select(F.col(item).alias("i"), prev.alias("p")).where("p IS NOT NULL AND p <> i")
    return pairs.select(F.least("i", "p").alias("item_a"), F.greatest("i", "p").alias("item_b")).distinct()


def user_pairs(df: DataFrame, user: str, item: str, cap: int) -> DataFrame:
    """Unordered item pairs inside each user of at most ``cap`` items (larger users are out by definition)."""
    u = df.select(user, item).distinct()
    u = u.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(user))).where(F.col("_n") <= cap)
    other = u.select(user, F.col(item).alias("item_b"))
    return u.select(user, F.col(item).alias("item_a"), "_n").join(other, user).where("item_a < item_b")


def all_user_pairs(df: DataFrame, user: str, item: str, chunk: int = 512) -> DataFrame:
    """(item_a, item_b) for each user who has both, item_a the smaller, whatever number of items a user has.

    The items of a user of more than ``chunk`` are cut by a hash into chunks
    and each pair of chunks is a join key of its own, so no task pairs all
    items of a large user.
    """
    u = df.select(F.col(user).alias("_u"), F.col(item).alias("_i")).dropna().distinct()
    large = u.groupBy("_u").agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias("_k")).where("_k > 1")
    cut = u.join(large, "_u", "left").withColumn("_k", F.coalesce("_k", F.lit(1))).withColumn("_c", F.pmod(F.xxhash64("_i"), F.col("_k")).cast("int"))
    one = cut.select("_u", F.col("_i").alias("_x"), F.col("_c").alias("_lo"), F.explode(F.sequence(F.col("_c"), F.col("_k") - 1)).alias("_hi"))
    two = cut.select("_u", F.col("_i").alias("_y"), F.explode(F.sequence(F.lit(0), F.col("_c"))).alias("_lo"), F.col("_c").alias("_hi"))
    pairs = one.join(two, ["_u", "_lo", "_hi"]).where("_lo < _hi OR _x < _y")
    return pairs.select(F.least("_x", "_y").alias("item_a"), F.greatest("_x", "_y").alias("item_b"))


def swing(df: DataFrame, user: str, item: str, alpha: float = 5.0, cap: int = 200) -> DataFrame:
    """(item_a, item_b, score): every user who has both adds 1 / (alpha + its items).

    Items of one user only leave first; after that, users of more than ``cap``
    items add nothing, by definition of the score.
    """
    df = df.select(user, item).dropna().distinct()
    df = df.join(df.groupBy(item).agg(F.count(F.lit(1)).alias("_u")).where("_u >= 2").select(item), item, "left_semi")
    return user_pairs(df, user, item, cap).groupBy("item_a", "item_b").agg(F.sum(1.0 / (F.lit(alpha) + F.col("_n"))).alias("score"))


def jaccard(df: DataFrame, user: str, item: str, least: int = 1) -> DataFrame:
    """(item_a, item_b, jaccard): common users of two items over all their users, for pairs with at least ``least`` common users."""
    u = df.select(user, item).dropna().distinct()
    n = u.groupBy(item).agg(F.count(F.lit(1)).alias("n"))
    k = all_user_pairs(u, user, item).groupBy("item_a", "item_b").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") >= least)
    j = k.join(n.select(F.col(item).alias("item_a"), F.col("n").alias("na")), "item_a").join(n.select(F.col(item).alias("item_b"), F.col("n").alias("nb")), "item_b")
    return j.select("item_a", "item_b", (F.col("k") / (F.col("na") + F.col("nb") - F.col("k"))).alias("jaccard"))


def prefix_lookup(keys: DataFrame, scores: DataFrame, codes: list[str], scale: float = 0.5, default: float = 0.0, scales: list[float] | None = None, depth: str | None = None) -> DataFrame:
    """The score of the longest prefix of ``codes`` that is in ``scores``, times scale per code missing.

    ``scores`` has depth, prefix, score, one row each; one equi-join a depth.
    ``scales`` gives the factor of each shorter length (the shortest first)
    instead; ``depth`` names a column for the length found, 0 for none.
    """
    out, hits, at_depth = keys, [], F.lit(0)
    for k in range(len(codes), 0, -1):
        at = scores.where(F.col("depth") == k).select(F.col("prefix").alias(f"_p{k}"), F.col("score").alias(f"_s{k}"))
        out = out.withColumn(f"_p{k}", F.concat_ws("_", *codes[:k])).join(at, f"_p{k}", "left")
        factor = 1.0 if k == len(codes) else scales[k - 1] if scales else scale ** (len(codes) - k)
        hits.append(F.col(f"_s{k}") * factor)
    for k in range(1, len(codes) + 1):
        at_depth = F.when(F.col(f"_s{k}").isNotNull(), k).otherwise(at_depth)
    out = out.withColumn("score", F.coalesce(*hits, F.lit(default)))
    if depth:
        out = out.withColumn(depth, at_depth)
    return out.drop(*[f"_{x}{k}" for x in "ps" for k in range(1, len(codes) + 1)])


def config_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Full outer join of two (key, value) tables: rows whose values differ, nulls included."""
    joined = a.select("key", F.col("value").alias("value_a")).join(b.select("key", F.col("value").alias("value_b")), "key", "full")
    return joined.where(~F.col("value_a").eqNullSafe(F.col("value_b")))
