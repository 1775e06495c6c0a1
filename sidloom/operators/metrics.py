"""Health of Semantic IDs and their agreement with behavior, each as a tidy table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .relate import all_user_pairs

CODES = ["a", "b", "c"]


def prefix_counts(sids: DataFrame) -> DataFrame:
    """(depth, prefix, n) of every prefix, from the counts of full SIDs."""
    full = sids.groupBy(*CODES).agg(F.count(F.lit(1)).alias("n"))
    levels = F.array(*[F.struct(F.lit(k).alias("depth"), F.concat_ws("_", *CODES[:k]).alias("prefix")) for k in (1, 2, 3)])
    return full.select("n", F.explode(levels).alias("p")).groupBy("p.depth", "p.prefix").agg(F.sum("n").alias("n"))


def collision(sids: DataFrame) -> DataFrame:
    """conflict_rate (SIDs with several items), exclusivity, items that share, and 1 - unique / items."""
    n = F.col("n")
    g = sids.groupBy(*CODES).agg(F.count(F.lit(1)).alias("n"))
    return g.agg(
        (F.count_if(n > 1) / F.count(F.lit(1))).alias("conflict_rate"),
        (F.count_if(n == 1) / F.sum("n")).alias("exclusivity"),
        F.sum(F.when(n > 1, n).otherwise(0)).alias("collided"),
        (1 - F.count(F.lit(1)) / F.sum("n")).alias("collision_rate"),
    )


def collision_depth(sids: DataFrame) -> DataFrame:
    n = F.col("n")
    return prefix_counts(sids).groupBy("depth").agg(
        F.count(F.lit(1)).alias("unique_prefixes"),
        (1 - F.count(F.lit(1)) / F.sum("n")).alias("collision_rate"),
        (F.count_if(n > 1) / F.count(F.lit(1))).alias("conflict_rate"),
        F.avg("n").alias("mean"),
        F.min("n").alias("least"),
        F.max("n").alias("most"),
        *[F.percentile("n", p / 100).cast("bigint").alias(f"p{p}") for p in (50, 90, 99)],
        *[F.count_if(n <= k).alias(f"le_{k}") for k in (1, 2, 5, 10, 50, 100, 500)],
    )


def codebook_utilization(sids: DataFrame) -> DataFrame:
    """(depth, unique_prefixes, capacity, utilization); capacity is the product of the codebook sizes in use."""
    sizes = sids.agg(*[(F.max(c) + 1).cast("bigint").alias(f"s{i}") for i, c in enumerate(CODES, 1)])
    cap = F.when(F.col("depth") == 1, F.col("s1")).when(F.col("depth") == 2, F.col("s1") * F.col("s2")).otherwise(F.col("s1") * F.col("s2") * F.col("s3"))
    u = prefix_counts(sids).groupBy("depth").agg(F.count(F.lit(1)).alias("unique_prefixes"))
    return u.join(F.broadcast(sizes), F.lit(True)).select("depth", "unique_prefixes", cap.alias("capacity"), (F.col("unique_prefixes") / cap).alias("utilization"))


def entropy(sids: DataFrame) -> DataFrame:
    """(depth, bits): Shannon entropy of the prefixes at each depth."""
    c = prefix_counts(sids)
    total = sids.agg(F.count(F.lit(1)).alias("t"))
    p = F.col("n") / F.col("t")
    return c.join(F.broadcast(total), F.lit(True)).groupBy("depth").agg((-F.sum(p * F.log2(p))).alias("bits"), F.first("t").alias("n_total"))


def gini(sids: DataFrame) -> DataFrame:
    """(depth, gini, cv, least, most) of bucket counts of used prefixes.

    Ranks are over counts of counts: as many rows as there are different bucket
    sizes, so the ordered window is small at any number of prefixes.
    """
    sizes = prefix_counts(sids).groupBy("depth", "n").agg(F.count(F.lit(1)).alias("k"))
    w = Window.partitionBy("depth").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    ranked = sizes.withColumn("before", F.coalesce(F.sum("k").over(w), F.lit(0)))
    # the sum of ranks before+1 .. before+k, times n
    weight = F.col("n") * (F.col("k") * F.col("before") + F.col("k") * (F.col("k") + 1) / 2)
    g = ranked.groupBy("depth").agg(F.sum(weight).alias("w"), F.sum(F.col("n") * F.col("k")).alias("s"), F.sum("k").alias("m"), F.sum(F.col("n") * F.col("n") * F.col("k")).alias("q"), F.min("n").alias("least"), F.max("n").alias("most"))
    m, s = F.col("m"), F.col("s")
    var = (F.col("q") - s * s / m) / F.nullif(m - 1, F.lit(0))
    return g.select("depth", (2 * F.col("w") / (m * s) - (m + 1) / m).alias("gini"), (F.sqrt(var) / (s / m)).alias("cv"), "least", "most")


def neighbor_hit_rate(positives: DataFrame, sids: DataFrame, codes: list[str] | None = None) -> DataFrame:
    """(hit_rate, spread, coverage, items): for items with two users or more, the share of items
    with the same prefix that share a user.

    ``positives`` has uid, iid. Co-user pairs are formed inside a user and
    prefix only, in chunks where a user has many; the number of prefix
    neighbours is a count, no pairs at all.
    """
    codes = codes or ["a", "b"]
    known = positives.select("uid", "iid").distinct().join(sids.select(F.col("content_id").alias("iid"), *codes), "iid")
    users = known.groupBy("iid", *codes).agg(F.count(F.lit(1)).alias("users"))
    prefix = users.groupBy(*codes).agg(F.count(F.lit(1)).alias("size"))
    pairs = all_user_pairs(known.select(F.struct("uid", *codes).alias("u"), "iid"), "u", "iid").distinct()
    hits = pairs.select(F.explode(F.array("item_a", "item_b")).alias("iid")).groupBy("iid").agg(F.count(F.lit(1)).alias("hits"))
    scored = users.where("users >= 2").join(prefix, codes).join(hits, "iid", "left").withColumn("others", F.col("size") - 1)
    rate = F.when(F.col("others") > 0, F.coalesce("hits", F.lit(0)) / F.col("others"))
    return scored.agg(F.avg(rate).alias("hit_rate"), F.stddev_pop(rate).alias("spread"), (F.count_if(F.col("others") > 0) / F.count(F.lit(1))).alias("coverage"), F.count(F.lit(1)).alias("items"))


def user_consistency(positives: DataFrame, sids: DataFrame) -> DataFrame:
    """(users, observed, baseline, lift): mean pairwise token overlap within a user against all pairs of items.

    Overlap of a layer among n items is the share of pairs with equal codes,
    sum m(m-1) / n(n-1) over the counts m of each code: no pair is formed.
    """

    def overlap(df: DataFrame, group: list[str]) -> DataFrame:
        long = df.select(*group, F.posexplode(F.array(*CODES)))
        m = long.groupBy(*group, "pos", "col").agg(F.count(F.lit(1)).alias("m"))
        per = m.groupBy(*group).agg(F.sum(F.col("m") * (F.col("m") - 1)).alias("same"), (F.sum("m") / len(CODES)).alias("n"))
        return per.where("n >= 2").select(*group, (F.col("same") / (F.col("n") * (F.col("n") - 1) * len(CODES))).alias("o"))

    known = positives.select("uid", "iid").distinct().join(sids.select(F.col("content_id").alias("iid"), *CODES), "iid")
    observed = overlap(known, ["uid"]).agg(F.count(F.lit(1)).alias("users"), F.avg("o").alias("observed"))
    base = overlap(known.select("iid", *CODES).distinct().withColumn("all", F.lit(1)), ["all"]).agg(F.first("o").alias("baseline"))
    return observed.join(F.broadcast(base), F.lit(True)).withColumn("lift", F.col("observed") / F.nullif("baseline", F.lit(0.0)))


def pos_neg_separation(rows: DataFrame) -> DataFrame:
    """Mean over users of (negdist - posdist) / negdist; rows have uid, pos (boolean), v (unit vector).

    The mean similarity of a user's positives, the diagonal included, is the
    squared length of their mean vector, so only sums by dimension are needed.
    """
    x = rows.select("uid", "pos", F.posexplode("v").alias("i", "x"))
    s = x.groupBy("uid", "i").agg(F.avg(F.when(F.col("pos"), F.col("x"))).alias("p"), F.avg(F.when(~F.col("pos"), F.col("x"))).alias("q"))
    sims = s.groupBy("uid").agg(F.sum(F.col("p") * F.col("p")).alias("pp"), F.sum(F.col("p") * F.col("q")).alias("pq"))
    enough = rows.groupBy("uid").agg(F.count_if("pos").alias("np"), F.count_if(~F.col("pos")).alias("nn")).where("np >= 2 AND nn >= 2")
    d = sims.join(enough, "uid").withColumn("sep", ((1 - F.col("pq")) - (1 - F.col("pp"))) / F.nullif(1 - F.col("pq"), F.lit(0.0)))
    return d.agg(F.count(F.lit(1)).alias("users"), F.avg("sep").alias("separation"), F.stddev_pop("sep").alias("spread"))


def average_rank(value: str, group: str | None = None):
    """Average rank of ties, from the counts of equal values."""
    w = Window.partitionBy(group) if group else Window.partitionBy()
    return F.rank().over(w.orderBy(value)) + (F.count(F.lit(1)).over(w.partitionBy(*([group] if group else []), value)) - 1) / 2.0
