"""Loss arithmetic over tables of candidate log-probabilities and rewards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rank_norm(group: str, reward: str, pos: str) -> Column:
    """Ordinal rank in the group, scaled to -1..1; ties by position; 0 for a group of one."""
    w = Window.partitionBy(group)
    n = F.count(F.lit(1)).over(w)
    return F.when(n > 1, 2.0 * (F.row_number().over(w.orderBy(reward, pos)) - 1) / (n - 1) - 1).otherwise(0.0)


def zscore(group: str, reward: str) -> Column:
    """(r - mean) / sample deviation, within -5..5; null where the group hardly varies."""
    w = Window.partitionBy(group)
    sd = F.stddev_samp(reward).over(w)
    return F.when(sd >= 1e-6, F.greatest(F.lit(-5.0), F.least(F.lit(5.0), (F.col(reward) - F.avg(reward).over(w)) / sd)))


def softmax_dpo(rows: DataFrame, beta: float) -> DataFrame:
    """(g, loss, chosen_reward, rejected_reward, win, kl_sum, n) per group of (g, chosen, policy_lp, ref_lp).

    loss is -log sigmoid(-logsumexp(beta * (rejected - chosen))) of the log
    ratios; rewards are the log ratio of the chosen and the mean one of the
    rejected; win says that the chosen beats every rejected; kl_sum adds up
    all log ratios of the group. Groups without a rejected row have no loss.
    """
    lr = rows.withColumn("lr", F.col("policy_lp") - F.col("ref_lp"))
    g = lr.groupBy("g").agg(F.max(F.when(F.col("chosen"), F.col("lr"))).alias("c"), F.collect_list(F.when(~F.col("chosen"), F.col("lr"))).alias("xs"), F.sum("lr").alias("kl_sum"), F.count(F.lit(1)).alias("n"))
    g = g.withColumn("d", F.transform("xs", lambda x: beta * (x - F.col("c")))).withColumn("m", F.array_max("d"))
    lse = F.col("m") + F.log(F.aggregate("d", F.lit(0.0), lambda a, v: a + F.exp(v - F.col("m"))))
    mean = F.aggregate("xs", F.lit(0.0), lambda a, v: a + v) / F.size("xs")
    some = F.size("xs") > 0
    loss = F.when(lse > 0, lse + F.log1p(F.exp(-lse))).otherwise(F.log1p(F.exp(lse)))  # no overflow
    return g.select("g", F.when(some, loss).alias("loss"), F.when(some, F.col("c")).alias("chosen_reward"), F.when(some, mean).alias("rejected_reward"), F.when(some, F.col("c") > F.array_max("xs")).alias("win"), "kl_sum", "n")


def dpo_diagnostics(groups: DataFrame) -> DataFrame:
    """One row: mean loss, rewards and their margin, share of wins, mean log ratio of all rows."""
    return groups.agg(
        F.avg("loss").alias("loss"), F.avg("chosen_reward").alias("chosen_reward"), F.avg("rejected_reward").alias("rejected_reward"), F.avg(F.col("chosen_reward") - F.col("rejected_reward")).alias("reward_margin"),
        F.avg(F.col("win").cast("double")).alias("preference_acc"), (F.sum("kl_sum") / F.sum("n")).alias("kl"), F.count("loss").alias("groups"),
    )


def semantic_gate(group: str, reward: str, pos: str, codes: list[str]) -> Column:
    """Leading codes shared with the group's best row (highest reward, then first), as a part of all codes; 0 for the best itself."""
    w = Window.partitionBy(group)
    best = F.min_by(F.struct(pos, *codes), F.struct(-F.col(reward), F.col(pos))).over(w)
    shared = F.lit(0)
    for k in range(len(codes), 0, -1):
        same = F.lit(True)
        for c in codes[:k]:
            same = same & (F.col(c) == best[c])
        shared = F.when(same & (shared == 0), F.lit(k)).otherwise(shared)
    return F.when(F.col(pos) == best[pos], 0.0).otherwise(shared / len(codes))


def grpo(rows: DataFrame, eps: float = 0.2, delta: float = 0.0, alpha: float = 0.0, codes: list[str] | None = None) -> DataFrame:
    """(g, pos, advantage, loss): clipped ratio objective of each candidate.

    The log ratio is kept within -10..10. delta > 0 cuts the ratio of
    candidates with a negative advantage early, at 1 + eps + delta. With alpha
    and ``codes`` a negative advantage grows by alpha times the candidate's
    ``semantic_gate``.
    """
    a = rows.withColumn("advantage", zscore("g", "reward"))
    if codes:
        a = a.withColumn("gate", semantic_gate("g", "reward", "pos", codes))
        a = a.withColumn("advantage", F.when(F.col("advantage") < 0, F.col("advantage") * (1 + alpha * F.col("gate"))).otherwise(F.col("advantage")))
    a = a.where("advantage IS NOT NULL")
    ratio = F.exp(F.greatest(F.lit(-10.0), F.least(F.lit(10.0), F.col("policy_lp") - F.col("ref_lp"))))
    if delta:
        ratio = F.when(F.col("advantage") < 0, F.least(ratio, F.lit(1 + eps + delta))).otherwise(ratio)
    clipped = F.least(F.greatest(ratio, F.lit(1 - eps)), F.lit(1 + eps))
    return a.withColumn("loss", -F.least(ratio * F.col("advantage"), clipped * F.col("advantage"))).select("g", "pos", *(["gate"] if codes else []), "advantage", "loss")
