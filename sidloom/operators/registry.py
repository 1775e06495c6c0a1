"""Experiment registry and report analytics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def similar_configs(configs: DataFrame, run: str, top: int) -> DataFrame:
    """(run, n_diffs): the other runs with the fewest differing keys."""
    keys = configs.select("key").distinct()
    own = keys.join(configs.where(F.col("run") == run).select("key", F.col("value").alias("own")), "key", "left")
    others = configs.where(F.col("run") != run)
    matched = others.join(own, "key").groupBy("run").agg(F.count_if(~F.col("value").eqNullSafe(F.col("own"))).alias("changed"), F.count_if(F.col("own").isNotNull()).alias("shared"))
    total = own.agg(F.count("own").alias("n_own"))
    diffs = matched.join(F.broadcast(total), F.lit(True)).select("run", (F.col("changed") + F.col("n_own") - F.col("shared")).alias("n_diffs"))
    return diffs.orderBy("n_diffs", "run").limit(top)


def degradation(runs: DataFrame, name: str, baseline: str, metrics: list[str]) -> DataFrame:
    """Percent change of each metric against the baseline run; null if that is 0, null or missing."""
    base = runs.where(F.col(name) == baseline).agg(*[F.first(m).alias(f"_{m}") for m in metrics])
    out = runs.join(F.broadcast(base), F.lit(True))
    return out.select(name, *metrics, *[(100.0 * (F.col(m) - F.col(f"_{m}")) / F.nullif(F.col(f"_{m}"), F.lit(0.0))).alias(f"{m}_delta") for m in metrics])


def interpolate(at: DataFrame, points: list[tuple[float, float]]) -> DataFrame:
    """(v, y): piecewise linear between the points, in proportion to the nearest point beyond them."""
    pts, v = sorted(points), F.col("v")
    y = F.when(v < pts[0][0], v * (pts[0][1] / pts[0][0]))
    for (x0, y0), (x1, y1) in zip(pts, pts[1:]):
        y = y.when(v <= x1, F.lit(y0) + (y1 - y0) * (v - x0) / (x1 - x0))
    return at.select("v", y.otherwise(F.lit(pts[-1][1]) * v / pts[-1][0]).alias("y"))


def power_law(points: DataFrame, steps: int = 100) -> DataFrame:
    """(alpha, a, b) of the least-squares fit l = a + b / n^alpha: a grid over alpha, a closed form for a and b."""
    grid = points.withColumn("alpha", F.explode(F.transform(F.sequence(F.lit(5), F.lit(steps)), lambda i: i / 100.0))).withColumn("x", F.pow("n", -F.col("alpha")))
    fits = grid.groupBy("alpha").agg(F.regr_intercept("l", "x").alias("a"), F.regr_slope("l", "x").alias("b"), (F.regr_syy("l", "x") - F.pow(F.regr_sxy("l", "x"), 2) / F.regr_sxx("l", "x")).alias("sse"))
    return fits.orderBy("sse", "alpha").limit(1)


def schema_profile(df: DataFrame) -> DataFrame:
    """(name, type, n, sample): a row per column, from one pass."""
    counts = df.agg(*[F.struct(F.count(c).alias("n"), F.min(F.col(c).cast("string")).alias("sample")).alias(c) for c in df.columns])
    rows = F.array(*[F.struct(F.lit(c).alias("name"), F.lit(t).alias("type"), F.col(c)["n"].alias("n"), F.col(c)["sample"].alias("sample")) for c, t in df.dtypes])
    return counts.select(F.inline(rows))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new``, and the rows of ``old`` whose keys are not in it."""
    return new.unionByName(old.join(new.select(*keys), keys, "left_anti"))
