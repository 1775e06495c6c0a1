"""Cosines of all pairs inside a group, as counts by value, in blocks of vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import scratch
from . import relate

#: Vectors of one block; each pair of blocks is a task's work. Cosines are counted to so many decimals.
BLOCK, DECIMALS = 2048, 5
_OUT = "g bigint, bin int, n bigint, s double, q double, lo double, hi double, t double"


def _matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(ids, unit vectors) in the order of the ids."""
    ids = table.column("id").to_numpy()
    order = np.argsort(ids)
    x = np.array(table.column("v").to_pylist(), dtype=np.float64).reshape(len(ids), -1)[order]
    x = x / np.abs(x).max(axis=1, keepdims=True) if len(x) else x
    return ids[order], x / np.sqrt((x * x).sum(axis=1, keepdims=True)) if len(x) else x


def _count(key, left: pa.Table, right: pa.Table) -> pa.Table:
    """Rows with a bin count the pairs of two blocks; rows with t are the cosines of given pairs."""
    one, two = key[1].as_py(), key[2].as_py()
    block, scale = left.column("block").to_numpy(), 10**DECIMALS
    xi, x = _matrix(left.filter(pa.array(block == one)))
    yi, y = (xi, x) if one == two else _matrix(left.filter(pa.array(block == two)))
    t, a, b = (right.column(k).to_numpy() for k in ("t", "a", "b"))
    swap = right.column("swap").to_numpy(zero_copy_only=False).astype(bool)  # a given pair may have either block first
    px, py = np.searchsorted(xi, np.where(swap, b, a)), np.searchsorted(yi, np.where(swap, a, b))
    order = np.argsort(px, kind="stable")
    t, px, py = t[order], px[order], py[order]
    cosines = np.zeros(len(t))
    n, s, q, lo, hi = np.zeros(2 * scale + 3, np.int64), 0.0, 0.0, np.inf, -np.inf
    for i in range(0, len(x) if len(y) else 0, 256):
        c = x[i : i + 256] @ y.T
        k = slice(*np.searchsorted(px, [i, i + len(c)]))
        cosines[k] = c[px[k] - i, py[k]]  # the same numbers that are counted
        c = c[np.arange(i, i + len(c))[:, None] < np.arange(len(y))[None, :]] if one == two else c.ravel()
        if len(c):
            n += np.bincount(np.rint(c * scale).astype(np.int64) + scale + 1, minlength=len(n))
            s, q, lo, hi = s + c.sum(), q + (c * c).sum(), min(lo, c.min()), max(hi, c.max())
    at = np.flatnonzero(n)
    bins, counts, total = at - scale - 1, n[at], len(at)
    first = np.arange(total) == 0  # the sums stand in the first row
    m = len(t)
    pad = lambda v: pa.concat_arrays([pa.array(np.where(first, v, 0.0), mask=~first), pa.nulls(m, pa.float64())])
    return pa.table({
        "g": pa.array([key[0].as_py()] * (total + m), pa.int64()),
        "bin": pa.array(np.concatenate([bins, np.rint(cosines * scale)]).astype(np.int32)),
        "n": pa.concat_arrays([pa.array(counts), pa.nulls(m, pa.int64())]),
        "s": pad(s), "q": pad(q), "lo": pad(lo), "hi": pad(hi),
        "t": pa.concat_arrays([pa.nulls(total, pa.float64()), pa.array(t, pa.float64())]),
    })


def pair_cosines(vectors: DataFrame, given: DataFrame | None = None) -> DataFrame:
    """Of ``vectors`` (g, id, v), all pairs of ids of a group, kept.

    Rows (g, bin, n): n pairs have the cosine bin / 10**DECIMALS; some rows
    also hold the sum s, sum of squares q, least lo and most hi of the unrounded cosines.
    Rows (g, bin, t): the cosine of each pair of ``given`` (g, a, b, t).
    The work is quadratic in the vectors of a group, the rows are not.
    """
    k = vectors.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("k"))
    placed = vectors.join(k, "g").withColumn("block", F.pmod(F.xxhash64("id"), F.col("k")).cast("int"))
    left = placed.select("g", "block", "id", F.col("v").cast("array<double>").alias("v"), F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("other"))
    left = left.select("g", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "block", "id", "v")
    if given is None:
        given = vectors.sparkSession.createDataFrame([], "g bigint, a bigint, b bigint, t double")
    right = given.join(k, "g").withColumn("ba", F.pmod(F.xxhash64("a"), F.col("k")).cast("int")).withColumn("bb", F.pmod(F.xxhash64("b"), F.col("k")).cast("int"))
    right = right.select("g", F.least("ba", "bb").alias("one"), F.greatest("ba", "bb").alias("two"), "a", "b", "t", (F.col("ba") > F.col("bb")).alias("swap"))
    keys = ["g", "one", "two"]
    return scratch.keep(left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_count, _OUT), "pairs")


def cosine_distribution(vectors: DataFrame) -> DataFrame:
    """(g, pairs, mean, std, least, most, p5, p25, median, p75, p95) over all pairs of a group; median is the lower one, percentiles are at floor(pairs * p)."""
    found = pair_cosines(vectors)
    sums = found.groupBy("g").agg(F.sum("n").alias("pairs"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.min("lo").alias("least"), F.max("hi").alias("most"))
    bins = found.groupBy("g", "bin").agg(F.sum("n").alias("n"))
    bins = bins.withColumn("upto", F.sum("n").over(Window.partitionBy("g").orderBy("bin"))).join(sums.select("g", "pairs"), "g")
    at = lambda rank: F.min(F.when(F.col("upto") > rank, F.col("bin"))) / 10**DECIMALS
    shares = [at(F.floor(F.col("pairs") * p)).alias(f"p{round(p * 100)}") for p in (0.05, 0.25, 0.75, 0.95)]
    places = bins.groupBy("g").agg(*shares[:2], at(F.floor((F.col("pairs") - 1) / 2)).alias("median"), *shares[2:])
    mean, n = F.col("s") / F.col("pairs"), F.col("pairs")
    std = F.when(n > 1, F.sqrt(F.greatest(F.lit(0.0), (F.col("q") - F.col("s") * mean) / (n - 1))))
    return sums.select("g", "pairs", mean.alias("mean"), std.alias("std"), "least", "most").join(places, "g")


def embedding_behavior_corr(vectors: DataFrame, actions: DataFrame, least_users: int = 5, least_items: int = 100) -> DataFrame:
    """(items, pairs, co_pairs, spearman) of cosine and user-Jaccard over all pairs of items with enough users.

    ``vectors`` is (iid, v), ``actions`` (uid, iid). Pairs without a common
    user are not formed for the Jaccard: all have 0 and share one rank.
    Spearman is null with fewer than ``least_items`` items.
    """
    seen = actions.select("uid", "iid").dropna().distinct()
    often = seen.groupBy("iid").agg(F.count(F.lit(1)).alias("users")).where(F.col("users") >= least_users)
    items = scratch.keep(vectors.join(often, "iid", "left_semi").withColumn("id", F.monotonically_increasing_id()).withColumn("g", F.lit(0).cast("bigint")), "items")
    n_items = items.count()
    n = n_items * (n_items - 1) // 2
    if n_items < max(2, least_items):
        return items.sparkSession.createDataFrame([(n_items, n, None, None)], "items bigint, pairs bigint, co_pairs bigint, spearman double")
    jac = relate.jaccard(seen.join(items.select("iid", "id"), "iid").select("uid", "id"), "uid", "id")
    found = pair_cosines(items.select("g", "id", "v"), jac.select(F.lit(0).cast("bigint").alias("g"), F.col("item_a").alias("a"), F.col("item_b").alias("b"), F.col("jaccard").alias("t")))
    middle = (n + 1) / 2
    co = found.where("t IS NOT NULL")
    ta = co.groupBy("t").agg(F.count(F.lit(1)).alias("nt"))
    n_co = co.count()
    zero = n - n_co
    before = lambda c, by: F.sum(c).over(Window.orderBy(by)) - F.col(c)
    ra = found.where("n IS NOT NULL").groupBy("bin").agg(F.sum("n").alias("nb")).withColumn("ra", before("nb", "bin") + (F.col("nb") + 1) / 2 - middle)
    rt = ta.withColumn("rt", zero + before("nt", "t") + (F.col("nt") + 1) / 2 - middle)
    joined = co.select("bin", "t").groupBy("bin", "t").agg(F.count(F.lit(1)).alias("m")).join(ra, "bin").join(rt, "t")
    c = joined.agg(F.sum(F.col("m") * F.col("ra") * F.col("rt")).alias("c"), F.sum(F.col("m") * F.col("ra")).alias("a"))
    va, vt = ra.agg(F.sum(F.col("nb") * F.col("ra") ** 2).alias("va")), rt.agg(F.sum(F.col("nt") * F.col("rt") ** 2).alias("vt"))
    r0 = (zero + 1) / 2 - middle
    one = c.crossJoin(va).crossJoin(vt)
    cov = F.coalesce("c", F.lit(0.0)) - (F.coalesce("a", F.lit(0.0)) * r0 if zero else 0.0)
    both = F.col("va") * (F.coalesce("vt", F.lit(0.0)) + zero * r0 * r0)
    out = one.select(F.when(both > 0, cov / F.sqrt(both)).alias("spearman"))
    return out.select(F.lit(n_items).cast("bigint").alias("items"), F.lit(n).cast("bigint").alias("pairs"), F.lit(n_co).cast("bigint").alias("co_pairs"), "spearman")
