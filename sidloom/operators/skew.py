"""Per-key results where a few keys hold most rows.

Heavy keys are found with a frequent-items sketch (bounded memory, one pass).
Their rows are picked out by a broadcast join with the heavy-key list, which
has at most ``MAX_HEAVY`` rows whatever the input, and are aggregated in two
steps over salted keys. All other rows go through one ordinary shuffle. The
union of both is the whole result: the sketch only decides which way a key
takes, so a wrong estimate costs time and never changes a number.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from .. import scratch
from ..util import BLANKS, item_key

#: Bound of the broadcast heavy-key list.
MAX_HEAVY = 1024
#: Counters of the frequent-items sketch; its error is about 3.5 / TRACKED of all rows.
TRACKED = 16384


@dataclass(frozen=True)
class Measure:
    """An aggregate that can be computed per (key, salt) and then merged.

    ``partial`` is evaluated once per key and salt, ``merge`` combines the
    salts' results. A distinct count merges by sum if the salt is a function of
    the counted value (see ``salt_by``).
    """

    name: str
    partial: Column
    merge: Callable[[Column], Column]


def heavy_hitters(rows: DataFrame, key: Column, share: float) -> tuple[int, list[Row]]:
    """(number of rows, keys that hold about ``share`` of them or more).

    At most ``MAX_HEAVY`` keys come back to the driver. Null keys are not
    considered.
    """
    got = (
        rows.select(key.alias("k"))
        .where("k IS NOT NULL")
        .agg(F.count(F.lit(1)).alias("n"), F.expr(f"approx_top_k(k, {MAX_HEAVY}, {TRACKED})").alias("top"))
        .first()
    )
    n, top = got["n"], got["top"] or []
    return n, [r["item"] for r in top if r["count"] >= share * n]


def skew_aggregate(
    rows: DataFrame,
    keys: list[str],
    measures: list[Measure],
    salt_by: Column,
    share: float = 0.01,
    salts: int = 64,
) -> DataFrame:
    """``groupBy(keys)`` with the given measures, balanced for any key skew.

    ``salt_by`` spreads the rows of a heavy key over ``salts`` buckets.
    Columns of the result: ``keys`` and the measures' names; columns of
    ``rows`` that are named alike don't matter, since only ``keys``, the
    measures' inputs and ``salt_by`` are read. Rows with a null in ``keys``
    form groups of their own, as in ``groupBy``. An empty input gives an empty
    result. ``rows`` is scanned three times; hand in a kept table. Keys are
    known by their hash: a key that collides with a heavy one goes its way, and
    is grouped by its own columns there.
    """
    spark = rows.sparkSession
    key = F.xxhash64(*keys)
    n, heavy = heavy_hitters(rows, key, share)
    if not heavy:
        return rows.groupBy(*keys).agg(*[m.partial.alias(m.name) for m in measures])
    tagged = rows.withColumn("_key", key)
    listed = F.broadcast(spark.createDataFrame([(h,) for h in heavy], "_key bigint"))
    light = tagged.join(listed, "_key", "left_anti").groupBy(*keys).agg(*[m.partial.alias(m.name) for m in measures])
    salted = (
        tagged.join(listed, "_key", "left_semi")
        .withColumn("_salt", F.pmod(F.xxhash64(salt_by), F.lit(salts)))
        .groupBy(*keys, "_salt")
        .agg(*[m.partial.alias(m.name) for m in measures])
    )
    merged = salted.groupBy(*keys).agg(*[m.merge(F.col(m.name)).alias(m.name) for m in measures])
    return merged.unionByName(light)


def skew_join(left: DataFrame, right: DataFrame, key: str, share: float = 0.01, how: str = "inner", few: int = MAX_HEAVY * 64, salts: int = 32) -> DataFrame:
    """Equi-join of two tables on ``key`` where a few keys hold most of ``left``.

    The right rows of heavy keys are broadcast if they are at most ``few``
    (counted first); if they are more, the left rows are dealt to ``salts`` and
    each salt gets its copy of them. All other keys go through an ordinary
    shuffle join. ``how`` is ``inner`` or
    ``left``. Null keys match nothing.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"how={how!r}")
    spark = left.sparkSession
    _, heavy = heavy_hitters(left, F.col(key), share)
    if not heavy:
        return left.join(right, key, how)
    kind = left.schema[key].dataType.simpleString()
    listed = F.broadcast(spark.createDataFrame([(h,) for h in heavy], f"`{key}` {kind}"))
    hot, mine = right.join(listed, key, "left_semi"), left.join(listed, key, "left_semi")
    if hot.limit(few + 1).count() <= few:
        first = mine.join(F.broadcast(hot), key, how)
    else:
        salted = mine.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int"))
        copies = hot.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        first = salted.join(copies, [key, "_salt"], how).drop("_salt")
    rest = left.join(listed, key, "left_anti").join(right.join(listed, key, "left_anti"), key, how)
    return first.unionByName(rest)


def parse_sid(sid: Column) -> Column:
    """The three codes of a valid sid as struct(a, b, c); null for any other string."""
    code = f"[{BLANKS}]*[0-9]+[{BLANKS}]*"
    parts = F.split(F.when(sid.rlike(f"^{code}_{code}_{code}$"), sid), "_")
    nums = [F.ltrim(F.btrim(F.get(parts, F.lit(i)), F.lit(BLANKS)), F.lit("0")) for i in range(3)]
    nums = [F.when(F.length(n) <= 3, F.when(n == "", F.lit(0)).otherwise(n.cast("int"))) for n in nums]
    valid = (nums[0] <= 255) & (nums[1] <= 255) & (nums[2] <= 255)
    return F.when(valid, F.struct(*[n.alias(x) for n, x in zip(nums, "abc")]))


def latest_sids(sid_map: DataFrame) -> DataFrame:
    """One row per item: content_id, a, b, c of its latest valid assignment.

    A null or blank content_id is no item. A null assigned_at is older than any
    other. Of two valid rows with the same time the larger code triple counts.
    """
    return (
        sid_map.select(item_key("content_id").alias("content_id"), F.struct("assigned_at", parse_sid(F.col("sid")).alias("s")).alias("v"))
        .where("content_id <> '' AND v.s IS NOT NULL")
        .groupBy("content_id")
        .agg(F.max("v").alias("v"))
        .select("content_id", "v.s.a", "v.s.b", "v.s.c")
    )


def prefix_stats(items: DataFrame, share: float = 0.01) -> DataFrame:
    """Bucket sizes of every SID prefix: depth, prefix, n_items, n_sids, first_item, n_total.

    ``items`` has content_id, a, b, c, one row per item (``latest_sids``).
    n_items counts items below the prefix, n_sids the different full SIDs
    below it, first_item is the smallest content_id, n_total the number of all
    items. An empty input gives no row.
    """
    kept = scratch.keep(items.select("content_id", "a", "b", "c"), "sid-items")
    least = Measure("first_item", F.min("content_id"), F.min)
    whole = skew_aggregate(kept, ["a", "b", "c"], [Measure("n_items", F.count(F.lit(1)), F.sum), least], salt_by=F.col("content_id"), share=share)
    sids = scratch.keep(whole, "sids")  # a row for each SID in use: 256 ** 3 at most
    levels = F.array(
        F.struct(F.lit(1).alias("depth"), F.concat_ws("_", "a").alias("prefix")),
        F.struct(F.lit(2).alias("depth"), F.concat_ws("_", "a", "b").alias("prefix")),
        F.struct(F.lit(3).alias("depth"), F.concat_ws("_", "a", "b", "c").alias("prefix")),
    )
    rows = sids.select("n_items", "first_item", F.xxhash64("a", "b", "c").alias("sid"), F.explode(levels).alias("p")).select("n_items", "first_item", "sid", "p.depth", "p.prefix")
    stats = skew_aggregate(
        rows,
        ["depth", "prefix"],
        [Measure("n_items", F.sum("n_items"), F.sum), Measure("n_sids", F.count(F.lit(1)), F.sum), Measure("first_item", F.min("first_item"), F.min)],
        salt_by=F.col("sid"),
        share=share,
    )
    total = kept.agg(F.count(F.lit(1)).alias("n_total"))
    return stats.join(F.broadcast(total), F.lit(True), "inner").select("depth", "prefix", "n_items", "n_sids", "first_item", "n_total")
