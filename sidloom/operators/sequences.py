"""Ordered user histories: filtering, splitting, sequences with side features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import scratch
from ..functions.bits import level, masked
from ..functions.scalars import time_bucket

LAYERS, MAX_ITEMS = 3, 170


def ordered(df: DataFrame, user: str, by: list[str]) -> DataFrame:
    """With rn and n: place in the user's history and its length. ``by`` ends in a tiebreak."""
    w = Window.partitionBy(user)
    return df.withColumn("rn", F.row_number().over(w.orderBy(*by))).withColumn("n", F.count(F.lit(1)).over(w))


def filter_ratings(df: DataFrame, least: int, min_items: int, max_users: int | None = None) -> DataFrame:
    """Ratings of at least ``least``, without runs of one item, of users with ``min_items`` left; of these the first ``max_users`` by uid."""
    w = Window.partitionBy("uid").orderBy("ts", "okey", "lno", "mid")
    kept = df.where(F.col("rating") >= least).withColumn("prev", F.lag("mid").over(w)).where("prev IS NULL OR prev <> mid")
    kept = kept.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("uid"))).where(F.col("n") >= min_items).drop("prev", "n")
    return kept if max_users is None else kept.join(kept.select("uid").distinct().orderBy("uid").limit(max_users), "uid", "left_semi")


def train_prefixes_without_target(df: DataFrame, user: str, item: str) -> DataFrame:
    """Prefixes of a history (by their last item) that don't end in the held-out last item."""
    last = df.where("rn = n").select(user, F.col(item).alias("target"))
    return df.where("rn < n").join(last, user).where(F.col(item) != F.col("target"))


def split_time(df: DataFrame, at: str, n_eval: int) -> Column:
    """The time at position total - n_eval of all times in order, found by counts per time.

    One pass counts each day; a second counts the times of the one day that is
    asked for. The row that comes out is put into the plan as a constant.
    """
    daily = df.groupBy(F.floor(F.col(at) / 86400).alias("d")).agg(F.count(F.lit(1)).alias("c"))
    days = daily.orderBy("d").collect()  # a row for each day
    total = sum(r["c"] for r in days)
    if not total:
        return F.lit(None).cast("bigint")
    left = min(max(total - n_eval, 0), total - 1)
    for r in days:
        if left < r["c"]:
            break
        left -= r["c"]
    inside = df.where(F.floor(F.col(at) / 86400) == r["d"]).groupBy(at).agg(F.count(F.lit(1)).alias("c")).withColumn("upto", F.sum("c").over(Window.orderBy(at)))  # 86400 rows at most
    return F.lit(inside.where(F.col("upto") > left).orderBy(at).first()[at])


def build_sequences(positives: DataFrame, sids: DataFrame, split: Column, max_items: int = MAX_ITEMS, side: str = "right", extra: str | None = None) -> DataFrame:
    """One row per user: uid, tokens, split_pos, eval_cids, time_gaps, action_levels, timestamps, span[, extra].

    ``positives`` has uid, iid, first_ts, level[, tie][, extra]; items without
    a SID leave first, then users with fewer than two, then all but the last
    ``max_items`` of a user. Gaps, hours and span (seconds from first to last)
    are taken after that. Equal times go by iid, then tie. ``extra`` names an
    array column whose values of all items are put one after another.
    """
    known = positives.join(sids.select(F.col("content_id").alias("iid"), F.array("a", "b", "c").alias("tokens")), "iid")
    place = ["first_ts", "iid", *(["tie"] if "tie" in positives.columns else [])]
    w = Window.partitionBy("uid")
    kept = (
        known.withColumn("back", F.row_number().over(w.orderBy(*[F.desc(c) for c in place])))
        .withColumn("n", F.count(F.lit(1)).over(w))
        .where((F.col("n") >= 2) & (F.col("back") <= max_items))
    )
    more = [extra] if extra else []
    users = kept.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct(*place, "tokens", "level", *more))).alias("items"))
    first = F.element_at("items", 1)["first_ts"]
    gaps = F.transform(
        F.zip_with("items", F.slice(F.concat(F.slice("items", 1, 1), F.col("items")), F.lit(1), F.size("items")), lambda x, y: x["first_ts"] - y["first_ts"]),
        lambda g, i: F.when(i == 0, 0).otherwise(time_bucket(g, side)),
    )
    spread = lambda c, f: F.flatten(F.transform(c, lambda x: F.array_repeat(f(x), LAYERS)))
    return users.select(
        "uid",
        F.flatten(F.transform("items", lambda x: x["tokens"])).alias("tokens"),
        (F.size(F.filter("items", lambda x: x["first_ts"] <= split)) * LAYERS).cast("int").alias("split_pos"),
        F.transform(F.filter("items", lambda x: x["first_ts"] > split), lambda x: x["iid"]).alias("eval_cids"),
        spread(gaps, lambda g: g).alias("time_gaps"),
        spread("items", lambda x: x["level"]).alias("action_levels"),
        spread("items", lambda x: ((x["first_ts"] - first) / 3600).cast("float")).alias("timestamps"),
        (F.element_at("items", -1)["first_ts"] - first).alias("span"),
        *[F.flatten(F.transform("items", lambda x: x[e])).alias(e) for e in more],
    )


def dispatch(sids: DataFrame, behavior: DataFrame | None = None, exposure: DataFrame | None = None, b2: DataFrame | None = None, n_eval: int = 50_000, max_items: int = MAX_ITEMS, k: int = 5) -> DataFrame:
    """Sequences from the richest source given: session behavior, then rows with their negatives inline, then plain behavior.

    ``b2`` is session-grain behavior (action_bitmap 0 is an exposure),
    ``exposure`` has uid, iid, first_ts, neg_iids, ``behavior`` uid, iid,
    first_ts, action_bitmap. No source is an error.
    """
    if b2 is not None:
        pos = session_negatives(b2.where((F.col("action_bitmap") == 0) | (masked(F.col("action_bitmap")) > 0)), sids, k).withColumn("level", level(F.col("action_bitmap"))).withColumnRenamed("session_id", "tie")
    elif exposure is not None:
        pos = inline_negatives(exposure, sids, k).withColumn("level", F.lit(1))
    elif behavior is not None:
        pos = behavior.where(masked(F.col("action_bitmap")) > 0).select("uid", "iid", "first_ts", level(F.col("action_bitmap")).alias("level"))
    else:
        raise ValueError("one of behavior, exposure and b2 is needed")
    kept = scratch.keep(pos.join(sids.select(F.col("content_id").alias("iid")), "iid", "left_semi"), "positives")
    return build_sequences(kept, sids, split_time(kept, "first_ts", n_eval), max_items, extra="neg_l0" if "neg_l0" in pos.columns else None)


def inline_negatives(exposure: DataFrame, sids: DataFrame, k: int = 5) -> DataFrame:
    """``exposure`` with neg_l0: the first codes of the first k known items of neg_iids, padded with -1; an item is not left out of its own."""
    rows = exposure.withColumn("_row", F.struct("uid", "iid", "first_ts", F.monotonically_increasing_id().alias("n")))
    one = rows.select("_row", F.posexplode("neg_iids").alias("pos", "neg")).join(sids.select(F.col("content_id").alias("neg"), "a"), "neg")
    negs = one.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("pos", "a"))).alias("x"))
    own = F.slice(F.transform(F.coalesce("x", F.array().cast("array<struct<pos:int,a:int>>")), lambda x: x["a"]), 1, k)
    return rows.join(negs, "_row", "left").select("uid", "iid", "first_ts", F.concat(own, F.array_repeat(F.lit(-1), F.lit(k) - F.size(own))).alias("neg_l0"))


def session_negatives(b2: DataFrame, sids: DataFrame, k: int = 5) -> DataFrame:
    """Positives with up to k first SID tokens of items exposed in the same session, padded with -1.

    Negatives go by iid; the positive's own item is none. Sessions are short on
    the whole; a long one costs one array on its own rows only.
    """
    known = sids.select(F.col("content_id").alias("iid"), "a")
    neg = b2.where("action_bitmap = 0").join(known, "iid").groupBy("uid", "session_id").agg(F.array_sort(F.collect_set(F.struct("iid", "a"))).alias("neg"))
    pos = b2.where("action_bitmap > 0").join(known.select("iid"), "iid", "left_semi").join(neg, ["uid", "session_id"], "left")
    own = F.slice(F.transform(F.filter(F.coalesce("neg", F.array().cast("array<struct<iid:string,a:int>>")), lambda x: x["iid"] != F.col("iid")), lambda x: x["a"]), 1, k)
    return pos.select("uid", "session_id", "iid", "first_ts", "last_ts", "event_cnt", "action_bitmap", F.concat(own, F.array_repeat(F.lit(-1), F.lit(k) - F.size(own))).alias("neg_l0"))
