"""Items that appear together, by the stripes method.

Every item of a basket carries a stripe: the array of its neighbours in the
basket. Stripes are added up inside each task before anything is shuffled
(in-mapper combining), then the arrays are merged by item. Counts of pairs are
set against chance (lift) and tested with Dunning's log-likelihood ratio.

Of the two items of a pair, the one in fewer baskets (by powers of two) is the
key, so the stripe of a frequent item only holds items as frequent and the
most frequent item is the key of next to nothing. The stripe of an item in many
baskets is cut into parts by a hash of the neighbour.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import scratch
from ..util import item_key

#: Items of one basket that one task pairs with one another; a larger basket is
#: cut into chunks of about this size and each pair of chunks is a row of its own.
CHUNK = 512
#: Pairs that a task gathers before it adds them up.
BUFFER = 2_000_000
#: Share of the baskets from which an item is joined by broadcast; the list has at most (items of a mean basket) / HOT rows.
HOT = 0.01
#: An item in 2**b baskets has 2**(b - WHOLE) parts of its stripe, one at least.
WHOLE = 16
#: Bits of an item's number below the power of two of its baskets.
_LOW = 57

_STRIPE = pa.schema([("item_a", pa.int64()), ("part", pa.int32()), ("nbrs", pa.list_(pa.int64())), ("cnts", pa.list_(pa.int64()))])


def _rows(a: np.ndarray, part: np.ndarray, b: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """Stripes of triples in the order of (a, part)."""
    first = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (part[1:] != part[:-1])])
    offsets = pa.array(np.r_[first, len(a)].astype(np.int32))
    return pa.RecordBatch.from_arrays([pa.array(a[first]), pa.array(part[first]), pa.ListArray.from_arrays(offsets, pa.array(b)), pa.ListArray.from_arrays(offsets, pa.array(n))], schema=_STRIPE)


def _parts(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The part of a's stripe that b is in."""
    bits = np.clip((a >> _LOW) - WHOLE, 0, 30).astype(np.uint64)
    mixed = (b.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
    return (mixed & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int32)


def _sum(a: np.ndarray, part: np.ndarray, b: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Equal (a, part, b) added up, in that order."""
    order = np.lexsort((b, part, a))
    a, part, b, n = a[order], part[order], b[order], n[order]
    new = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.zeros(0, np.int64)
    return a[new], part[new], b[new], np.add.reduceat(n, new) if len(new) else n


def _pairs(left: np.ndarray, right: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs inside ``left``, or between two disjoint chunks of one basket; smaller number first."""
    if right is None:
        i, j = np.triu_indices(len(left), 1)
        a, b = left[i], left[j]
    else:
        a, b = np.repeat(left, len(right)), np.tile(right, len(left))
    return np.minimum(a, b), np.maximum(a, b)


def _stripes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (xs, ys) of basket chunks to stripes, added up over many baskets."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def flush() -> pa.RecordBatch:
        a = np.concatenate([x for x, _ in held])
        b = np.concatenate([x for _, x in held])
        return _rows(*_sum(a, _parts(a, b), b, np.ones(len(a), np.int64)))

    for batch in batches:
        xs, ys = batch.column("xs"), batch.column("ys")
        xo, yo = xs.offsets.to_numpy(), ys.offsets.to_numpy()
        xv, yv = xs.values.to_numpy(), ys.values.to_numpy()
        xn, yn = np.diff(xo), np.diff(yo)
        for n in np.unique(xn[(yn == 0) & (xn > 1)]):  # all baskets of one size at once
            rows = np.flatnonzero((xn == n) & (yn == 0))
            i, j = np.triu_indices(n, 1)
            step = max(1, BUFFER // len(i))
            for k in range(0, len(rows), step):
                m = xv[xo[rows[k : k + step]][:, None] + np.arange(n)]
                a, b = m[:, i].ravel(), m[:, j].ravel()
                held.append((np.minimum(a, b), np.maximum(a, b)))
                size += len(a)
                if size >= BUFFER:
                    yield flush()
                    held, size = [], 0
        for r in np.flatnonzero((yn > 0) & (xn > 0)):
            held.append(_pairs(xv[xo[r] : xo[r + 1]], yv[yo[r] : yo[r + 1]]))
            size += len(held[-1][0])
            if size >= BUFFER:
                yield flush()
                held, size = [], 0
    if size:
        yield flush()


def _merge(least: int):
    """Stripes sorted by (item_a, part) to merged stripes without pairs below ``least``; holds one part of one stripe."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def add(got):
            nonlocal held, size
            held.append(got)
            size += len(got[0])
            if size > 2 * BUFFER:
                held = [_sum(*(np.concatenate(x) for x in zip(*held)))]
                size = len(held[0][0])

        def flush(keep_last: bool):
            """Emit all stripes but the last, which may go on in the next batch."""
            nonlocal held, size
            a, part, b, n = _sum(*(np.concatenate(x) for x in zip(*held)))
            open_ = (a == a[-1]) & (part == part[-1]) if keep_last and len(a) else np.zeros(len(a), bool)
            held = [(a[open_], part[open_], b[open_], n[open_])] if open_.any() else []
            size = int(open_.sum())
            done = ~open_ & (n >= least)
            if done.any():
                yield _rows(a[done], part[done], b[done], n[done])

        for batch in batches:
            if not batch.num_rows:
                continue
            nbrs, cnts = batch.column("nbrs"), batch.column("cnts")
            lengths = np.diff(nbrs.offsets.to_numpy())
            # values of a sliced list start at its first offset
            b, n = nbrs.flatten().to_numpy(), cnts.flatten().to_numpy()
            add((np.repeat(batch.column("item_a").to_numpy(), lengths), np.repeat(batch.column("part").to_numpy(), lengths), b, n))
            if size > BUFFER // 4:
                yield from flush(True)
        if held:
            yield from flush(False)

    return run


def _look_up(rows: DataFrame, items: DataFrame, hot: DataFrame, key: str, out: dict[str, str]) -> DataFrame:
    """``rows`` joined with ``items`` on ``key``; the few items of ``hot`` are broadcast, so no task gets all rows of one."""
    names = [F.col(c).alias(n) for c, n in out.items()]
    few = F.broadcast(hot.select(*names))
    first = rows.join(few, key)
    rest = rows.join(few, key, "left_anti").join(items.where("NOT hot").select(*names).hint("shuffle_hash"), key)
    return first.unionByName(rest)


def cooccurrence(
    actions: DataFrame,
    basket: list[str],
    item: str,
    min_count: int = 1,
    min_lift: float = 0.0,
) -> DataFrame:
    """Pairs of items in the same basket: iid_a, iid_b, n_ab, n_a, n_b, n_baskets, lift, llr.

    ``actions`` has a row for each action; rows with a null in ``basket`` or
    ``item`` don't count and an item counts once in a basket however often it
    is repeated. Only pairs with n_ab >= min_count and lift >= min_lift come
    out; lift is n_ab * N / (n_a * n_b). iid_a is the smaller id. Other columns
    of ``actions`` are ignored, whatever their names. No rows, or no basket
    with two items, give an empty result.

    Both bounds also hold for single items (n_ab <= min(n_a, n_b), thus n_a >=
    min_count and n_a <= N / min_lift), so items that can't be in any such pair
    leave before baskets are built. That loses no pair.

    A basket of more than CHUNK items is cut by a hash of the item into chunks,
    and each pair of chunks is one row: however large a basket, no task holds
    it whole and each of its pairs is counted once.
    """
    named = actions.select(*[F.col(b).alias(f"k{i}") for i, b in enumerate(basket)], item_key(item).alias("iid"))
    keys = [f"k{i}" for i in range(len(basket))]
    rows = named.dropna().select(F.xxhash64(*keys).alias("h1"), F.hash(*keys).alias("h2"), "iid").distinct()
    rows = scratch.keep(rows, "baskets")
    n = rows.select(F.count_distinct("h1", "h2").alias("n")).first()["n"]
    counts = rows.groupBy("iid").agg(F.count(F.lit(1)).alias("n_x")).where(F.col("n_x") >= min_count)
    if min_lift > 0:
        counts = counts.where(F.col("n_x") * F.lit(float(min_lift)) <= F.lit(float(n)))
    seq = F.monotonically_increasing_id()
    number = F.shiftleft(F.floor(F.log2("n_x")).cast("bigint"), _LOW).bitwiseOR(seq)
    numbered = scratch.keep(counts.select("iid", "n_x", number.alias("item"), (F.col("n_x") >= F.lit(HOT * n)).alias("hot")), "items")
    hot = scratch.keep(numbered.where("hot"), "hot-items")
    used = _look_up(rows, numbered, hot, "iid", {"iid": "iid", "item": "item"}).select("h1", "h2", "item")
    sizes = used.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("size"))
    large = sizes.where(F.col("size") > CHUNK)
    chunked = used.join(large, ["h1", "h2"], "left").withColumn("k", F.coalesce(F.ceil(F.col("size") / CHUNK), F.lit(1)).cast("int"))
    chunks = (
        chunked.withColumn("chunk", F.when(F.col("k") > 1, F.pmod(F.xxhash64("item"), F.col("k"))).otherwise(0).cast("int"))
        .groupBy("h1", "h2", "k", "chunk")
        .agg(F.collect_list("item").alias("xs"))
    )
    none = F.array().cast("array<bigint>")
    small = chunks.where("k = 1 AND size(xs) > 1").select("xs", none.alias("ys"))
    met = (
        chunks.where("k > 1")
        .select("h1", "h2", "chunk", "xs", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("other"))
        .groupBy("h1", "h2", F.least("chunk", "other").alias("lo"), F.greatest("chunk", "other").alias("hi"))
        .agg(
            F.max(F.when(F.col("chunk") == F.least("chunk", "other"), F.col("xs"))).alias("xs"),
            F.max(F.when((F.col("chunk") == F.greatest("chunk", "other")) & (F.col("chunk") != F.col("other")), F.col("xs"))).alias("ys"),
        )
        .where("xs IS NOT NULL AND (lo = hi OR ys IS NOT NULL)")
        .select("xs", F.coalesce("ys", none).alias("ys"))
    )
    schema = "item_a bigint, part int, nbrs array<bigint>, cnts array<bigint>"
    stripes = small.unionByName(met).mapInArrow(_stripes, schema)
    merged = stripes.repartition("item_a", "part").sortWithinPartitions("item_a", "part").mapInArrow(_merge(min_count), schema)
    merged = merged.select("item_a", F.explode(F.arrays_zip("nbrs", "cnts")).alias("s")).select("item_a", F.col("s.nbrs").alias("item_b"), F.col("s.cnts").alias("n_ab"))
    pairs = _look_up(merged, numbered, hot, "item_a", {"item": "item_a", "iid": "iid_1", "n_x": "n_1"})
    pairs = _look_up(pairs, numbered, hot, "item_b", {"item": "item_b", "iid": "iid_2", "n_x": "n_2"})
    first = F.col("iid_1") < F.col("iid_2")
    pairs = pairs.select(
        F.when(first, F.col("iid_1")).otherwise(F.col("iid_2")).alias("iid_a"),
        F.when(first, F.col("iid_2")).otherwise(F.col("iid_1")).alias("iid_b"),
        "n_ab",
        F.when(first, F.col("n_1")).otherwise(F.col("n_2")).alias("n_a"),
        F.when(first, F.col("n_2")).otherwise(F.col("n_1")).alias("n_b"),
        F.lit(n).cast("bigint").alias("n_baskets"),
    )
    lift = F.col("n_ab").cast("double") * F.col("n_baskets") / (F.col("n_a").cast("double") * F.col("n_b"))
    return pairs.withColumn("lift", lift).where(F.col("lift") >= min_lift).withColumn("llr", log_likelihood_ratio())


def log_likelihood_ratio():
    """Dunning's G2 of the 2x2 table given by n_ab, n_a, n_b and n_baskets."""
    n, a, b, ab = (F.col(c).cast("double") for c in ("n_baskets", "n_a", "n_b", "n_ab"))

    def cell(k, row, column):
        return F.when(k > 0, k * F.log(k * n / (row * column))).otherwise(0.0)

    return F.greatest(F.lit(0.0), 2 * (cell(ab, a, b) + cell(a - ab, a, n - b) + cell(b - ab, n - a, b) + cell(n - a - b + ab, n - a, n - b)))
