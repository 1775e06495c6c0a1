"""Most frequent items in bounded memory: a hierarchical count-sketch.

Ids are hashed to 32-bit codes. For prefixes of 8, 16, 24 and 32 bits of the
code, each task keeps a count-sketch: DEPTH rows of WIDTH counters to which an
id adds +1 or -1. Sketches are linear, so adding the tasks' counters gives the
sketch of all rows, of fixed size whatever the input. The heavy prefixes are
then descended, and a second scan counts the ids below the last of them exactly.
Where the share asked for is too small for the counters (their own second
moment tells), the descent stops a level earlier, and the second scan counts
all ids below the prefixes that are left: slower, and as exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..util import item_key

BITS = (8, 16, 24, 32)
DEPTH, WIDTH = 5, 16384
#: Nodes that may stay heavy on a level; beyond it the descent stops a level earlier.
MAX_NODES = 4096


def _slots(codes: np.ndarray, level: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(column, sign) of each code's prefix in every row of a level's sketch."""
    rng = np.random.default_rng([11, level])
    prefix = codes >> np.uint64(32 - BITS[level])
    out = []
    for _ in range(DEPTH):
        a, b = (rng.integers(1, 2**63, 2, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
        h = (prefix + b) * a
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        out.append(((h % np.uint64(WIDTH)).astype(np.int64), np.where(h >> np.uint64(63), 1, -1)))
    return out


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counters, total = np.zeros((len(BITS), DEPTH, WIDTH), np.int64), 0
    for b in batches:
        total += b.num_rows
        codes, n = np.unique(b.column("code").to_numpy().astype(np.uint64), return_counts=True)
        for level in range(len(BITS)):
            for row, (col, sign) in enumerate(_slots(codes, level)):
                counters[level, row] += np.bincount(col, weights=sign * n, minlength=WIDTH).astype(np.int64)
    flat = counters.ravel()
    used = np.flatnonzero(flat)
    yield pa.RecordBatch.from_arrays([pa.array(np.r_[used, -1].astype(np.int32)), pa.array(np.r_[flat[used], total])], names=["slot", "delta"])  # slot -1: all values


def _descend(counters: np.ndarray, least: float) -> tuple[int, np.ndarray]:
    """(bits, prefixes of so many bits) below which every id that occurs ``least`` times is, but for a small chance."""
    nodes, at = np.zeros(1, np.uint64), 0
    for level, bits in enumerate(BITS):
        step = bits - at
        children = ((nodes[:, None] << np.uint64(step)) | np.arange(2**step, dtype=np.uint64)).ravel()
        slots = _slots(children << np.uint64(32 - bits), level)
        estimate = np.median([counters[level, r][col] * sign for r, (col, sign) in enumerate(slots)], axis=0)
        # what the sketch may be wrong by, from its own second moment
        slack = 4 * np.sqrt(np.median((counters[level].astype(float) ** 2).sum(axis=1)) / WIDTH)
        heavy = children[estimate >= least - slack]
        if slack >= least or len(heavy) > MAX_NODES:
            break
        nodes, at = heavy, bits
    return at, nodes


def frequent_items(ids: DataFrame, column: str, share: float) -> DataFrame:
    """(item, n, n_total) of every value that makes up at least ``share`` of the non-null values.

    n is exact: the sketch only proposes candidates. n_total is the number of
    all non-null values. Other columns are ignored. No values, no rows.
    ``ids`` is scanned twice; hand in a kept table.
    """
    spark = ids.sparkSession
    values = ids.select(F.col(column).alias("item")).where("item IS NOT NULL")
    code = F.pmod(F.xxhash64("item"), F.lit(2**32))
    summed = values.select(code.alias("code")).mapInArrow(_sketch, "slot int, delta bigint").groupBy("slot").agg(F.sum("delta").alias("delta"))
    got = summed.toArrow()  # len(BITS) * DEPTH * WIDTH + 1 rows at most
    slot, delta = got.column("slot").to_numpy(), got.column("delta").to_numpy()
    total = int(delta[slot < 0].sum())
    counters = np.zeros(len(BITS) * DEPTH * WIDTH, np.int64)
    counters[slot[slot >= 0]] = delta[slot >= 0]
    bits, nodes = _descend(counters.reshape(len(BITS), DEPTH, WIDTH), share * total) if total else (32, np.zeros(0, np.uint64))
    hot = values
    if bits:
        listed = F.broadcast(spark.createDataFrame([(int(c),) for c in nodes], "code bigint"))  # MAX_NODES rows at most
        hot = values.withColumn("code", F.shiftright(code, 32 - bits)).join(listed, "code", "left_semi")
    exact = hot.groupBy("item").agg(F.count(F.lit(1)).alias("n")).withColumn("n_total", F.lit(total).cast("bigint"))
    return exact.where(F.col("n") >= F.lit(share) * F.col("n_total"))


def latest_targets(sequences: DataFrame) -> DataFrame:
    """All targets (item) of each user's latest sequence, repeated ones too.

    Users are told apart by uid; a null uid is no user. A null built_at is
    older than any other; equal times are decided by the larger array. Null and
    blank ids are no targets; null and empty arrays have none.
    """
    last = sequences.where("uid IS NOT NULL").groupBy("uid").agg(F.max(F.struct("built_at", "eval_cids")).alias("v"))
    items = last.select(F.explode("v.eval_cids").alias("e"))
    return items.select(item_key("e").alias("item")).where("item <> ''")
