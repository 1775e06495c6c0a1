"""Vector tables for similarity operators: cleaning, normalising, packing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import scratch
from ..util import item_key


def latest_vectors(rows: DataFrame, key: str, vector: str, at: str, dim: int, extra: str | None = None) -> DataFrame:
    """One row per item with its latest usable vector: cid, vec[, extra].

    A vector is usable if it has exactly ``dim`` finite numbers, not all zero.
    Null and blank keys are dropped; a null ``at`` is older than any other;
    equal times are decided by the larger hash of the vector.
    """
    v = F.col("vec")
    named = rows.select(item_key(key).alias("cid"), F.col(vector).cast("array<float>").alias("vec"), F.col(at).alias("at"), *([F.col(extra).alias("extra")] if extra else []))
    usable = (
        (F.size(v) == dim)
        & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists(v, lambda x: x != 0)
    )
    last = F.struct("at", F.xxhash64("vec"))
    return (
        named.where("cid <> ''")
        .where(usable)
        .groupBy("cid")
        .agg(F.max_by("vec", last).alias("vec"), *([F.max_by("extra", last).alias("extra")] if extra else []))
    )


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x = np.asarray(b.column("vec").flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(b.num_rows, -1)
        if not b.num_rows:
            continue
        x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow or underflow in the norm
        x = (x / np.sqrt((x * x).sum(axis=1, keepdims=True))).astype(np.float32)
        flat = np.ascontiguousarray(x).view(np.uint8)
        packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(x.shape[1] * 4), len(x), [None, pa.py_buffer(flat)]).cast(pa.binary())
        yield pa.RecordBatch.from_arrays([packed if n == "vec" else b.column(n) for n in b.schema.names], names=b.schema.names)


def numbered_vectors(latest: DataFrame, name: str) -> DataFrame:
    """Keep unit vectors as packed float32 with a number in the order of cid: id, cid, vec[, extra]."""
    fields = ", ".join(f"{f.name} {'binary' if f.name == 'vec' else f.dataType.simpleString()}" for f in latest.schema.fields)
    packed = latest.mapInArrow(_pack, fields)
    return scratch.keep(packed.sort("cid").withColumn("id", F.monotonically_increasing_id()), name)


def unpack(column: pa.Array | pa.ChunkedArray, rows: int) -> np.ndarray:
    """A binary column of packed float32 vectors as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    start, end = (np.frombuffer(column.buffers()[1], dtype=np.int32)[[column.offset, column.offset + rows]]).tolist()
    return np.frombuffer(column.buffers()[2], dtype=np.uint8)[start:end].view(np.float32).reshape(rows, -1)
