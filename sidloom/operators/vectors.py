"""Exact similarity of a stated query set against all vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Queries and vectors of one block; every pair of blocks is a task's work.
QUERIES, VECTORS = 4096, 65536


def matrix(column: pa.Array | pa.ChunkedArray, rows: int) -> np.ndarray:
    """A column of equally long arrays of numbers as a matrix of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(rows, -1) if rows else np.zeros((0, 0))


def topk_cosine(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """(q, c, cosine): for each (id, v) of ``queries`` the k most similar other rows of ``vectors``.

    Queries and vectors are dealt to blocks by a hash of the id and every pair
    of blocks is one matrix product, so nothing passes through the driver and
    the shuffle has k rows per query and block. Equal similarities go by id.
    Null, empty and zero vectors match nothing.
    """
    some = lambda df: df.where(F.size("v") > 0).select(F.col("id").cast("bigint").alias("id"), F.col("v").cast("array<double>").alias("v"))
    q, x = some(queries), some(vectors)
    counts = q.agg(F.count(F.lit(1)).alias("q")).crossJoin(x.agg(F.count(F.lit(1)).alias("x"))).first()
    nq, nx = max(1, -(-counts["q"] // QUERIES)), max(1, -(-counts["x"] // VECTORS))
    place = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    left = q.select(place(nq).alias("bq"), F.explode(F.sequence(F.lit(0), F.lit(nx - 1))).alias("bx"), "id", "v")
    right = x.select(F.explode(F.sequence(F.lit(0), F.lit(nq - 1))).alias("bq"), place(nx).alias("bx"), "id", "v")

    def block(key, one: pa.Table, two: pa.Table) -> pa.Table:
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if one.num_rows and two.num_rows:
            a, b = matrix(one.column("v"), one.num_rows), matrix(two.column("v"), two.num_rows)
            na, nb = np.sqrt((a * a).sum(axis=1)), np.sqrt((b * b).sum(axis=1))
            ia, ib = one.column("id").to_numpy()[na > 0], two.column("id").to_numpy()[nb > 0]
            a, b = a[na > 0] / na[na > 0, None], b[nb > 0] / nb[nb > 0, None]
            order = np.argsort(ib)
            ib, b = ib[order], b[order]
            for s in range(0, len(ia), 256):
                sims = a[s : s + 256] @ b.T
                mine = ia[s : s + 256]
                sims[mine[:, None] == ib[None, :]] = -2
                if len(ib) > k:
                    least = np.partition(sims, len(ib) - k, axis=1)[:, len(ib) - k]
                    r, c = np.nonzero(sims >= least[:, None])  # with all ties at the end, cut below
                else:
                    r, c = np.divmod(np.arange(sims.size), sims.shape[1]) if sims.size else (np.zeros(0, int),) * 2
                v = sims[r, c]
                r, c, v = r[v > -1.5], c[v > -1.5], v[v > -1.5]
                order = np.lexsort((c, -v, r))
                r, c, v = r[order], c[order], v[order]
                start = np.flatnonzero(np.r_[True, r[1:] != r[:-1]]) if len(r) else np.zeros(0, int)
                rank = np.arange(len(r)) - np.repeat(start, np.diff(np.r_[start, len(r)]))
                out.append((mine[r[rank < k]], ib[c[rank < k]], v[rank < k]))
        return pa.table(dict(zip(("q", "c", "cosine"), (np.concatenate(z) for z in zip(*out)))))

    found = left.groupBy("bq", "bx").cogroup(right.groupBy("bq", "bx")).applyInArrow(block, "q bigint, c bigint, cosine double")
    best = Window.partitionBy("q").orderBy(F.desc("cosine"), "c")
    return found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).drop("r")
