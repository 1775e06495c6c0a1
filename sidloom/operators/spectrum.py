"""Variance spectrum of a vector column."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F



def effective_dim(df: DataFrame, vector: str) -> DataFrame:
    """(dim, d90, d95, d99, participation, top10): principal components for a share of the variance, and the share of the first ten.

    The second moments are summed where the rows are (D * D numbers a task);
    only that matrix, whose size is fixed by D, is decomposed on the driver.
    """

    def moments(batches):
        total = None
        for b in batches:
            x = np.array(b.column("v").to_pylist(), dtype=np.float64)
            if len(x):
                m = np.concatenate([x.T @ x, x.sum(axis=0)[None], np.full((1, x.shape[1]), len(x))]).ravel()
                total = m if total is None else total + m
        if total is not None:
            import pyarrow as pa

            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["i", "x"])

    got = df.select(F.col(vector).cast("array<double>").alias("v")).mapInArrow(moments, "i bigint, x double").groupBy("i").agg(F.sum("x").alias("x")).orderBy("i").toPandas()["x"].to_numpy()
    spark = df.sparkSession
    schema = "dim int, d90 int, d95 int, d99 int, participation double, top10 double"
    if not len(got):
        return spark.createDataFrame([], schema)
    d = int(np.sqrt(len(got) + 1)) - 1
    m = got.reshape(d + 2, d)
    n, mean = m[d + 1, 0], m[d] / m[d + 1, 0]
    w = np.clip(np.linalg.eigvalsh(m[:d] / n - np.outer(mean, mean))[::-1], 0, None)
    share = np.cumsum(w) / w.sum()
    row = (d, *[int(np.searchsorted(share, p) + 1) for p in (0.9, 0.95, 0.99)], float(w.sum() ** 2 / (w**2).sum()), float(w[:10].sum() / w.sum()))
    return spark.createDataFrame([row], schema)
