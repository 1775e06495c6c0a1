"""Vector quantisers: assignment and decoding by codebooks, training by Lloyd rounds or MLlib."""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import scratch
from .vectors import matrix

#: Most rows of one codebook: it is broadcast to the tasks.
MAX_CODES = 65536
Book = np.ndarray


def rows(df: DataFrame, key: str, vector: str, start: int, end: int) -> Book:
    """The vectors with the keys start..end-1 as a codebook, in the order of the key."""
    if end - start > MAX_CODES:
        raise ValueError(f"{end - start} codes; a codebook has {MAX_CODES} at most")
    got = df.where((F.col(key) >= start) & (F.col(key) < end)).orderBy(key).limit(end - start).select(vector).collect()
    return np.array([r[0] for r in got], dtype=np.float64)


def nearest(x: np.ndarray, book: Book) -> np.ndarray:
    """Number of the nearest row of the codebook, the lowest on ties (distances to 8 decimals)."""
    out = np.empty(len(x), np.int64)
    c2 = (book * book).sum(axis=1)
    for s in range(0, len(x), 4096):
        y = x[s : s + 4096]
        out[s : s + 4096] = np.round((y * y).sum(axis=1)[:, None] + c2[None, :] - 2 * (y @ book.T), 8).argmin(axis=1)
    return out


def residuals(vectors: np.ndarray, book: Book) -> np.ndarray:
    return vectors - book[nearest(vectors, book)]


def encode(df: DataFrame, key: str, vector: str, books: list[Book], keep: tuple[str, ...] = (), slices: bool = False) -> DataFrame:
    """(key, codes, losses[, keep]) of every vector as long as the codebooks ask for.

    Residual quantiser: each codebook takes what the codebooks before it left.
    With ``slices`` (product quantiser) codebook i takes the i-th slice.
    losses are the squared lengths of what is left after each codebook.
    Codebooks are broadcast; a batch is one matrix product for each.
    """
    dim = sum(b.shape[1] for b in books) if slices else books[0].shape[1]
    shared = df.sparkSession.sparkContext.broadcast(books)
    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in (key, *keep))

    def run(batches):
        for b in batches:
            x = matrix(b.column("v"), b.num_rows)
            codes, losses, at = [], [], 0
            for book in shared.value:
                part = x[:, at : at + book.shape[1]] if slices else x
                code = nearest(part, book) if len(x) else np.zeros(0, np.int64)
                left = part - book[code]
                codes.append(code)
                losses.append((left * left).sum(axis=1))
                if slices:
                    at += book.shape[1]
                else:
                    x = left
            n, m = b.num_rows, len(codes)
            offsets = pa.array(np.arange(n + 1, dtype=np.int32) * m)
            flat = lambda z, t: pa.ListArray.from_arrays(offsets, pa.array(np.stack(z, axis=1).ravel().astype(t)))  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in (key, *keep)), flat(codes, np.int32), flat(losses, np.float64)], names=[key, *keep, "codes", "losses"])

    given = df.where(F.size(vector) == dim).select(key, *keep, F.col(vector).cast("array<double>").alias("v"))
    return given.mapInArrow(run, f"{kinds}, codes array<int>, losses array<double>")


def decode(df: DataFrame, key: str, codes: str, books: list[Book], slices: bool = False) -> DataFrame:
    """(key, v): the sum of the named rows of the codebooks, or with ``slices`` one after another."""
    shared = df.sparkSession.sparkContext.broadcast(books)

    def run(batches):
        for b in batches:
            c = matrix(b.column("c"), b.num_rows).astype(np.int64)
            parts = [book[c[:, i]] for i, book in enumerate(shared.value)] if b.num_rows else []
            v = (np.concatenate(parts, axis=1) if slices else sum(parts)) if parts else np.zeros((0, 0))
            offsets = pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * v.shape[1])
            yield pa.RecordBatch.from_arrays([b.column(key), pa.ListArray.from_arrays(offsets, pa.array(v.ravel()))], names=[key, "v"])

    return df.where(F.size(codes) == len(books)).select(key, F.col(codes).alias("c")).mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, v array<double>")


def _round(x: DataFrame, book: Book) -> tuple[np.ndarray, np.ndarray, float, np.ndarray]:
    """(rows, sums, inertia) of every code in one pass, and the worst-placed vectors of the tasks."""
    shared, k, dim = x.sparkSession.sparkContext.broadcast(book), len(book), book.shape[1]

    def run(batches):
        n, s, inertia, far = np.zeros(k), np.zeros((k, dim)), 0.0, (-1.0, np.zeros(dim))
        for b in batches:
            v = matrix(b.column("v"), b.num_rows)
            if not len(v):
                continue
            code = nearest(v, shared.value)
            left = ((v - shared.value[code]) ** 2).sum(axis=1)
            n += np.bincount(code, minlength=k)
            np.add.at(s, code, v)
            inertia += left.sum()
            if left.max() > far[0]:
                far = (float(left.max()), v[left.argmax()])
        flat = np.concatenate([n, s.ravel(), [inertia]])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat), pa.array([None] * len(flat), pa.list_(pa.float64()))], names=["i", "x", "far"])
        if far[0] >= 0:
            yield pa.RecordBatch.from_arrays([pa.array([-1]), pa.array([far[0]]), pa.array([far[1].tolist()], pa.list_(pa.float64()))], names=["i", "x", "far"])

    got = x.mapInArrow(run, "i bigint, x double, far array<double>")
    summed = got.groupBy("i").agg(F.sum("x").alias("x"), F.max_by("far", "x").alias("far"))  # k * (D + 1) + 2 rows
    table = {r["i"]: r for r in summed.collect()}
    flat = np.array([table[i]["x"] if i in table else 0.0 for i in range(k * (dim + 1) + 1)])
    far = np.array(table[-1]["far"]) if -1 in table else np.zeros(dim)
    return flat[:k], flat[k:-1].reshape(k, dim), float(flat[-1]), far


def fit(df: DataFrame, vector: str, k: int, rounds: int = 25, tries: int = 1, sample: int | None = None, tol: float = 1e-6) -> tuple[Book, float, int]:
    """(codebook, inertia, rounds used): the best of ``tries`` Lloyd runs from different starts.

    A start are k vectors picked by a hash. Each round is one pass with k sums
    per task; only these reach the driver. A code without vectors moves to the
    worst-placed vector. A run ends when no centre moves more than ``tol``.
    ``sample`` fits on about so many vectors picked by a hash instead of all;
    the inertia is that of the vectors fitted on.
    """
    x = df.where(F.size(vector) > 0).select(F.col(vector).cast("array<double>").alias("v"))
    total = x.count()
    if sample and total > sample:
        x = x.where(F.pmod(F.xxhash64("v"), F.lit(1_000_003)) < F.lit(1_000_003 * sample / total))
    x = scratch.keep(x, "fit")
    best: tuple[Book, float, int] | None = None
    for t in range(tries):
        start = x.dropDuplicates(["v"]).orderBy(F.xxhash64("v", F.lit(t)), "v").limit(k).collect()
        book = np.array([r["v"] for r in start], dtype=np.float64)
        used, inertia = 0, 0.0
        for used in range(1, rounds + 1):
            n, s, inertia, far = _round(x, book)
            new = np.where(n[:, None] > 0, s / np.maximum(n, 1)[:, None], book)
            empty = np.flatnonzero(n == 0)
            if len(empty):
                new[empty[0]] = far
            moved = float(np.abs(new - book).max()) if len(book) else 0.0
            book = new
            if moved <= tol:
                break
        if best is None or inertia < best[1]:
            best = (book, inertia, used)
    return best


def kmeans(df: DataFrame, key: str, vector: str, k: int, tries: int = 3, rounds: int = 25) -> DataFrame:
    """(code, n, utilization): sizes of the clusters of the best of ``tries`` runs, and the part of codes in use."""
    book, _, _ = fit(df, vector, k, rounds, tries)
    sizes = encode(df, key, vector, [book]).groupBy(F.element_at("codes", 1).alias("code")).agg(F.count(F.lit(1)).alias("n"))
    used = sizes.agg((F.count(F.lit(1)) / k).alias("utilization"))
    return sizes.crossJoin(F.broadcast(used))


def lloyd(df: DataFrame, key: str, vector: str, k: int, rounds: int, sample: int | None = None) -> DataFrame:
    """(code, n, inertia) of all vectors after Lloyd rounds, fitted on all or on a sample."""
    book, _, _ = fit(df, vector, k, rounds, sample=sample)
    coded = encode(df, key, vector, [book]).select(F.element_at("codes", 1).alias("code"), F.element_at("losses", 1).alias("d"))
    return coded.groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("d"), 4).alias("inertia"))


def cached_codebook(spark: SparkSession, df: DataFrame, vector: str, config: dict) -> tuple[Book, bool]:
    """(codebook, whether it was there): codebooks of this application by a hash of their configuration."""
    name = hashlib.sha256(json.dumps(config, sort_keys=True).encode()).hexdigest()[:16]
    path = f"{scratch.folder(spark)}/codebook-{name}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
    if not found:
        book, _, _ = fit(df, vector, config["k"], config.get("rounds", 25), config.get("tries", 1))
        spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(book)], "code int, v array<double>").coalesce(1).write.parquet(path)
    got = spark.read.schema("code int, v array<double>").parquet(path).orderBy("code").collect()
    return np.array([r["v"] for r in got]), found


def incremental(old: DataFrame, vectors: DataFrame, key: str, vector: str, books: list[Book]) -> DataFrame:
    """(key, codes, fresh): codes of ``old`` (key, codes) stay; only keys without one are encoded."""
    new = encode(vectors.join(old.select(key), key, "left_anti"), key, vector, books)
    return old.select(key, "codes", F.lit(False).alias("fresh")).unionByName(new.select(key, "codes", F.lit(True).alias("fresh")))


def _ml(df: DataFrame, key: str, vector: str) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    return df.select(F.col(key).alias("id"), array_to_vector(F.col(vector).cast("array<double>")).alias("features"))


def pca(df: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """(id, x): the first k principal components of each vector."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import vector_to_array

    x = _ml(df, key, vector)
    return PCA(k=k, inputCol="features", outputCol="p").fit(x).transform(x).select("id", vector_to_array("p").alias("x"))


def pq_train(df: DataFrame, key: str, vector: str, parts: int, k: int, rounds: int = 10) -> list[Book]:
    """A codebook for each slice of the vectors."""
    dim = len(df.where(F.size(vector) > 0).select(vector).first()[0])
    width = dim // parts
    return [fit(df.select(F.slice(vector, p * width + 1, width).alias("s")), "s", k, rounds)[0] for p in range(parts)]
