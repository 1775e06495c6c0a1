"""Evaluation passages inside training texts: size-partitioned MinHash containment search.

A leak is RUN consecutive words of a passage, or the whole of a shorter one.
Texts are sequences of five-word shingles; passages are partitioned by the
number of shingles that a leak of theirs has (RUN words have RUN - 4, a shorter
passage all it has). For each such size a text is known by the MinHashes of
its windows of that many shingles, of which neighbouring windows share most. A
window that a document contains has the same shingles there and so the same
MinHash, however long the document is, so the search misses nothing; each
place it proposes is verified by extending the shared shingle word by word.

Passages of at most BLOCK_WORDS words in all are broadcast and searched while
the documents are read. More are joined with the documents on the MinHash, and
only documents that share one are read a second time, for the verification.
"""

from __future__ import annotations

import html
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import scratch

RUN, SHINGLE = 12, 5
BLOCK_WORDS = 2_000_000

_INLINE = re.compile(r"</?(?:b|i|u|s|em|strong|span|a|mark|small|sub|sup|font|code|tt|wbr)\b[^<>]*>", re.I)
_TAG = re.compile(r"<!--.*?-->|</?[a-z!][^<>]*>", re.I | re.S)
_LINK = re.compile(r"\]\((?:https?:|/|#|mailto:)[^()\s]*\)")
_WORD = re.compile(r"[^\W_]+")
_HIDDEN = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠎​-‏‪-‮⁠-⁯︀-️﻿]")


def words(text: str) -> list[str]:
    """Runs of letters and digits, without case, accents, markup and invisible characters."""
    if "<" in text:
        text = _TAG.sub(" ", _INLINE.sub("", text))
    if "&" in text:
        text = html.unescape(text)
    if "](" in text:
        text = _LINK.sub("]", text)
    if not text.isascii():
        text = _HIDDEN.sub("", text)
        text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
        return _WORD.findall(unicodedata.normalize("NFKC", text.casefold()))
    return _WORD.findall(text.lower())


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    x = (x + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def min_hashes(ids: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, position) of the shingles that are the MinHash of some window of ``size`` words."""
    s = min(SHINGLE, size)
    n = len(ids) - s + 1
    if len(ids) < size or size < 1:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    shingle = np.zeros(n, np.uint64)
    for j in range(s):
        shingle = _mix(shingle ^ ids[j : j + n].astype(np.uint64), j + 1)
    wide = size - s + 1
    at = np.unique(np.lib.stride_tricks.sliding_window_view(shingle, wide).argmin(axis=1) + np.arange(n - wide + 1))
    return shingle[at], at


def run_length(a: np.ndarray, i: int, b: np.ndarray, j: int, least: int) -> bool:
    """Whether a and b have ``least`` equal words in a row that include a[i] and b[j]."""
    left = right = 0
    while left < least and left <= min(i, j) and a[i - left] == b[j - left]:
        left += 1
    while left and left + right < least and i + right + 1 < len(a) and j + right + 1 < len(b) and a[i + right + 1] == b[j + right + 1]:
        right += 1
    return left + right >= least


class PassageIndex:
    """MinHashes of all passages by the size of a leak."""

    def __init__(self, passages: list[tuple], run: int = RUN):
        self.vocabulary: dict[str, int] = {}
        self.passages = [(i, w) for i, p in passages if (w := words(p))]
        self.coded = [np.array([self.vocabulary.setdefault(x, len(self.vocabulary) + 1) for x in w], np.int64) for _, w in self.passages]
        self.sizes: dict[int, tuple] = {}
        for size in sorted({min(run, len(c)) for c in self.coded}):
            keys, who, at = [], [], []
            for p, c in enumerate(self.coded):
                if min(run, len(c)) == size:
                    k, where = min_hashes(c, size)
                    keys.append(k)
                    who.append(np.full(len(k), p))
                    at.append(where)
            k, who, at = np.concatenate(keys), np.concatenate(who), np.concatenate(at)
            order = np.argsort(k, kind="stable")
            self.sizes[size] = (k[order], who[order], at[order])

    def search(self, texts: list[list[str]]) -> set[tuple[int, int]]:
        """(position in texts, position in passages) of each leak; texts are lists of words."""
        get = self.vocabulary.get
        parts, owner = [], []
        for d, t in enumerate(texts):
            w = [get(x, 0) for x in t]
            if any(w):
                parts.append(np.array([*w, 0], np.int64))
                owner.append(np.full(len(w) + 1, d))
        seen: set[tuple[int, int]] = set()
        if not parts:
            return seen
        ids, owner = np.concatenate(parts), np.concatenate(owner)
        edges = np.flatnonzero(np.diff(np.r_[0, (ids > 0).astype(np.int8), 0]))
        for start, end in edges.reshape(-1, 2):  # runs of words that occur in passages
            for size, (keys, who, at) in self.sizes.items():
                if end - start < size:
                    continue
                own, where = min_hashes(ids[start:end], size)
                lo, hi = np.searchsorted(keys, own, "left"), np.searchsorted(keys, own, "right")
                for w in np.flatnonzero(hi > lo):
                    for m in range(lo[w], hi[w]):
                        found = (int(owner[start]), int(who[m]))
                        if found not in seen and run_length(ids[start:end], where[w], self.coded[who[m]], at[m], size):
                            seen.add(found)
        return seen


def _keys(texts: list[str], sizes: list[int] | None, run: int) -> list[tuple[int, int, int]]:
    """(position in texts, size, MinHash) of each text for the given sizes, or for the size of its own leak."""
    out = []
    for d, t in enumerate(texts):
        ids = np.array([zlib.crc32(w.encode()) for w in words(t)], np.int64) if t else np.zeros(0, np.int64)
        for size in sizes if sizes is not None else [min(run, len(ids))]:
            out += [(d, size, int(h)) for h in np.unique(min_hashes(ids, size)[0]).view(np.int64)]
    return out


def _hashed(sizes: list[int] | None, run: int):
    """Rows (no, t) to rows (no, size, h)."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("t").to_pylist()
            for s in range(0, len(texts), 500):
                got = _keys(texts[s : s + 500], sizes, run)
                no = b.column("no").take(pa.array([s + g[0] for g in got], pa.int64()))
                yield pa.RecordBatch.from_arrays([no, pa.array([g[1] for g in got], pa.int32()), pa.array([g[2] for g in got], pa.int64())], names=["no", "size", "h"])

    return keyed


def leaked_passages(docs: DataFrame, key: str, text: str, items: DataFrame, item: str, passage: str, run: int = RUN) -> DataFrame:
    """(key, item): each document that holds ``run`` consecutive words of a passage, or all of a shorter one.

    Null texts and passages, and passages without any word, match nothing; null
    keys are dropped. Repeated documents or items give one row a pair. Other
    columns are ignored.
    """
    spark = docs.sparkSession
    rows = items.select(F.col(item).alias("i"), F.col(passage).alias("p")).dropna().distinct()
    size = rows.agg(F.coalesce(F.sum(F.length("p")), F.lit(0)).alias("chars")).first()
    doc_kind, item_kind = docs.schema[key].dataType.simpleString(), items.schema[item].dataType.simpleString()
    kinds = f"k {doc_kind}, i {item_kind}"
    read = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).where("k IS NOT NULL AND t IS NOT NULL")
    if size["chars"] <= BLOCK_WORDS * 5:
        part = rows.toArrow()
        names, texts = part.column("i").combine_chunks(), part.column("p").to_pylist()
        shared = spark.sparkContext.broadcast(texts)  # at most BLOCK_WORDS * 5 characters

        def inline(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = PassageIndex(list(enumerate(shared.value)), run)
            for batch in batches:
                got = batch.column("t").to_pylist()
                for s in range(0, len(got), 500):
                    found = sorted(index.search([words(t) for t in got[s : s + 500]]))
                    if found:
                        who = names.take(pa.array([index.passages[p][0] for _, p in found]))
                        yield pa.RecordBatch.from_arrays([batch.column("k").take(pa.array([s + d for d, _ in found])), who], names=["k", "i"])

        return read.mapInArrow(inline, kinds).distinct().select(F.col("k").alias(key), F.col("i").alias(item))

    numbered = scratch.keep(rows.withColumn("no", F.monotonically_increasing_id()), "passages")
    hashed = scratch.keep(numbered.select("no", F.col("p").alias("t")).mapInArrow(_hashed(None, run), "no bigint, size int, h bigint").distinct(), "passage-hashes")
    sizes = [r["size"] for r in hashed.select("size").distinct().collect()]  # at most ``run``
    texts = scratch.keep(read.withColumn("no", F.monotonically_increasing_id()), "texts")
    own = texts.select("no", "t").mapInArrow(_hashed(sizes, run), "no bigint, size int, h bigint")
    met = own.join(hashed.withColumnRenamed("no", "at"), ["size", "h"]).select("no", "at").distinct()
    both = texts.join(met, "no").join(numbered.select(F.col("no").alias("at"), "i", "p"), "at")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, split = None, []
        for b in batches:
            keep = []
            for r, (no, t, p) in enumerate(zip(b.column("no").to_pylist(), b.column("t").to_pylist(), b.column("p").to_pylist())):
                if no != last:
                    last, split = no, words(t)
                if PassageIndex([(0, p)], run).search([split]):
                    keep.append(r)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("k").take(at), b.column("i").take(at)], names=["k", "i"])

    found = both.select("no", "k", "t", "i", "p").repartition("no", "i").sortWithinPartitions("no").mapInArrow(verify, kinds)
    return found.distinct().select(F.col("k").alias(key), F.col("i").alias(item))
