"""Documents packed into training windows of fixed length by first-fit decreasing.

Lengths are counted in tokens of a public tokenizer, once, and kept. Documents
are dealt by a hash of their key and text, however they are partitioned, into groups of about GROUP_TOKENS tokens; each group is
packed on its own, so packing is one shuffle of (document, length) rows and no
task sees more than a group. Inside a group a tournament tree over the room
left in each window finds the first window that fits in logarithmic time.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import scratch

WINDOW = 2048
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the byte-level tokenizer cuts text before merging (fixed value of the public vocabulary).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Mean tokens of a group: 2,000 windows, of which at most the last few are badly filled.
GROUP_TOKENS = 2000 * WINDOW
#: Characters handed to the tokenizer at once; a longer text is cut at a blank before a letter, where no token reaches across.
PART = 1_000_000
#: Equal rows that one row stands for while they are numbered.
COPIES = 100_000


@lru_cache(maxsize=2)
def encoder(vocabulary: str):
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(text: str, vocabulary: str = VOCABULARY) -> int:
    """Tokens of the whole text."""
    enc, n, start = encoder(vocabulary), 0, 0
    while len(text) - start > PART:
        cut = start + PART
        while cut < len(text) - 1 and not (text[cut] == " " and text[cut + 1].isalpha() and not text[cut - 1].isspace()):
            cut += 1
        n += len(enc.encode_ordinary(text[start:cut]))
        start = cut
    return n + len(enc.encode_ordinary(text[start:]))


def token_lengths(docs: DataFrame, key: str, text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """(row_no, key, n_tokens) of each row; null and empty texts have 0 tokens.

    row_no follows from key, text and a number among equal rows, not from the
    partition that a row is in.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [count_tokens(t, vocabulary) if t else 0 for t in b.column("t").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("h"), b.column("key"), pa.array(n, pa.int64())], names=["h", "key", "n_tokens"])

    rows = docs.select(F.xxhash64(key, text).alias("h"), F.col(key).alias("key"), F.col(text).alias("t"))
    read = rows.mapInArrow(run, f"h bigint, key {docs.schema[key].dataType.simpleString()}, n_tokens bigint")
    same = read.groupBy("key", "h", "n_tokens").agg(F.count(F.lit(1)).alias("c"))
    blocks = same.withColumn("b", F.explode(F.expr(f"sequence(0L, (c - 1) div {COPIES})")))  # no row grows with the copies of a text
    copies = blocks.withColumn("copy", F.explode(F.expr(f"sequence(b * {COPIES}, least(c, (b + 1) * {COPIES}) - 1)")))
    return copies.select(F.xxhash64("h", "copy").alias("row_no"), "key", "n_tokens")


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of every item; items are taken in the order given and go to the first bin with room.

    The tree's leaves are bins, each inner node holds the most room below it.
    No more bins are needed than items, so it starts small and doubles.
    """
    width = 1
    tree = [0, capacity]
    used = 0
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    for k, size in enumerate(sizes.tolist()):
        if tree[1] < size:  # no bin has room: double the leaves
            rooms = tree[width:] + [capacity] * width
            width *= 2
            tree = [0] * width + rooms
            for i in range(width - 1, 0, -1):
                tree[i] = max(tree[2 * i], tree[2 * i + 1])
        i = 1
        while i < width:
            i *= 2
            if tree[i] < size:
                i += 1
        bins[k], offsets[k] = i - width, capacity - tree[i]
        used = max(used, i - width + 1)
        tree[i] -= size
        i //= 2
        while i:
            most = tree[2 * i] if tree[2 * i] >= tree[2 * i + 1] else tree[2 * i + 1]
            if tree[i] == most:
                break
            tree[i] = most
            i //= 2
    return bins, offsets


def pack(lengths: DataFrame, window: int = WINDOW, group_tokens: int = GROUP_TOKENS, seed: int = 7) -> DataFrame:
    """(key, row_no, piece, start, n_tokens, window_id, place): where each text goes.

    ``lengths`` is a kept table as of ``token_lengths``. A text longer than a
    window is cut into full windows and a rest; no other text is cut. place is
    the position of the piece in its window. A text without tokens has one row
    with n_tokens 0 and null window and place. Repeated rows are packed each,
    told apart by row_no.
    """
    total = lengths.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n")).first()["n"]
    groups = max(1, -(-total // group_tokens))
    kind = lengths.schema["key"].dataType.simpleString()

    def run(key, part):
        no = part.column("row_no").to_numpy()
        n = part.column("n_tokens").to_numpy()
        full, rest = n // window, n % window
        items = np.flatnonzero(rest)
        items = items[np.lexsort((no[items], -rest[items]))]
        bins, offsets = first_fit_decreasing(rest[items], window)
        opened = int(bins.max()) + 1 if len(bins) else 0
        rows = np.repeat(np.arange(len(n)), full)
        piece = np.arange(len(rows)) - np.repeat(np.cumsum(full) - full, full)
        base = key[0].as_py() << 32
        who = np.r_[rows, items]
        return pa.table(
            {
                "key": part.column("key").take(pa.array(who)),
                "row_no": no[who],
                "piece": np.r_[piece, full[items]].astype(np.int32),
                "start": np.r_[piece * window, full[items] * window],
                "n_tokens": np.r_[np.full(len(rows), window), rest[items]].astype(np.int32),
                "window_id": base + np.r_[opened + np.arange(len(rows)), bins],
                "place": np.r_[np.zeros(len(rows), np.int64), offsets].astype(np.int32),
            }
        )

    dealt = lengths.where("n_tokens > 0").withColumn("g", F.pmod(F.xxhash64("row_no", F.lit(seed)), F.lit(groups)))
    schema = f"key {kind}, row_no bigint, piece int, start bigint, n_tokens int, window_id bigint, place int"
    packed = dealt.groupBy("g").applyInArrow(run, schema)
    none = lengths.where("n_tokens = 0").selectExpr("key", "row_no", "0 AS piece", "0L AS start", "0 AS n_tokens", "CAST(NULL AS bigint) AS window_id", "CAST(NULL AS int) AS place")
    return packed.unionByName(none)


def pack_documents(docs: DataFrame, key: str, text: str, vocabulary: str = VOCABULARY, window: int = WINDOW) -> DataFrame:
    return pack(scratch.keep(token_lengths(docs, key, text, vocabulary), "lengths"), window)
