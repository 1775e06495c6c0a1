"""Reward composition and the hooks for user functions."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def composite(weights: dict[str, float]) -> Column:
    """Weighted sum of reward columns; a null component counts as 0."""
    total = F.lit(0.0)
    for name, w in weights.items():
        total = total + w * F.coalesce(F.col(name), F.lit(0.0))
    return total


def external_reward(fn: Callable[[pd.Series], pd.Series]) -> Callable[[Column], Column]:
    """Any function of a batch of SIDs as a vectorised reward."""

    def run(batch: pd.Series) -> pd.Series:
        return fn(batch).astype("float64")

    return F.pandas_udf(run, "double")


class HttpError(Exception):
    """What a fetcher raises for a status code."""

    def __init__(self, code: int):
        super().__init__(str(code))
        self.code = code


def fetch_images(urls: DataFrame, column: str, prefix: str, fetch: Callable[[str], bytes], stored: Callable[[str], int | None], put: Callable[[str, bytes], None], max_bytes: int) -> DataFrame:
    """(image, path, status, size_bytes) of every url, one partition at a time.

    ``stored`` gives the size of an object that is there already, ``fetch`` the
    body of a url, ``put`` keeps it under its key (two hex digits and the MD5 of
    the url). status is empty, cached, ok, too_large, empty_body, timeout,
    http_N or error_X; only cached and ok have a path. An error of one url
    doesn't end the others.
    """

    def one(url: str | None) -> tuple:
        if not url:
            return url, None, "empty", None
        h = hashlib.md5(url.encode(), usedforsecurity=False).hexdigest()
        path = f"{prefix}/{h[:2]}/{h}.jpg"
        try:
            size = stored(path)
            if size is not None:
                return url, path, "cached", size
            body = fetch(url)
            if len(body) > max_bytes:
                return url, None, "too_large", len(body)
            if not body:
                return url, None, "empty_body", 0
            put(path, body)
            return url, path, "ok", len(body)
        except TimeoutError:
            return url, None, "timeout", None
        except HttpError as e:
            return url, None, f"http_{e.code}", None
        except Exception as e:  # noqa: BLE001
            return url, None, f"error_{type(e).__name__}", None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [one(u) for u in b.column("image").to_pylist()]
            kinds = (pa.string(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["image", "path", "status", "size_bytes"])

    return urls.select(F.col(column).alias("image")).mapInArrow(run, "image string, path string, status string, size_bytes bigint")
