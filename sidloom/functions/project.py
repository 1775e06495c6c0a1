"""Projections of content tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def full_text(title: Column, body: Column, limit: int = 4096) -> Column:
    """Title, line break and body, or the body alone where there is no title; its first ``limit`` characters."""
    return F.substring(F.when(title.isNull() | (title == ""), body).otherwise(F.concat(title, F.lit("\n"), body)), 1, limit)


def first_image(cover: Column, *others: Column) -> Column:
    return F.coalesce(F.nullif(cover, F.lit("")), *others)


def image_list(df: DataFrame, column: str) -> Column:
    """null to [], a string to [string], an array to its non-empty elements."""
    c = F.col(column)
    if isinstance(df.schema[column].dataType, T.ArrayType):
        return F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != ""))
    return F.when(c.isNull() | (c == ""), F.array().cast("array<string>")).otherwise(F.array(c))
