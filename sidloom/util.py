"""Small helpers shared by all operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Blanks that may surround an id or a code (fixed value).
BLANKS = " \t\r\n"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def item_key(col: Column | str) -> Column:
    """The form in which item ids are compared: lower case, no blanks around."""
    c = F.col(col) if isinstance(col, str) else col
    return F.lower(F.btrim(c, F.lit(BLANKS)))


def first_column(df: DataFrame, candidates: list[str]) -> str:
    """The first of ``candidates`` that ``df`` has."""
    for c in candidates:
        if c in df.columns:
            return c
    raise ValueError(f"none of {candidates} in {df.columns}")
