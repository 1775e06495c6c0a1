"""Line rules over texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def scan_rules(docs: DataFrame, key: str, text: str, rules: list[tuple[str, str]]) -> DataFrame:
    """(key, rule, lines): how many lines of a text match each named pattern; the rules stay in the plan."""
    lines = docs.where(F.col(text).isNotNull()).select(key, F.explode(F.split(text, "\n")).alias("line"))
    hits = lines.select(key, F.explode(F.filter(F.array(*[F.when(F.col("line").rlike(p), n) for n, p in rules]), lambda x: x.isNotNull())).alias("rule"))
    return hits.groupBy(key, "rule").agg(F.count(F.lit(1)).alias("lines"))


def consistency(docs: DataFrame, key: str, text: str, token: str, values: list[str]) -> DataFrame:
    """Keys of texts with a line that has the token and all values."""
    lines = F.split(text, "\n")
    good = F.exists(lines, lambda line: F.contains(line, F.lit(token)) & F.forall(F.array(*[F.lit(v) for v in values]), lambda v: F.contains(line, v)))
    return docs.where(good).select(key)
