"""Named metrics over the tables of a run, with what each needs, and a report of all.

``METRICS`` is the registry; ``register`` adds to it. ``evaluate`` computes the
metrics asked for, one after another: one whose tables are missing is skipped,
one that fails is reported with its error, and the others go on.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import metrics as m
from .operators.spectrum import effective_dim


@dataclass(frozen=True)
class Inputs:
    """vectors (id, v), sids (content_id, sid, a, b, c), behavior (uid, iid), impressions (session rows); any may be missing."""

    vectors: DataFrame | None = None
    sids: DataFrame | None = None
    behavior: DataFrame | None = None
    impressions: DataFrame | None = None


@dataclass(frozen=True)
class Metric:
    """``compute`` gives a value, or null; ``steps`` are the bounds of excellent, good and acceptable."""

    name: str
    compute: Callable[[Inputs], float | None]
    needs: tuple[str, ...]
    steps: tuple[float, float, float] | None = None
    lower_is_better: bool = True

    def status(self, value: float | None) -> str:
        if value is None or self.steps is None:
            return "unknown"
        for name, step in zip(("excellent", "good", "acceptable"), self.steps):
            if value <= step if self.lower_is_better else value >= step:
                return name
        return "poor"


METRICS: dict[str, Metric] = {}


def register(metric: Metric) -> Metric:
    METRICS[metric.name] = metric
    return metric


def _one(df: DataFrame, column: str) -> float | None:
    row = df.select(column).first()
    return None if row is None or row[0] is None else float(row[0])


# Bounds of quality are fixed values.
register(Metric("collision_rate", lambda i: _one(m.collision(i.sids), "collision_rate"), ("sids",), (0.05, 0.15, 0.30)))
register(Metric("codebook_utilization", lambda i: _one(m.codebook_utilization(i.sids).agg(F.avg("utilization").alias("u")), "u"), ("sids",), (0.9, 0.7, 0.5), False))
register(Metric("entropy", lambda i: _one(m.entropy(i.sids).agg(F.avg(F.col("bits") / F.log2(F.nullif("n_total", F.lit(1)))).alias("e")), "e"), ("sids",), (0.9, 0.8, 0.7), False))
register(Metric("gini", lambda i: _one(m.gini(i.sids).agg(F.avg("gini").alias("g")), "g"), ("sids",), (0.3, 0.5, 0.7)))
register(Metric("effective_dim", lambda i: _one(effective_dim(i.vectors, "v").select((F.col("d95") / F.col("dim")).alias("share")), "share"), ("vectors",), (0.7, 0.5, 0.3), False))
register(Metric("user_semantic_consistency", lambda i: _one(m.user_consistency(i.behavior, i.sids), "lift"), ("sids", "behavior"), (1.3, 1.2, 1.1), False))
register(Metric("semantic_neighbor_hit_rate", lambda i: _one(m.neighbor_hit_rate(i.behavior, i.sids), "hit_rate"), ("sids", "behavior"), (0.15, 0.10, 0.05), False))


def evaluate(inputs: Inputs, names: list[str]) -> DataFrame:
    """(metric, value, status, note) in the order of ``names``; note says why there is no value."""
    given = [t for t in (inputs.vectors, inputs.sids, inputs.behavior, inputs.impressions) if t is not None]
    if not given:
        raise ValueError("no table to evaluate")
    rows = []
    for name in names:
        metric = METRICS.get(name)
        missing = [n for n in metric.needs if getattr(inputs, n) is None] if metric else []
        if metric is None:
            rows.append((name, None, "skipped", "unknown metric"))
        elif missing:
            rows.append((name, None, "skipped", f"needs {', '.join(missing)}"))
        else:
            try:
                value = metric.compute(inputs)
                rows.append((name, value, metric.status(value), None))
            except Exception as e:  # noqa: BLE001 - one metric must not end the report
                rows.append((name, None, "error", f"{type(e).__name__}: {str(e).splitlines()[0][:200] if str(e) else ''}"))
    return given[0].sparkSession.createDataFrame(rows, "metric string, value double, status string, note string")


def markdown(report: DataFrame, title: str = "Metrics") -> str:
    """The report as text, with a summary of how many metrics have each status; a row per metric."""
    rows = report.collect()
    counts: dict[str, int] = {}
    for r in rows:
        counts[r["status"]] = counts.get(r["status"], 0) + 1
    lines = [f"# {title}", "", "| Metric | Value | Status | Note |", "| --- | --- | --- | --- |"]
    lines += [f"| {r['metric']} | {'' if r['value'] is None else format(r['value'], '.4f')} | {r['status']} | {r['note'] or ''} |" for r in rows]
    return "\n".join([*lines, "", "Summary: " + ", ".join(f"{n} {s}" for s, n in sorted(counts.items()))]) + "\n"
