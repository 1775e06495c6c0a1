"""All queries of the engine and their SQL oracles, by name."""

from __future__ import annotations

from . import extras, functions, general, measures, pipelines, recall, relations, scans

_MODULES = [general, scans, relations, functions, measures, pipelines, recall, extras]

QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in _MODULES for k, s in m.SQL.items()}
