"""Registered queries of the core and their SQL."""

from __future__ import annotations

from sextant.plans import attribution, frames, graph, grounding, layers, orphans, printed, retrieval, text

MODULES = [text, retrieval, graph, grounding, attribution, frames, printed, layers, orphans]


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: v for m in MODULES for k, v in m.SQL.items()}
