"""Every query of the trace engine with its SQL."""

from __future__ import annotations

from wirespan.plans import content, spend, traces

_MODULES = (spend, content, traces)


def queries() -> dict:
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.SQL.items()}
