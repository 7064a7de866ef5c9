"""Registered queries over the given tables, each with its SQL counterpart."""

from __future__ import annotations

from caseload.workload import (
    columns,
    forecasting,
    ingest,
    memoised,
    reporting,
    screening,
    staffing,
    summaries,
)

MODULES = (
    ingest, columns, summaries, forecasting, memoised, staffing, reporting, screening,
)


def all_queries():
    """Query name to ``(callable, SQL or None)``."""
    registered = {}
    for module in MODULES:
        clash = registered.keys() & module.QUERIES.keys()
        if clash:
            raise ValueError(f"registered twice: {sorted(clash)}")
        registered.update(module.QUERIES)
    return registered
