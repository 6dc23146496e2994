"""Named queries, grouped by subject."""

from __future__ import annotations

import importlib

MODULES = ["events_and_graph", "profiles", "time", "features_and_splits", "metrics", "neighbourhoods", "learning", "operations", "files"]


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"tracewright.plans.{name}")


def queries():
    from tracewright.plans.registry import QUERIES

    _load()
    return dict(QUERIES)


def oracle_sql():
    from tracewright.plans.registry import ORACLES

    _load()
    return dict(ORACLES)
