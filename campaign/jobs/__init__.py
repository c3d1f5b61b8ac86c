"""Registered jobs: each operator applied to the given tables, with its SQL."""

from __future__ import annotations

import importlib

MODULES = ["tasks", "history", "scalars", "tables", "accounting", "grids", "text", "streams", "files"]


def registry() -> tuple[dict, dict]:
    """All job callables and all oracle statements, by name."""
    queries: dict = {}
    oracles: dict = {}
    for name in MODULES:
        module = importlib.import_module(f"{__name__}.{name}")
        queries |= module.QUERIES
        oracles |= module.ORACLES
    return queries, oracles
