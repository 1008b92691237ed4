"""Every operator as a query over the given tables."""

from __future__ import annotations

import importlib

_MODULES = ("scalars", "metadata", "splits", "pools", "evaluation", "learning", "pictures", "tables", "deploy")


def load():
    """(queries, SQL) of all modules."""
    from stackpool.queries.registry import ORACLES, QUERIES
    for name in _MODULES:
        importlib.import_module(f"stackpool.queries.{name}")
    return QUERIES, ORACLES
