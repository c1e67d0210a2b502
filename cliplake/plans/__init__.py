"""Queries over the driver's tables, one or more per operator of the inventory."""

from __future__ import annotations

import importlib
import pkgutil

from cliplake.plans.registry import ORACLE, QUERIES


def _load() -> None:
    for module in sorted(m.name for m in pkgutil.iter_modules(__path__)):
        if module.startswith("queries_"):
            importlib.import_module(f"{__name__}.{module}")


def all_queries():
    _load()
    return dict(QUERIES)


def all_oracles():
    _load()
    return dict(ORACLE)
