"""All registered queries."""

from __future__ import annotations

import importlib
import pkgutil

import tandem.plans as plans
from tandem.plans.registry import ORACLES, QUERIES

_NOT_QUERIES = {"catalog", "registry", "feeds"}


def _load() -> None:
    for mod in sorted(m.name for m in pkgutil.iter_modules(plans.__path__)):
        if mod not in _NOT_QUERIES:
            importlib.import_module(f"tandem.plans.{mod}")


def queries():
    _load()
    return dict(QUERIES)


def oracle_sql():
    _load()
    return dict(ORACLES)
