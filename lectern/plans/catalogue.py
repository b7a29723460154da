"""All registered queries with their SQL."""

from __future__ import annotations

import importlib

FAMILIES = ("text", "screening", "timelines", "matches", "flows", "files")


def _modules():
    return [importlib.import_module(f"lectern.plans.{name}") for name in FAMILIES]


def queries() -> dict:
    return {name: f for m in _modules() for name, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: q for m in _modules() for name, q in m.SQL.items()}
