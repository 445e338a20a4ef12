"""All registered queries and the SQL that must give the same rows."""

from __future__ import annotations

import importlib

MODULES = ["q_sources", "q_rows", "q_ranking", "q_nested", "q_learning", "q_streams"]


def registries():
    return [importlib.import_module(f"vitrine.plans.{m}").R for m in MODULES]


def queries() -> dict:
    return {name: fn for r in registries() for name, fn in r.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for r in registries() for name, sql in r.sql.items()}
