"""Every operator as a query over the given tables, with SQL to check it by."""

from __future__ import annotations

from importlib import import_module

MODULES = ("preparation", "evaluation", "profiles", "looks", "boxes", "sets", "files", "fitting")


def queries() -> dict:
    return {name: query for m in MODULES for name, query in import_module(f"tallyforge.queries.{m}").QUERIES.items()}


def oracles() -> dict:
    return {name: sql for m in MODULES for name, sql in import_module(f"tallyforge.queries.{m}").ORACLES.items()}
