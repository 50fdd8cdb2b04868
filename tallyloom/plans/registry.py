"""All queries by name, with their SQL twins."""

from __future__ import annotations

import importlib
from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}

#: Modules that register queries when they are imported.
MODULES = ("ledger", "joining", "windows", "intervals", "graphs", "imports", "taint", "evaluation", "text", "states", "files", "trees", "workplan", "reuse", "review", "assessment")


def query(name: str, sql: str | None = None):
    """Registers (spark, sf_dir) -> DataFrame under name, with the SQL that says the same."""

    def put(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return put


for _module in MODULES:
    importlib.import_module(f"tallyloom.plans.{_module}")
