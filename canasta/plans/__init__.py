"""Registered queries: each module of this package adds named plans and their oracle SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Registers a function (spark, sf_dir) -> DataFrame and the DuckDB SQL for the same rows."""

    def add(f: Callable) -> Callable:
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def literal(v) -> str:
    return "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v)


def values(rows, names: str) -> str:
    """SQL for fixed rows."""
    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows) + f") t({names})"


for _module in ("offers", "states", "history", "search", "unit_prices", "matching", "baskets", "reports", "control", "catalog", "landed", "read_models"):
    importlib.import_module(f"{__name__}.{_module}")
