"""Where queries and their SQL are collected."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Callable], Callable]:
    """Registers a function of (spark, sf_dir) under its name, with its SQL for DuckDB if there is one."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add
