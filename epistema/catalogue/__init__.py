"""Queries over the driver's tables, one or more for each operator, with DuckDB SQL for those it can express."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    def add(f: Callable) -> Callable:
        QUERIES[key] = f
        if sql is not None:
            SQL[key] = sql
        return f

    return add


def every() -> tuple[dict[str, Callable], dict[str, str]]:
    from epistema.catalogue import core, kept, recalled, relations, search  # noqa: F401

    return QUERIES, SQL
