"""Queries over the test tables, each with its oracle SQL."""

from __future__ import annotations

from . import io_queries, math_queries
from . import queries as _own

MODULES: list = [_own, io_queries, math_queries]


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
