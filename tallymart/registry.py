"""Where operators register the query that applies them to the given tables, and its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        if name in QUERIES:
            raise ValueError(f"two queries {name}")
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register
