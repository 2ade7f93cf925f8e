"""Queries by name, each with its oracle text where SQL can state it."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict = {}


def check(sql: str | None = None, name: str | None = None):
    """Register a query; ``sql`` is what DuckDB is asked on the same tables."""

    def register(function):
        key = name or function.__name__
        if key in QUERIES:
            raise ValueError(f"{key} is registered twice")
        QUERIES[key] = function
        if sql is not None:
            ORACLES[key] = sql
        return function

    return register
