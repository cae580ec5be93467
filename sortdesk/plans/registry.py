"""Registering queries and their check statements."""

from __future__ import annotations

from collections.abc import Callable


def registry() -> tuple[dict, dict[str, str], Callable]:
    """(queries, checks, decorator that adds a query under a name, with its check if any)"""
    queries: dict = {}
    checks: dict[str, str] = {}

    def register(name: str, sql: str | None = None):
        def add(fn):
            queries[name] = fn
            if sql is not None:
                checks[name] = sql
            return fn
        return add
    return queries, checks, register
