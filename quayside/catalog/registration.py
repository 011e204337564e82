"""Where queries and their SQL checks are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from quayside.catalog.fixtures import Fixtures, with_views

QUERIES: dict[str, Callable[[Fixtures], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: dict[str, str] | None = None):
    """Register a query function of a :class:`Fixtures`, with its DuckDB check."""

    def register(fn: Callable[[Fixtures], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_views(sql, views)
        return fn

    return register
