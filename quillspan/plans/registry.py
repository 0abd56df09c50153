"""Named queries over the driver's tables, and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    """Put a query, and its SQL if it has one, into the registry."""

    def put(query):
        QUERIES[name] = query
        if oracle is not None:
            ORACLES[name] = oracle
        return query

    return put
