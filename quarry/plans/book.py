"""Where queries and their SQL are entered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def add(name: str, query: Query, sql: str | None = None, *ctes: str) -> None:
    """Enter a query; its SQL may stand on common tables."""
    QUERIES[name] = query
    if sql:
        ORACLE[name] = f"WITH {', '.join(ctes)} {sql}" if ctes else sql
