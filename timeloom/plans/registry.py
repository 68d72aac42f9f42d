"""How a module of queries lists them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def registry() -> tuple[dict[str, Query], dict[str, str], Callable[..., Callable[[Query], Query]]]:
    """Queries by name, their SQL, and the decorator that fills both."""
    queries: dict[str, Query] = {}
    sql: dict[str, str] = {}

    def query(statement: str | None = None) -> Callable[[Query], Query]:
        def put(f: Query) -> Query:
            queries[f.__name__] = f
            if statement is not None:
                sql[f.__name__] = statement
            return f

        return put

    return queries, sql, query
