"""Queries with their SQL, collected by area."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Names to (query, SQL or None)."""

    def __init__(self) -> None:
        self.entries: dict[str, tuple[Query, str | None]] = {}

    def add(self, sql: str | None = None) -> Callable[[Query], Query]:
        def put(query: Query) -> Query:
            self.entries[query.__name__] = (query, sql)
            return query

        return put


def literal(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("'", "''") + "'"
