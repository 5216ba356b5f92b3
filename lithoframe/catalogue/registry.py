"""Registration of queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def __call__(self, sql: str | None = None, also: str | None = None) -> Callable[[Query], Query]:
        def add(query: Query) -> Query:
            for name in filter(None, (query.__name__, also)):  # ``also``: a second name
                self.queries[name] = query
                if sql is not None:
                    self.sql[name] = sql
            return query

        return add
