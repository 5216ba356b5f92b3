"""Named queries over the test tables, one or more for each operator, with equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import analytics, datasets, governance, operations, profiling, relational, reports, retrieval

_PARTS = (relational, profiling, datasets, analytics, retrieval, operations, reports, governance)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q for part in _PARTS for name, q in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in _PARTS for name, sql in part.SQL.items()}
