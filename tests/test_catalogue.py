"""Every registered query against its SQL in DuckDB, on the same parquet tables."""

import math
from decimal import Decimal

import duckdb
import pytest

import __spark_entry__ as entry
from lithoframe import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (int, float, Decimal)):
        return None if math.isnan(v) else float(f"{float(v):.9g}")
    if hasattr(v, "isoformat"):
        return v.isoformat().replace("T00:00:00", "")
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query_equals_sql(spark, duck, sf_dir, name):
    df = catalogue.queries()[name](spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    if sql := catalogue.oracle_sql().get(name):
        result = duck.execute(sql)
        columns = [c[0] for c in result.description]
        assert sorted(columns) == sorted(df.columns)
        assert got == rows_of(columns, result.fetchall())
    else:
        assert got == rows_of(df.columns, catalogue.queries()[name](spark, sf_dir).collect())  # the same rows each time


def test_entry_has_rows(spark):
    assert entry.entry(spark).take(1)


def test_queries_have_distinct_names():
    assert set(catalogue.oracle_sql()) <= set(catalogue.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
