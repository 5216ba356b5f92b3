"""Queries over whole tables return rows for every part of them."""

import duckdb

from lithoframe import catalogue
from lithoframe.operators import profile, retrieval
from lithoframe.sources.scans import table


def test_bm25_ranks_every_item(spark, sf_dir):
    items = {r.item_id for r in table(spark, sf_dir, "benchmark").collect()}
    got = catalogue.queries()["bm25_topk_all"](spark, sf_dir).collect()
    assert len(items) > 5 and {r.query_id for r in got} == items
    assert all(1 <= r.place <= 10 for r in got)


def test_every_row_is_there(spark, sf_dir):
    run = lambda name: catalogue.queries()[name](spark, sf_dir).count()
    size = {n: table(spark, sf_dir, n).count() for n in ("customer", "orders", "events", "nation")}
    for name in ("lateral_largest_order_all", "masked_customers_all", "insert_ignored_customers_all"):
        assert run(name) == size["customer"], name
    assert run("upserted_customers_all") == size["customer"] + size["nation"]
    assert run("synthesized_dates_all") == size["orders"] and run("normalized_cells_all") == size["events"]
    assert run("sla_status_all") == table(spark, sf_dir, "orders").filter("o_orderdate < timestamp '2001-08-01'").count()


def test_names_of_whole_table_queries():
    """A query and its second name are one, with the same SQL: none of them reads a part of its tables."""
    q, sql = catalogue.queries(), catalogue.oracle_sql()
    twice = [n for n in q if n + "_all" in q]
    assert len(twice) == 10 and all(q[n] is q[n + "_all"] and sql[n] == sql[n + "_all"] for n in twice)


def test_slowest_event_among_ties(spark, tmp_path):
    """Events repeated with other ids: of a user's events with the highest value the first in the table, as the SQL gives in one thread."""
    rows = [(10 * copy + k, 1 + k % 3, [5.0, 7.0, 2.0, 9.0, 7.0, None, 9.0][k]) for copy in range(4) for k in range(7)] + [(99, 4, None), (100, 5, float("nan")), (101, 5, 3.0)]
    spark.createDataFrame(rows, "event_id bigint, user_id bigint, value double").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect(config={"threads": 1})
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = con.execute(catalogue.oracle_sql()["slowest_by_user"])
    columns = [c[0] for c in want.description]
    got = catalogue.queries()["slowest_by_user"](spark, str(tmp_path)).select(*columns).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want.fetchall()))


def test_bm25_adds_up_by_document(spark, sf_dir, monkeypatch):
    """Both ways of adding up give the same, with blocks smaller than the copies that tie; the first makes no row for each document and query."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    docs = docs.unionByName(docs.withColumn("doc_id", docs.doc_id + 10_000_000))
    rank = lambda: retrieval.bm25(docs, items, "doc_id", {"text": 1.0}, "item_id", "text")
    found = lambda: sorted((r.query_id, r.place, r.doc_id, round(r.score, 6)) for r in rank().collect())
    monkeypatch.setattr(retrieval, "BLOCK_DOCS", 3)
    held = found()
    assert held and "MapInArrow" in rank()._jdf.queryExecution().toString()
    monkeypatch.setattr(retrieval, "HELD_TERMS", 0)
    assert found() == held


def test_key_values_of_many_columns(spark):
    """Keys as text and as numbers, nulls, more columns than a number has bits; each value is grouped once, without a join."""
    for kind in ("bigint", "string"):
        a = spark.createDataFrame([(k if k else None, k % 4) for k in range(9)], "x_custkey bigint, x_partkey bigint").selectExpr(f"cast(x_custkey as {kind}) x_custkey", "x_partkey")
        b = spark.createDataFrame([(k,) for k in (1, 2, 3, 99, 99)], "y_custkey bigint")
        b = b.selectExpr("y_custkey", *[f"y_custkey + {n} as y_c{n}_key" for n in range(70)])
        sizes, held = retrieval.key_values({"a": a, "b": b}, {"a": a.columns, "b": b.columns})
        size = {(r.table_name, r.column_name): r.distinct_values for r in sizes.collect()}
        assert size["a", "x_custkey"] == 8 and size["a", "x_partkey"] == 4 and size["b", "y_c69_key"] == 4 and len(size) == 73
        assert {tuple(r) for r in held.collect()} == {("a", "x_custkey", "b", "y_custkey", 3 / 8), ("b", "y_custkey", "a", "x_custkey", 3 / 4)}


def test_distinct_counts_deal_rows_first(spark):
    """One task reads a whole row group: its rows are dealt before its values are held."""
    df = spark.range(1000).selectExpr("id", "cast(id % 7 as string) as few", "if(id % 2 = 0, null, id) as some").coalesce(1)
    got = profile.column_stats(df)
    assert {r.column_name: r.distinct_values for r in got.collect()} == {"id": 1000, "few": 7, "some": 500}
    assert "RepartitionByExpression" in got._jdf.queryExecution().analyzed().toString()
