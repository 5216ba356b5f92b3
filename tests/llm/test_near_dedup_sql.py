"""The SQL of op1 against the operator."""

import duckdb

from lithoframe.llm import queries as q


def test_near_dedup_equals_its_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = con.execute(q.SQL["op1_near_dedup"])
    columns = [c[0] for c in want.description]
    assert sorted(tuple(r) for r in q.op1_near_dedup(spark, sf_dir).select(*columns).collect()) == sorted(want.fetchall())
