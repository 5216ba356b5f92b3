"""Guarded statements: registered queries return all rows, and a bound holds where one is asked for."""

import pytest

from lithoframe.catalogue import relational
from lithoframe.plans import guard

GUARDED = [*relational._SETS, "cte_top_segments", "correlated_average", "window_rank_customers", "running_order_count", "lateral_largest_order", "guarded_join_count", "customers_with_orders"]


@pytest.mark.parametrize("name", GUARDED)
def test_registered_statement_has_no_limit(spark, sf_dir, name):
    plan = relational.QUERIES[name](spark, sf_dir)._jdf.queryExecution().analyzed().toString()
    assert "Limit" not in plan


def test_bound_and_no_bound(spark):
    assert guard.run(spark, "SELECT id FROM range(3000)", max_rows=None).count() == 3000
    assert guard.run(spark, "SELECT id FROM range(3000)", max_rows=10).count() == 11
    assert guard.run(spark, "SELECT id FROM range(3000)").count() == 1001
