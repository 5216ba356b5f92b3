"""Comparison, drift, forecast and insights."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from ..functions.calendar import comparison_periods, preceding_period
from ..operators import analytics as o
from ..sources.scans import table
from .registry import Registry

add = Registry()
QUERIES, SQL = add.queries, add.sql
TODAY = date(2001, 5, 17)
_CHANGE = "round(cur, 2) AS current_value, round(prev, 2) AS previous_value, round(cur - prev, 2) AS absolute_change, round(100 * (cur - prev) / abs(prev), 2) AS percentage_change, CASE WHEN cur > prev THEN 'up' WHEN cur < prev THEN 'down' ELSE 'flat' END AS direction"


def _compare(name: str, current: tuple[date, date], previous: tuple[date, date]) -> None:
    between = lambda p: f"o_orderdate >= TIMESTAMP '{p[0]}' AND o_orderdate < TIMESTAMP '{p[1]}' + INTERVAL 1 DAY"

    def query(spark, d):
        out = o.compare_periods(table(spark, d, "orders"), F.col("o_orderdate"), F.col("o_totalprice"), current, previous)
        return out.select(*[F.round(c, 2).alias(c) for c in ("current_value", "previous_value", "absolute_change", "percentage_change")], "direction")

    query.__name__ = name
    add(f"SELECT {_CHANGE} FROM (SELECT sum(o_totalprice) FILTER ({between(current)}) AS cur, sum(o_totalprice) FILTER ({between(previous)}) AS prev FROM orders)")(query)


for _kind, _name in (("month_over_month", "mom"), ("quarter_over_quarter", "qoq"), ("year_over_year", "yoy")):
    _compare(f"{_name}_elapsed_matched", *comparison_periods(_kind, TODAY))
_compare("prev_equal_period", (date(2001, 3, 1), date(2001, 4, 14)), preceding_period(date(2001, 3, 1), date(2001, 4, 14)))


@add("SELECT o_orderpriority, cur, prev, pct, dir FROM (SELECT o_orderpriority, count(*) FILTER (year(o_orderdate) = 2000) AS cur, count(*) FILTER (year(o_orderdate) = 1900) AS prev FROM orders GROUP BY 1), LATERAL (SELECT CASE WHEN prev = 0 AND cur = 0 THEN 0.0 END AS pct, CASE WHEN cur > prev THEN 'up' ELSE 'flat' END AS dir)")
def change_from_zero(spark, d):
    g = table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count_if(F.year("o_orderdate") == 2000).alias("cur"), F.count_if(F.year("o_orderdate") == 1900).alias("prev"))
    percent, direction, _ = o.change(F.col("cur").cast("double"), F.col("prev").cast("double"))
    return g.select("o_orderpriority", "cur", "prev", percent.alias("pct"), direction.alias("dir"))


_MONTHS = "SELECT o_orderpriority AS metric, strftime(o_orderdate, '%Y-%m') AS taken, CAST(sum(CASE WHEN o_orderpriority = '1-URGENT' AND o_orderdate >= TIMESTAMP '2001-07-01' THEN 3 ELSE 1 END) AS DOUBLE) AS v FROM orders WHERE o_orderdate < TIMESTAMP '2001-08-01' GROUP BY 1, 2"


@add(f"WITH s AS ({_MONTHS}), m AS (SELECT metric, max(taken) AS newest FROM s GROUP BY 1), x AS (SELECT s.metric, max(v) FILTER (taken = newest) AS latest, avg(v) FILTER (taken < newest) AS baseline, count(*) FILTER (taken < newest) AS n_before FROM s JOIN m ON s.metric = m.metric GROUP BY 1), y AS (SELECT *, 100 * (latest - baseline) / abs(baseline) AS p FROM x WHERE n_before >= 3) SELECT metric, latest, round(baseline, 6) AS baseline, n_before, round(p, 6) AS drift_percent, CASE WHEN abs(p) >= 40 THEN 'high' WHEN abs(p) >= 20 THEN 'medium' ELSE 'low' END AS level FROM y WHERE abs(p) >= 10 ORDER BY abs(p) DESC, metric LIMIT 8")
def drift_vs_baseline(spark, d):
    hot = (F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderdate") >= "2001-07-01")
    s = table(spark, d, "orders").filter("o_orderdate < timestamp '2001-08-01'").groupBy(F.col("o_orderpriority").alias("metric"), F.date_format("o_orderdate", "yyyy-MM").alias("taken")).agg(F.sum(F.when(hot, 3).otherwise(1)).cast("double").alias("v"))
    return o.drift(s, "metric", "taken", "v").select("metric", "latest", F.round("baseline", 6).alias("baseline"), "n_before", F.round("drift_percent", 6).alias("drift_percent"), "level")


@add("WITH s AS (SELECT CAST(row_number() OVER (ORDER BY m) - 1 AS DOUBLE) AS x, CAST(n AS DOUBLE) AS y FROM (SELECT strftime(o_orderdate, '%Y-%m') AS m, count(*) AS n FROM orders GROUP BY 1)), f AS (SELECT count(*) AS n, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM s), r AS (SELECT stddev_pop(y - a - b * x) AS band FROM s, f) SELECT CAST(g AS INTEGER) AS step, round(greatest(0, a + b * (n - 1 + g)), 4) AS estimate, round(greatest(0, a + b * (n - 1 + g) - band), 4) AS low, round(greatest(0, a + b * (n - 1 + g) + band), 4) AS high FROM f, r, generate_series(1, 3) t(g) WHERE n >= 6 AND g <= least(3, greatest(1, n // 4))")
def forecast_monthly(spark, d):
    s = table(spark, d, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("m")).agg(F.count(F.lit(1)).alias("n"))
    return o.forecast(s, "m", "n").select("step", *[F.round(c, 4).alias(c) for c in ("estimate", "low", "high")])


@add("WITH g AS (SELECT c_mktsegment AS s, count(*) AS n FROM customer GROUP BY 1), e AS (SELECT max(n) AS hi, min(n) AS lo, sum(n) AS t FROM g) SELECT 'highest' AS kind, string_agg(s, ',' ORDER BY s) AS labels, CAST(max(n) AS DOUBLE) AS value FROM g, e WHERE n = hi UNION ALL SELECT 'lowest', string_agg(s, ',' ORDER BY s), CAST(max(n) AS DOUBLE) FROM g, e WHERE n = lo UNION ALL (SELECT 'top_gap', s, CAST(gap AS DOUBLE) FROM (SELECT s, n, n - lead(n) OVER (ORDER BY n DESC, s) AS gap FROM g ORDER BY n DESC, s LIMIT 1)) UNION ALL SELECT 'top_share', min(s), round(max(100.0 * n / t), 6) FROM g, e WHERE n = hi")
def category_insights(spark, d):
    g = table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("s")).agg(F.count(F.lit(1)).alias("n"))
    return o.category_insights(g, "s", "n").withColumn("value", F.when(F.col("kind") == "top_share", F.round("value", 6)).otherwise(F.col("value")))
