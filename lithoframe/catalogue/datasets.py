"""Uploaded-dataset operators over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dataset as o
from ..sources.scans import table
from .registry import Registry
from .relational import sales

add = Registry()
QUERIES, SQL = add.queries, add.sql
_NUM = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
_SALES = "lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"


def _union(columns, each: str) -> str:
    return " UNION ALL ".join(each.format(c=c) for c in columns)


@add(_union(_NUM, "SELECT '{c}' AS column_name, count(*) AS n_rows, min({c}) AS min_value, max({c}) AS max_value, round(avg({c}), 6) AS mean_value, round(stddev_samp({c}), 6) AS std_value, round(quantile_cont({c}, 0.5), 6) AS median_value, round(quantile_cont({c}, 0.9), 6) AS p90, count(*) - count({c}) AS null_count, count(*) FILTER ({c} = 0) AS zero_count, count(*) FILTER ({c} < 0) AS negative_count FROM lineitem"))
def upload_numeric_profile(spark, d):
    r = lambda c: F.round(c, 6).alias(c)
    return o.numeric_profile(table(spark, d, "lineitem"), list(_NUM)).select("column_name", "n_rows", "min_value", "max_value", r("mean_value"), r("std_value"), r("median_value"), r("p90"), "null_count", "zero_count", "negative_count")


@add("SELECT column_name, round(q1 - 1.5 * (q3 - q1), 4) AS low, round(q3 + 1.5 * (q3 - q1), 4) AS high, n AS outliers FROM (" + _union(("c_acctbal",), "SELECT '{c}' AS column_name, q1, q3, count(*) FILTER ({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) AS n FROM customer, (SELECT round(quantile_cont({c}, 0.25), 4) AS q1, round(quantile_cont({c}, 0.75), 4) AS q3 FROM customer) GROUP BY ALL") + " UNION ALL SELECT 'l_extendedprice', q1, q3, count(*) FILTER (l_extendedprice < q1 - 1.5 * (q3 - q1) OR l_extendedprice > q3 + 1.5 * (q3 - q1)) FROM lineitem, (SELECT round(quantile_cont(l_extendedprice, 0.25), 4) AS q1, round(quantile_cont(l_extendedprice, 0.75), 4) AS q3 FROM lineitem) GROUP BY ALL)")
def iqr_outliers(spark, d):
    both = o.iqr_outliers(table(spark, d, "customer"), ["c_acctbal"]).unionByName(o.iqr_outliers(table(spark, d, "lineitem"), ["l_extendedprice"]))
    return both.select("column_name", F.round("low", 4).alias("low"), F.round("high", 4).alias("high"), "outliers")


@add(_union(("o_orderstatus", "o_orderpriority"), "SELECT '{c}' AS column_name, count(*) AS unique_values, round(max(n) / sum(n), 6) AS top_share, round(-sum((n / t) * ln(n / t)), 6) AS entropy FROM (SELECT {c}, count(*) AS n, sum(count(*)) OVER () AS t FROM orders GROUP BY {c})"))
def entropy_by_column(spark, d):
    return o.categorical_profile(table(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"]).select("column_name", "unique_values", F.round("top_share", 6).alias("top_share"), F.round("entropy", 6).alias("entropy"))


_PAIRS = [(a, b) for k, a in enumerate(_NUM) for b in _NUM[k + 1 :]]


@add("SELECT column_a, column_b, round(r, 6) AS r, CASE WHEN abs(r) >= 0.7 THEN 'strong' WHEN abs(r) >= 0.4 THEN 'moderate' ELSE 'weak' END AS strength FROM (" + " UNION ALL ".join(f"SELECT '{a}' AS column_a, '{b}' AS column_b, corr({a}, {b}) AS r FROM lineitem" for a, b in _PAIRS) + ")")
def correlation_pairs(spark, d):
    return o.correlations(table(spark, d, "lineitem"), list(_NUM)).withColumn("r", F.round("r", 6))


@add("SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders GROUP BY 1 ORDER BY 1 LIMIT 24")
def monthly_counts(spark, d):
    return o.monthly_counts(table(spark, d, "orders"), "o_orderdate")


@add("WITH x AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders), g AS (SELECT date_diff('day', lag(d) OVER (ORDER BY d), d) AS gap FROM x) SELECT (SELECT strftime(min(o_orderdate), '%Y-%m-%d') FROM orders) AS earliest, (SELECT strftime(max(o_orderdate), '%Y-%m-%d') FROM orders) AS latest, (SELECT count(*) FROM orders) AS valid, median(gap) AS median_gap, CASE WHEN median(gap) <= 1.5 THEN 'daily' WHEN median(gap) <= 8 THEN 'weekly' WHEN median(gap) <= 32 THEN 'monthly' ELSE 'irregular' END AS granularity FROM g")
def date_granularity(spark, d):
    return o.date_profile(table(spark, d, "orders"), "o_orderdate").select(F.col("earliest").cast("string").alias("earliest"), F.col("latest").cast("string").alias("latest"), "valid", "median_gap", "granularity")


@add(f"WITH s AS (SELECT n_name AS segment, sum(l_extendedprice * (1 - l_discount)) AS value, count(*) AS n FROM {_SALES} GROUP BY 1 ORDER BY value DESC, segment LIMIT 20) SELECT segment, round(value, 2) AS value, n, round(100 * value / sum(value) OVER (), 6) AS share, CAST(row_number() OVER (ORDER BY value DESC, segment) AS INTEGER) AS place FROM s")
def segmentation_breakdown(spark, d):
    return o.segments(sales(spark, d), "n_name", "net").withColumn("value", F.round("value", 2)).withColumn("share", F.round("share", 6))


@add(f"WITH s AS (SELECT n_name AS segment, avg(l_quantity) AS value FROM {_SALES} GROUP BY 1 ORDER BY value DESC, segment LIMIT 20) SELECT segment, round(value, 6) AS value, side FROM ((SELECT *, 'top' AS side FROM s ORDER BY value DESC, segment LIMIT 5) UNION ALL (SELECT *, 'bottom' FROM s ORDER BY value, segment LIMIT 5))")
def top_and_bottom_segments(spark, d):
    return o.top_and_bottom(o.segments(sales(spark, d), "n_name", "l_quantity", "avg")).select("segment", F.round("value", 6).alias("value"), "side")


@add("SELECT * FROM (" + _union(("o_orderstatus", "o_orderpriority", "o_custkey"), "SELECT '{c}' AS column_name, count(DISTINCT {c}) AS distinct_values, count({c}) AS n_rows FROM orders") + ") WHERE distinct_values BETWEEN 2 AND 50 AND n_rows >= 10")
def segment_dimensions(spark, d):
    return o.segment_dimensions(table(spark, d, "orders"), ["o_orderstatus", "o_orderpriority", "o_custkey"])


@add("SELECT l_returnflag, round(sum(l_extendedprice) / nullif(sum(l_quantity), 0), 6) AS unit_price, round(sum(l_tax) / nullif(sum(l_discount), 0), 6) AS tax_per_discount FROM lineitem GROUP BY 1")
def derived_ratio_metrics(spark, d):
    out = o.ratio_metrics(table(spark, d, "lineitem"), ["l_returnflag"], {"unit_price": ("l_extendedprice", "l_quantity"), "tax_per_discount": ("l_tax", "l_discount")})
    return out.select("l_returnflag", F.round("unit_price", 6).alias("unit_price"), F.round("tax_per_discount", 6).alias("tax_per_discount"))


@add(f"SELECT round(sum(r), 2) AS revenue, round(sum(c), 2) AS cost, round(sum(r) - sum(c), 2) AS profit, round(100 * (sum(r) - sum(c)) / sum(r), 6) AS margin_percent, sum(l_quantity) AS quantity, count(DISTINCT o_custkey) AS customers FROM (SELECT l_extendedprice * (1 - l_discount) AS r, l_extendedprice * 0.6 AS c, l_quantity, o_custkey FROM {_SALES})")
def business_kpis(spark, d):
    k = o.business_kpis(sales(spark, d), F.col("net"), F.col("l_extendedprice") * 0.6, "l_quantity", F.col("l_extendedprice"), "o_custkey")
    return k.select(*[F.round(c, 2).alias(c) for c in ("revenue", "cost", "profit")], F.round("margin_percent", 6).alias("margin_percent"), "quantity", "customers")


@add("WITH x AS (SELECT CASE WHEN value >= 15 THEN value END AS v FROM events), p AS (SELECT count(*) AS n, count(*) - count(v) AS nulls, min(v) AS lo, max(v) AS hi, avg(v) AS mean, stddev_samp(v) AS sd FROM x), q AS (SELECT round(quantile_cont(v, 0.25), 4) AS q1, round(quantile_cont(v, 0.75), 4) AS q3 FROM x), u AS (SELECT count(*) AS outs FROM x, q WHERE v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)) SELECT 'v' AS column_name, rule, severity FROM p, u, LATERAL (SELECT unnest(['missing', 'extreme_range', 'outlier_density', 'dispersion']) AS rule, unnest([CASE WHEN nulls / n >= 0.25 THEN 'high' WHEN nulls / n >= 0.10 THEN 'medium' END, CASE WHEN abs(hi / nullif(lo, 0)) > 1000 OR (hi > 10 * mean AND mean > 0) THEN 'medium' END, CASE WHEN outs / n >= 0.20 THEN 'high' WHEN outs / n >= 0.10 THEN 'medium' END, CASE WHEN abs(sd / mean) > 5 THEN 'high' WHEN abs(sd / mean) > 2 THEN 'medium' END]) AS severity) WHERE severity IS NOT NULL")
def anomaly_flags(spark, d):
    df = table(spark, d, "events").select(F.when(F.col("value") >= 15, F.col("value")).alias("v"))
    return o.numeric_anomalies(df, ["v"])


@add("SELECT 'k' AS column_name, 'dominance' AS rule, CASE WHEN s >= 0.90 THEN 'high' ELSE 'medium' END AS severity FROM (SELECT max(n) / sum(n) AS s FROM (SELECT CASE WHEN o_orderkey % 10 = 0 THEN 'rare' ELSE 'common' END AS k, count(*) AS n FROM orders GROUP BY 1)) WHERE s >= 0.80")
def categorical_anomaly_flags(spark, d):
    df = table(spark, d, "orders").select(F.when(F.col("o_orderkey") % 10 == 0, "rare").otherwise("common").alias("k"))
    return o.categorical_anomalies(df, ["k"])


@add("SELECT count(*) AS n_rows, 100.0 AS completeness, CAST(CASE WHEN count(*) >= 100 THEN 20 WHEN count(*) >= 30 THEN 10 ELSE 0 END + 80 AS INTEGER) AS score, CASE WHEN count(*) >= 30 THEN 'ready' ELSE 'ready' END AS level FROM orders")
def readiness_score(spark, d):
    return o.readiness(table(spark, d, "orders"), ["o_totalprice"], ["o_orderstatus"], ["o_orderdate"])


@add("WITH r AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) AS i, count(*) OVER () AS n FROM events) SELECT max(n) AS n, round(avg(value) FILTER (i <= n // 2), 6) AS first_mean, round(avg(value) FILTER (i > n // 2), 6) AS second_mean, CASE WHEN abs(100 * (avg(value) FILTER (i > n // 2) - avg(value) FILTER (i <= n // 2)) / avg(value) FILTER (i <= n // 2)) < 5 THEN 'stable' WHEN avg(value) FILTER (i > n // 2) > avg(value) FILTER (i <= n // 2) THEN 'rising' ELSE 'falling' END AS direction FROM r")
def split_half_trend(spark, d):
    out = o.split_half(table(spark, d, "events"), ["ts", "event_id"], "value")
    return out.select("n", F.round("first_mean", 6).alias("first_mean"), F.round("second_mean", 6).alias("second_mean"), "direction")
