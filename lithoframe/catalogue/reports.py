"""Names and profiles judged, report rules, comparisons, and the graph of tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dataset, report
from ..operators import semantics as s
from ..sources.scans import table
from ..sources.types import catalog_columns
from .registry import Registry
from .relational import RELATIONS, sales

add = Registry()
QUERIES, SQL = add.queries, add.sql
_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
_NAMED = ", ".join(f"'{t}'" for t in _TABLES)
_LIST = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
#: Columns under the names that a user might give them: customer.c_name as CustomerName.
_COLUMNS = f"SELECT table_name, upper(table_name[1:1]) || table_name[2:] || upper(part[1:1]) || part[2:] AS column_name, CASE WHEN data_type = 'VARCHAR' THEN 'TEXT' ELSE 'OTHER' END AS kind FROM (SELECT table_name, data_type, regexp_replace(column_name, '^[a-z]{{1,2}}_', '') AS part FROM duckdb_columns() WHERE table_name IN ({_NAMED}))".replace("{{", "{").replace("}}", "}")
_MORE = ("Email", "user_email", "CustomerFirstName", "Name", "trackName", "APIKey", "login_pwd", "cvv2", "zip_code", "HomeAddress", "OrderTotal", "pin", "spinRate")


@add(
    f"WITH c AS ({_COLUMNS} UNION ALL SELECT 'more', unnest({_LIST(_MORE)}), 'TEXT'), t AS (SELECT *, list_filter(regexp_split_to_array(lower(regexp_replace(regexp_replace(column_name, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g')), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM c), "
    f"p AS (SELECT *, array_to_string(w, '') AS j, list_position(w, 'name') AS pos FROM t), q AS (SELECT *, CASE WHEN list_has_any(w, {_LIST(s.PII_TOKENS)}) THEN 1 WHEN len(list_filter({_LIST(s.PII_PARTS)}, lambda x: contains(j, x))) > 0 THEN 2 WHEN pos > 0 AND kind = 'TEXT' AND (pos = 1 OR list_contains({_LIST(s.PERSONS)}, w[pos - 1])) THEN 3 ELSE 0 END AS pii_tier, list_has_any(w, {_LIST(s.SECRET_TOKENS)}) OR len(list_filter({_LIST(s.SECRET_PARTS)}, lambda x: contains(j, x))) > 0 AS secret FROM p) "
    "SELECT table_name, column_name, CAST(pii_tier AS INTEGER) AS pii_tier, secret, CASE WHEN pii_tier IN (1, 2) THEN 'CONFIRMED' WHEN pii_tier = 3 THEN 'UNCERTAIN' ELSE 'NONE' END AS decision FROM q"
)
def pii_columns(spark, d):
    part = F.regexp_replace("column_name", "^[a-z]{1,2}_", "")
    up = lambda c: F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, 2, 1000))
    columns = catalog_columns(spark, {n: table(spark, d, n) for n in _TABLES}).select("table_name", F.concat(up("table_name"), up(part)).alias("column_name"), F.when(F.col("logical_type") == "TEXT", "TEXT").otherwise("OTHER").alias("logical_type"))
    more = spark.createDataFrame([("more", n, "TEXT") for n in _MORE], columns.schema)
    return s.classify_pii(columns.unionByName(more)).drop("logical_type")


_ROLES = (("o_totalprice", "MONEY", 0.9), ("o_orderkey", "IDENTIFIER", 1.0), ("o_orderstatus", "DIMENSION", 0.8), ("o_custkey", "DIMENSION", 0.7), ("o_orderdate", "TEMPORAL_AXIS", 1.0), ("big", "MONEY", 0.95), ("rare", "SCORE", 0.6))
_KPI = "SELECT *, CASE WHEN o_totalprice > 100000 THEN o_totalprice END AS big, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice / 1000 END AS rare FROM orders"


@add(
    f"WITH x AS ({_KPI}), p AS ("
    + " UNION ALL ".join(f"SELECT '{c}' AS column_name, '{r}' AS role, {w} AS w, greatest(0, 1 - (count(*) - count({c})) / count(*)) AS complete, count(DISTINCT {c}) AS u FROM x" for c, r, w in _ROLES)
    + "), q AS (SELECT *, CASE WHEN role IN ('IDENTIFIER', 'TEMPORAL_AXIS') THEN 'role_' || lower(role) || '_excluded' WHEN role = 'DIMENSION' THEN CASE WHEN u < 2 THEN 'unique_count_too_low' WHEN u > 500 THEN 'unique_count_too_high' END WHEN role = 'MONEY' AND complete < 0.5 THEN 'completeness_below_50pct' WHEN role = 'SCORE' AND complete < 0.4 THEN 'completeness_below_40pct' END AS reason_excluded FROM p) "
    "SELECT column_name, role, round(CASE WHEN role IN ('IDENTIFIER', 'TEMPORAL_AXIS') THEN 1 ELSE complete END, 3) AS completeness, reason_excluded IS NULL AS eligible, CASE WHEN reason_excluded IS NULL THEN round(complete * w, 3) ELSE 0 END AS eligibility_score, reason_excluded FROM q"
)
def kpi_eligibility(spark, d):
    o = table(spark, d, "orders").withColumn("big", F.when(F.col("o_totalprice") > 100000, F.col("o_totalprice"))).withColumn("rare", F.when(F.col("o_orderkey") % 2 == 0, F.col("o_totalprice") / 1000))
    wide = o.agg(F.count(F.lit(1)).alias("n"), *[f(F.col(c)).alias(f"{k}_{c}") for c, _, _ in _ROLES for k, f in (("nulls", lambda x: F.count_if(x.isNull())), ("unique", F.count_distinct))], *[f(F.col(c)).alias(f"{k}_{c}") for c in ("o_totalprice", "big", "rare") for k, f in (("sum", F.sum), ("mean", F.avg))])
    number = lambda k, c: F.col(f"{k}_{c}") if f"{k}_{c}" in wide.columns else F.lit(None).cast("double")
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(r).alias("role"), F.lit(w).alias("role_confidence"), F.col("n").alias("n_rows"), F.col(f"nulls_{c}").alias("null_count"), F.col(f"unique_{c}").alias("unique_count"), number("sum", c).alias("sum_value"), number("mean", c).alias("mean_value"), F.lit(None).cast("int").alias("filled_bins")) for c, r, w in _ROLES])
    return s.kpi_eligibility(wide.select(F.explode(rows).alias("x")).select("x.*")).select("column_name", "role", "completeness", "eligible", "eligibility_score", "reason_excluded")


_HALVES = "h AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) <= count(*) OVER () // 2 AS early FROM e), f AS (SELECT avg(value) FILTER (early) AS a, avg(value) FILTER (NOT early) AS b FROM h), g AS (SELECT 100 * (b - a) / abs(a) AS change FROM f)"
_EVENTS = "e AS (SELECT event_id, ts, event_type, CASE WHEN user_id % 5 <> 0 THEN value END AS value, CASE WHEN user_id % 5 <> 0 THEN 2 * value + 1 END AS twice, CASE WHEN event_id = 1 THEN 1000000.0 ELSE 1.0 END AS peak FROM events)"


def _events(spark, d):
    v = F.when(F.col("user_id") % 5 != 0, F.col("value"))
    return table(spark, d, "events").select("event_id", "ts", "event_type", v.alias("value"), (2 * v + 1).alias("twice"), F.when(F.col("event_id") == 1, 1000000.0).otherwise(1.0).alias("peak"))


@add(
    f"WITH {_EVENTS}, c AS (SELECT count(*) AS n, 100 * (1 - (3 * count(*) - count(value) - count(twice) - count(peak)) / (3 * count(*))) AS complete FROM e), "
    + ", ".join(f"b_{x} AS (SELECT count(DISTINCT CASE WHEN hi = lo THEN 0 ELSE greatest(0, least(9, floor(({x} - lo) / ((hi - lo) / 10)))) END) AS filled, max(CASE WHEN hi = lo THEN 1 ELSE 10 END) AS bins FROM e, (SELECT min({x}) AS lo, max({x}) AS hi FROM e) WHERE {x} IS NOT NULL)" for x in ("value", "twice", "peak"))
    + " SELECT 'dataset' AS subject, 'completeness' AS rule, CASE WHEN complete < 80 THEN 'high' ELSE 'medium' END AS level FROM c WHERE complete < 95 UNION ALL SELECT 'dataset', 'few_rows', CASE WHEN n < 30 THEN 'high' ELSE 'medium' END FROM c WHERE n < 100 UNION ALL "
    + " UNION ALL ".join(f"SELECT '{x}', 'sparse_histogram', 'medium' FROM b_{x} WHERE bins >= 5 AND (bins - filled) / bins > 0.5" for x in ("value", "twice", "peak"))
    + " UNION ALL " + " UNION ALL ".join(f"SELECT '{a}~{b}', 'correlated', 'medium' FROM e HAVING abs(corr({a}, {b})) >= 0.9" for a, b in (("value", "twice"), ("value", "peak"), ("twice", "peak")))
)
def dataset_anomaly_rules(spark, d):
    return report.dataset_anomalies(_events(spark, d), ["value", "twice", "peak"], ["value", "twice", "peak"])


@add(
    f"WITH {_EVENTS}, h AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) AS i, count(*) OVER () AS n FROM e WHERE value IS NOT NULL), g AS (SELECT 100 * (avg(value) FILTER (i > n // 2) - avg(value) FILTER (i <= n // 2)) / abs(avg(value) FILTER (i <= n // 2)) AS change FROM h), "
    "c AS (SELECT 100 * (1 - (2 * count(*) - count(value) - count(event_type)) / (2 * count(*))) AS complete FROM e), k AS (SELECT max(n) / sum(n) AS top FROM (SELECT count(*) AS n FROM e GROUP BY event_type)), w AS (SELECT abs((max(value) - min(value)) / avg(value)) AS ratio FROM e), "
    "m AS (SELECT n, row_number() OVER (ORDER BY d) AS p, count(*) OVER () AS a FROM (SELECT strftime(ts, '%Y-%m-%d') AS d, count(*) AS n FROM e GROUP BY 1)), v AS (SELECT avg(n) FILTER (p <= a // 2) AS a, avg(n) FILTER (p > a // 2) AS b FROM m WHERE a >= 3) "
    "SELECT 'dataset' AS subject, 'direction' AS rule, CASE WHEN abs(change) <= 5 THEN 'stable' WHEN change > 0 THEN 'up' ELSE 'down' END AS level FROM g UNION ALL SELECT 'dataset', 'strength', CASE WHEN abs(change) >= 100 THEN 'high' WHEN abs(change) >= 30 THEN 'medium' ELSE 'low' END FROM g UNION ALL SELECT 'dataset', 'completeness', CASE WHEN complete >= 98 THEN 'high' WHEN complete >= 80 THEN 'medium' ELSE 'low' END FROM c "
    "UNION ALL SELECT 'event_type', 'concentration', CASE WHEN top >= 0.8 THEN 'high' WHEN top >= 0.5 THEN 'medium' ELSE 'low' END FROM k UNION ALL SELECT 'value', 'spread', CASE WHEN ratio > 10 THEN 'medium' ELSE 'low' END FROM w UNION ALL SELECT 'dataset', 'monthly_volume', CASE WHEN b > 1.15 * a THEN 'rising' WHEN b < 0.85 * a THEN 'falling' ELSE 'steady' END FROM v"
)
def dataset_trend_rules(spark, d):
    """Volume is taken by day: the events cover one month."""
    e = _events(spark, d)
    return report.trend_rules(e, ["value"], ["event_type"], F.date_format("ts", "yyyy-MM-dd"), dataset.split_half(e, ["ts", "event_id"], "value"))


_RUN = "SELECT 'Dataset Row Count' AS metric, CAST(count(*) AS DOUBLE) AS value FROM {t} UNION ALL SELECT 'High-Severity Anomalies', CAST(count(*) FILTER (value > 90) AS DOUBLE) FROM {t} UNION ALL SELECT 'Upward Trend Signals', CAST(count(*) FILTER (value > 50) AS DOUBLE) FROM {t} UNION ALL SELECT 'Data Completeness', round(100.0 * count(nullif(event_type, 'error')) / count(*), 1) FROM {t}"


@add(
    "WITH a AS (SELECT * FROM events WHERE ts >= TIMESTAMP '2024-01-16'), b AS (SELECT * FROM events WHERE ts < TIMESTAMP '2024-01-16'), "
    f"x AS ({_RUN.format(t='a')}), y AS ({_RUN.format(t='b')}), z AS (SELECT x.metric, x.value AS current_value, y.value AS previous_value, round(x.value - y.value, 2) AS change FROM x JOIN y ON x.metric = y.metric), q AS (SELECT *, change = 0 OR (metric = 'Data Completeness' AND abs(change) < 0.01) AS still FROM z) "
    "SELECT metric, current_value, previous_value, change, CASE WHEN still THEN 'stable' WHEN change > 0 THEN 'increase' ELSE 'decrease' END AS change_type, CASE WHEN still THEN 'neutral' WHEN metric = 'High-Severity Anomalies' THEN CASE WHEN change < 0 THEN 'positive' ELSE 'warning' END WHEN change > 0 THEN 'positive' WHEN metric = 'Upward Trend Signals' THEN 'neutral' ELSE 'warning' END AS severity FROM q"
)
def historical_comparison(spark, d):
    def run(e):
        one = e.agg(F.count(F.lit(1)).cast("double").alias("a"), F.count_if(F.col("value") > 90).cast("double").alias("b"), F.count_if(F.col("value") > 50).cast("double").alias("c"), F.round(100.0 * F.count_if(F.col("event_type") != "error") / F.count(F.lit(1)), 1).alias("d"))
        names = ("Dataset Row Count", "High-Severity Anomalies", "Upward Trend Signals", "Data Completeness")
        return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(c).alias("value")) for n, c in zip(names, "abcd", strict=True)])).alias("x")).select("x.*")

    e, cut = table(spark, d, "events"), F.lit("2024-01-16").cast("timestamp")
    return report.compare_runs(run(e.filter(F.col("ts") >= cut)), run(e.filter(F.col("ts") < cut)), {"Data Completeness": 0.01})


_SOLD = "lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"
_BY, _OF = ("r_name", "n_name", "l_returnflag", "o_orderpriority"), ("l_quantity", "l_extendedprice")


@add(" UNION ALL ".join(f"SELECT '{m}' AS metric, '{x}' AS dimension, {x} AS segment, round(sum({m}), 2) AS value, count({m}) AS n, round(100 * sum({m}) / sum(sum({m})) OVER (), 6) AS share FROM {_SOLD} GROUP BY {x}" for m in _OF for x in _BY))
def segmentation_all_pairs(spark, d):
    out = report.segment_pairs(sales(spark, d), list(_OF), list(_BY))
    return out.withColumn("value", F.round("value", 2)).withColumn("share", F.round("share", 6))


_LINKS = sorted({(r.from_table, r.to_table) for r in RELATIONS})
_LINK_SQL = "(VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in _LINKS) + ") e(a, b)"


@add(f"SELECT n_tables, n_tables - (SELECT count(DISTINCT t) FROM (SELECT a AS t FROM {_LINK_SQL} UNION SELECT b FROM {_LINK_SQL})) AS isolated, relationships, sources, round(relationships / n_tables, 3) AS density FROM (SELECT count(DISTINCT table_name) AS n_tables FROM duckdb_columns() WHERE table_name IN ({_NAMED})), (SELECT count(*) AS relationships, count(DISTINCT a) AS sources FROM {_LINK_SQL})")
def graph_summary(spark, d):
    tables = catalog_columns(spark, {n: table(spark, d, n) for n in _TABLES})
    return report.graph_summary(tables, spark.createDataFrame(_LINKS, "from_table string, to_table string"))


@add(f"SELECT b AS table_name, 'references' AS direction, count(*) AS links FROM {_LINK_SQL} WHERE a = 'orders' GROUP BY 1 UNION ALL SELECT a, 'referenced_by', count(*) FROM {_LINK_SQL} WHERE b = 'orders' GROUP BY 1")
def related_tables(spark, d):
    return report.related_tables(spark.createDataFrame(_LINKS, "from_table string, to_table string"), "orders")
