"""Event logs, health, governance and lifecycles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import operations as o
from ..operators.workflow import extract_json
from ..sources.scans import table
from ..sources.types import catalog_columns
from ..streaming.rates import windowed_counts
from .registry import Registry

add = Registry()
QUERIES, SQL = add.queries, add.sql
_OK = "event_type <> 'error'"


@add("SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 300 SECONDS PRECEDING AND CURRENT ROW) AS in_window FROM events")
def user_rate_windows(spark, d):
    return o.rate_windows(table(spark, d, "events"), "user_id", "ts", 300, "event_id").select("event_id", "user_id", "in_window")


@add("SELECT event_type, count(*) AS runs, round(100.0 * count(*) FILTER (value >= 30) / count(*), 6) AS success_rate, round(avg(value), 6) AS avg_duration, max(failures) AS failures, CASE WHEN 100.0 * count(*) FILTER (value >= 30) / count(*) < 50 OR max(failures) >= 3 THEN 'Critical' WHEN 100.0 * count(*) FILTER (value >= 30) / count(*) < 80 OR max(failures) >= 1 THEN 'Warning' ELSE 'Healthy' END AS health FROM (SELECT *, count(*) FILTER (good = 0) OVER (PARTITION BY event_type) AS failures FROM (SELECT *, sum(CASE WHEN value >= 30 THEN 1 ELSE 0 END) OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC ROWS UNBOUNDED PRECEDING) AS good FROM events)) GROUP BY 1 HAVING count(*) >= 3")
def event_health(spark, d):
    out = o.workflow_health(table(spark, d, "events"), "event_type", [F.desc("ts"), F.desc("event_id")], F.col("value") >= 30, "value")
    return out.withColumn("success_rate", F.round("success_rate", 6)).withColumn("avg_duration", F.round("avg_duration", 6))


@add("SELECT json_extract_string(props, '$.k') AS k, count(*) AS n FROM events GROUP BY 1")
def json_prop_counts(spark, d):
    return table(spark, d, "events").select(*extract_json(F.col("props"), {"k": "k"})).groupBy("k").agg(F.count(F.lit(1)).alias("n"))


@add("SELECT user_id, arg_max(event_id, value) AS slowest, max(value) AS value FROM events GROUP BY 1")
def slowest_by_user(spark, d):
    """Of events that share a user's highest value the least id, the first in the table; the SQL leaves open which."""
    place = F.when(F.col("event_id").isNotNull() & F.col("value").isNotNull(), F.struct("value", -F.col("event_id")))
    return table(spark, d, "events").groupBy("user_id").agg(F.max_by("event_id", place).alias("slowest"), F.max("value").alias("value"))


@add("SELECT event_type, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-20' GROUP BY 1")
def usage_since(spark, d):
    return o.usage_counts(table(spark, d, "events"), "event_type", "ts", F.lit("2024-01-20").cast("timestamp"))


@add("SELECT event_type, count(*) AS total, count(*) FILTER (value >= 30) AS successful, round(100.0 * count(*) FILTER (value >= 30) / count(*), 1) AS success_rate FROM events GROUP BY 1")
def outcome_summary(spark, d):
    return o.outcome_summary(table(spark, d, "events"), "event_type", F.col("value") >= 30)


@add("SELECT user_id, event_type, max(n) AS most FROM (SELECT user_id, event_type, count(*) OVER (PARTITION BY user_id, event_type ORDER BY ts RANGE BETWEEN INTERVAL 86400 SECONDS PRECEDING AND CURRENT ROW) AS n FROM events) GROUP BY 1, 2 HAVING max(n) >= 3")
def repeated_requests(spark, d):
    return o.repeated(table(spark, d, "events"), "user_id", "event_type", "ts", 86400)


@add("SELECT intent, count(*) AS variants, CAST(sum(n) AS BIGINT) AS n FROM (SELECT trim(regexp_replace(regexp_replace(lower(q), '\\b(please|show|me|the|a|an|can|you|could|give|get|i|want|to|see)\\b', ' ', 'g'), '[^a-z0-9]+', ' ', 'g')) AS intent, n FROM (SELECT CASE WHEN event_id % 2 = 0 THEN 'Show me the ' || event_type ELSE 'Please get ' || event_type || '!' END AS q, count(*) AS n FROM events GROUP BY 1)) GROUP BY 1 HAVING sum(n) >= 2")
def repeated_intents(spark, d):
    q = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("Show me the "), "event_type")).otherwise(F.concat(F.lit("Please get "), "event_type", F.lit("!")))
    return o.repeated_intents(table(spark, d, "events").select(q.alias("q")), "q")


@add(
    "SELECT schedule_id, CASE WHEN last_run IS NOT NULL THEN CAST(greatest(0, late) AS INTEGER) END AS days_late, CASE WHEN paused THEN 'Paused' WHEN last_run IS NULL OR late > every_days THEN 'Missed' WHEN late > 0 THEN 'Delayed' ELSE 'Healthy' END AS status FROM "
    "(SELECT *, date_diff('day', last_run, DATE '2001-08-01') - every_days AS late FROM (SELECT c_custkey AS schedule_id, CASE WHEN c_custkey % 2 = 0 THEN 30 ELSE 120 END AS every_days, CAST(max(o_orderdate) AS DATE) AS last_run, c_custkey % 11 = 0 AS paused FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderdate < TIMESTAMP '2001-08-01' GROUP BY c_custkey))"
)
def schedule_health(spark, d):
    """Every customer as a schedule of 30 or 120 days, run by the orders up to a day."""
    last = table(spark, d, "orders").filter("o_orderdate < timestamp '2001-08-01'").groupBy("o_custkey").agg(F.to_date(F.max("o_orderdate")).alias("last_run"))
    df = table(spark, d, "customer").join(last, F.col("c_custkey") == F.col("o_custkey"), "left").select(F.col("c_custkey").alias("schedule_id"), F.when(F.col("c_custkey") % 2 == 0, 30).otherwise(120).alias("every_days"), "last_run", (F.col("c_custkey") % 11 == 0).alias("paused"))
    out = o.schedule_health(df, F.lit("2001-08-01").cast("date"))
    return out.select("schedule_id", F.when(F.col("last_run").isNotNull(), F.col("days_late")).alias("days_late"), "status")


@add("SELECT o_orderkey, CAST(greatest(0, least(100, CASE o_orderstatus WHEN 'F' THEN 10 WHEN 'O' THEN 40 ELSE 50 END + CASE WHEN o_totalprice > 300000 THEN 30 ELSE 0 END + CASE WHEN o_orderpriority = '1-URGENT' THEN 20 ELSE 0 END + CASE WHEN o_totalprice < 50000 THEN 15 WHEN o_totalprice < 80000 THEN 5 ELSE 0 END)) AS INTEGER) AS risk FROM orders")
def risk_scores(spark, d):
    state = F.when(F.col("o_orderstatus") == "F", "APPROVED").when(F.col("o_orderstatus") == "O", "PENDING").otherwise("NEW")
    return table(spark, d, "orders").select("o_orderkey", o.risk_score(state, F.col("o_totalprice") > 300000, F.col("o_orderpriority") == "1-URGENT", F.col("o_totalprice") / 100000).cast("int").alias("risk"))


_SLA = "SELECT o_orderkey, o_orderpriority, p, CASE WHEN o_orderstatus = 'F' THEN 'COMPLETED' WHEN dd > p THEN 'OVERDUE' WHEN p - dd <= 1 THEN 'AT_RISK' ELSE 'ON_TRACK' END AS sla, dd FROM (SELECT *, CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 3 WHEN '3-MEDIUM' THEN 7 ELSE 14 END AS p, CASE WHEN o_orderstatus = 'F' THEN 5 ELSE date_diff('day', CAST(o_orderdate AS DATE), DATE '2001-08-01') END AS dd FROM orders WHERE o_orderdate < TIMESTAMP '2001-08-01')"


def _sla(spark, d):
    """Every order before the as-of day."""
    rows = table(spark, d, "orders").filter("o_orderdate < timestamp '2001-08-01'")
    p = F.when(F.col("o_orderpriority") == "1-URGENT", "CRITICAL").when(F.col("o_orderpriority") == "2-HIGH", "HIGH").when(F.col("o_orderpriority") == "3-MEDIUM", "MEDIUM").otherwise("LOW")
    rows = rows.withColumn("priority", p).withColumn("created", F.to_date("o_orderdate")).withColumn("done", F.when(F.col("o_orderstatus") == "F", F.date_add("created", 5)))
    return o.sla_status(rows, "priority", "created", "done", F.lit("2001-08-01").cast("date"))


@add(f"SELECT o_orderkey, sla, CAST(dd AS INTEGER) AS days_open, CAST(greatest(0, dd - p) AS INTEGER) AS days_overdue FROM ({_SLA})", also="sla_status_all")
def sla_status(spark, d):
    return _sla(spark, d).select("o_orderkey", "sla", "days_open", "days_overdue")


@add(f"SELECT o_orderpriority, count(*) FILTER (sla <> 'COMPLETED') AS open_items, round(100.0 * count(*) FILTER (sla = 'OVERDUE') / nullif(count(*) FILTER (sla <> 'COMPLETED'), 0), 6) AS overdue_percent FROM ({_SLA}) GROUP BY 1", also="backlog_summary_all")
def backlog_summary(spark, d):
    return o.backlog_summary(_sla(spark, d), "o_orderpriority").select("o_orderpriority", "open_items", F.round("overdue_percent", 6).alias("overdue_percent"))


@add("SELECT o_orderkey, CASE WHEN o_totalprice >= 300000 THEN 'block' WHEN o_totalprice >= 100000 THEN 'review' WHEN o_totalprice >= 50000 THEN 'log' END AS action FROM orders")
def policy_evaluation(spark, d):
    policies = spark.createDataFrame([(1, False, 2, 50000.0, "log"), (2, False, 1, 100000.0, "review"), (3, True, 9, 300000.0, "block")], "policy_id int, hard boolean, priority int, floor double, action string")
    return o.first_policy(table(spark, d, "orders"), policies, F.col("o_totalprice") >= F.col("floor"), "o_orderkey").select("o_orderkey", "action")


@add(
    "WITH b AS (SELECT table_name, column_name, data_type FROM duckdb_columns() WHERE table_name IN ('nation', 'region')), a AS (SELECT table_name, column_name, CASE WHEN column_name = 'n_regionkey' THEN 'BIGINT' ELSE data_type END AS data_type FROM duckdb_columns() WHERE table_name IN ('nation', 'supplier') AND column_name <> 'n_name' UNION ALL SELECT 'nation', 'n_extra', 'VARCHAR'), "
    "both_ AS (SELECT table_name FROM a INTERSECT SELECT table_name FROM b) SELECT DISTINCT table_name, CAST(NULL AS VARCHAR) AS column_name, 'table_removed' AS change FROM b WHERE table_name NOT IN (FROM both_) UNION ALL SELECT DISTINCT table_name, NULL, 'table_added' FROM a WHERE table_name NOT IN (FROM both_) "
    "UNION ALL SELECT table_name, column_name, CASE WHEN b.data_type IS NULL THEN 'added' WHEN a.data_type IS NULL THEN 'removed' ELSE 'type_changed' END FROM b FULL JOIN a USING (table_name, column_name) WHERE table_name IN (FROM both_) AND a.data_type IS DISTINCT FROM b.data_type"
)
def schema_diff(spark, d):
    nation, region, supplier = (table(spark, d, n) for n in ("nation", "region", "supplier"))
    changed = nation.drop("n_name").withColumn("n_extra", F.lit("x")).withColumn("n_regionkey", F.col("n_regionkey").cast("bigint"))
    return o.schema_diff(catalog_columns(spark, {"nation": nation, "region": region}), catalog_columns(spark, {"nation": changed, "supplier": supplier}))


@add("SELECT share AS overlap, share >= 0.5 AS compatible FROM (SELECT count(*) FILTER (sides = 2) / count(*) AS share FROM (SELECT table_name, count(*) AS sides FROM (SELECT DISTINCT table_name, 1 AS side FROM duckdb_columns() WHERE table_name IN ('nation', 'region') UNION ALL SELECT DISTINCT table_name, 2 FROM duckdb_columns() WHERE table_name IN ('nation', 'supplier')) GROUP BY 1))")
def fingerprint_overlap(spark, d):
    nation, region, supplier = (table(spark, d, n) for n in ("nation", "region", "supplier"))
    return o.table_overlap(catalog_columns(spark, {"nation": nation, "region": region}), catalog_columns(spark, {"nation": nation, "supplier": supplier}))


@add("SELECT token, label, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY token), 6) AS precision FROM (SELECT DISTINCT n_name, n_regionkey AS label, lower(t) AS token FROM (SELECT n_name, n_regionkey, unnest(regexp_extract_all(n_name, '[A-Za-z]+|[0-9]+')) AS t FROM nation)) GROUP BY 1, 2 QUALIFY count(*) >= 3")
def name_pattern_mining(spark, d):
    return o.name_patterns(table(spark, d, "nation"), "n_name", "n_regionkey").withColumn("precision", F.round("precision", 6))


@add("SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H') AS hour, event_type AS \"group\", count(*) AS n FROM events GROUP BY 1, 2")
def windowed_event_counts(spark, d):
    """The batch form of the streaming extension."""
    return windowed_counts(table(spark, d, "events"), "ts", "event_type", "1 hour").select(F.date_format("window_start", "yyyy-MM-dd HH").alias("hour"), "group", "n")
