"""Event logs, workflow and schedule health, governance, and schema lifecycles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rate_windows(events: DataFrame, user: str, ts: str, seconds: int, key: str) -> DataFrame:
    """Events with in_window: how many events of the user lie in the ``seconds`` up to each, itself and equal times included."""
    w = Window.partitionBy(user).orderBy(F.unix_micros(F.col(ts).cast("timestamp"))).rangeBetween(-seconds * 1_000_000, 0)
    return events.select(key, user, ts, F.count(F.lit(1)).over(w).alias("in_window"))


def latest_failures(runs: DataFrame, group: str, order: list[Column], success: Column) -> DataFrame:
    """group, failures: how many runs from the latest back failed before the first success."""
    good = F.sum(F.when(success, 1).otherwise(0)).over(Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return runs.withColumn("good", good).groupBy(group).agg(F.count_if(F.col("good") == 0).alias("failures"))


def workflow_health(runs: DataFrame, group: str, order: list[Column], success: Column, duration: str, least: int = 3) -> DataFrame:
    """runs, success_rate, avg_duration, failures, health of groups with at least 3 runs."""
    base = runs.groupBy(group).agg(F.count(F.lit(1)).alias("runs"), (100.0 * F.count_if(success) / F.count(F.lit(1))).alias("success_rate"), F.avg(duration).alias("avg_duration")).filter(f"runs >= {least}")
    health = F.when((F.col("success_rate") < 50) | (F.col("failures") >= 3), "Critical").when((F.col("success_rate") < 80) | (F.col("failures") >= 1), "Warning").otherwise("Healthy")
    return base.join(latest_failures(runs, group, order, success), group).withColumn("health", health)


def schedule_health(schedules: DataFrame, as_of: Column) -> DataFrame:
    """Schedules (schedule_id, every_days, last_run, paused) with days_late and status: Missed before Delayed before Healthy before Paused."""
    late = F.datediff(as_of, F.col("last_run")) - F.col("every_days")
    status = F.when(F.col("paused"), "Paused").when(F.col("last_run").isNull() | (late > F.col("every_days")), "Missed").when(late > 0, "Delayed").otherwise("Healthy")
    rank = F.when(status == "Missed", 0).when(status == "Delayed", 1).when(status == "Healthy", 2).otherwise(3)
    return schedules.withColumn("days_late", F.greatest(F.lit(0), late)).withColumn("status", status).orderBy(rank, "schedule_id")


def usage_counts(events: DataFrame, kind: str, ts: str, since: Column) -> DataFrame:
    return events.filter(F.col(ts) >= since).groupBy(kind).agg(F.count(F.lit(1)).alias("n"))


def outcome_summary(log: DataFrame, by: str, success: Column) -> DataFrame:
    """total, successful, success_rate (1 place) by format or kind."""
    return log.groupBy(by).agg(F.count(F.lit(1)).alias("total"), F.count_if(success).alias("successful"), F.round(100.0 * F.count_if(success) / F.count(F.lit(1)), 1).alias("success_rate"))


def repeated(log: DataFrame, user: str, key: str, ts: str, seconds: int = 300, least: int = 3) -> DataFrame:
    """user, key, most: keys that a user sent at least ``least`` times within ``seconds``."""
    w = Window.partitionBy(user, key).orderBy(F.unix_micros(F.col(ts).cast("timestamp"))).rangeBetween(-seconds * 1_000_000, 0)
    return log.withColumn("n", F.count(F.lit(1)).over(w)).groupBy(user, key).agg(F.max("n").alias("most")).filter(f"most >= {least}")


def repeated_intents(log: DataFrame, text: str, least: int = 2) -> DataFrame:
    """Questions grouped exactly, then by their normal form: intent, variants, n."""
    from ..functions.text import normalize_intent

    exact = log.groupBy(text).agg(F.count(F.lit(1)).alias("n"))
    return exact.groupBy(normalize_intent(F.col(text)).alias("intent")).agg(F.count(F.lit(1)).alias("variants"), F.sum("n").alias("n")).filter(f"n >= {least}")


# Base risk of states, and days of each priority.
RISK_BASE = {"APPROVED": 10, "PENDING": 40, "REJECTED": 60, "UNREVIEWED": 50}
SLA_DAYS = {"CRITICAL": 1, "HIGH": 3, "MEDIUM": 7, "LOW": 14}


def risk_score(state: Column, pii: Column, hard_policy: Column, confidence: Column) -> Column:
    base = F.coalesce(*[F.when(state == s, p) for s, p in RISK_BASE.items()], F.lit(50))
    band = F.when(confidence < 0.5, 15).when(confidence < 0.8, 5).otherwise(0)
    return F.greatest(F.lit(0), F.least(F.lit(100), base + F.when(pii, 30).otherwise(0) + F.when(hard_policy, 20).otherwise(0) + band))


def sla_status(items: DataFrame, priority: str, created: str, done: str, as_of: Column) -> DataFrame:
    """days_open, days_overdue, sla: ON_TRACK, AT_RISK (a day or less left), OVERDUE or COMPLETED."""
    days = F.coalesce(*[F.when(F.col(priority) == p, d) for p, d in SLA_DAYS.items()], F.lit(SLA_DAYS["LOW"]))
    open_days = F.datediff(F.coalesce(F.col(done), as_of), F.col(created))
    sla = F.when(F.col(done).isNotNull(), "COMPLETED").when(open_days > days, "OVERDUE").when(days - open_days <= 1, "AT_RISK").otherwise("ON_TRACK")
    return items.withColumn("days_open", open_days).withColumn("days_overdue", F.greatest(F.lit(0), open_days - days)).withColumn("sla", sla)


def backlog_summary(items: DataFrame, by: str) -> DataFrame:
    """open_items, overdue_percent, mean_days by group of items with sla and days_open."""
    is_open = F.col("sla") != "COMPLETED"
    return items.groupBy(by).agg(F.count_if(is_open).alias("open_items"), (100.0 * F.count_if(F.col("sla") == "OVERDUE") / F.nullif(F.count_if(is_open), F.lit(0))).alias("overdue_percent"), F.avg(F.when(~is_open, F.col("days_open"))).alias("mean_days"))


def first_policy(items: DataFrame, policies: DataFrame, on: Column, item_key: str) -> DataFrame:
    """Each item with the action of the first policy that fits: hard ones before others, then by priority. Policies are few; their number is checked before they are broadcast."""
    few = policies.count() <= 10_000
    met = items.join(F.broadcast(policies) if few else policies, on, "left")
    place = F.row_number().over(Window.partitionBy(item_key).orderBy(F.desc(F.coalesce(F.col("hard"), F.lit(False))), F.asc_nulls_last("priority"), F.asc_nulls_last("policy_id")))
    return met.withColumn("place", place).filter("place = 1").drop("place")


def schema_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """table_name, column_name, change of two catalogs (see catalog_columns): tables and columns added or removed, types changed."""
    key = ["table_name", "column_name"]
    b, a = (x.select(*key, F.col("raw_type").alias(n)) for x, n in ((before, "was"), (after, "now")))
    columns = b.join(a, key, "full").withColumn("change", F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("was") != F.col("now"), "type_changed")).filter("change is not null").select(*key, "change")
    tb, ta = (x.select("table_name").distinct().withColumn(n, F.lit(1)) for x, n in ((before, "was"), (after, "now")))
    tables = tb.join(ta, "table_name", "full").filter("was is null or now is null").select("table_name", F.lit(None).cast("string").alias("column_name"), F.when(F.col("was").isNull(), "table_added").otherwise("table_removed").alias("change"))
    fresh = tables.select("table_name").distinct()
    return tables.unionByName(columns.join(fresh, "table_name", "left_anti"))


def table_overlap(before: DataFrame, after: DataFrame) -> DataFrame:
    """overlap and compatible (at least half of the tables are in both)."""
    tb, ta = (x.select("table_name").distinct().withColumn(n, F.lit(1)) for x, n in ((before, "was"), (after, "now")))
    return tb.join(ta, "table_name", "full").agg((F.count(F.when(F.col("was").isNotNull() & F.col("now").isNotNull(), 1)) / F.count(F.lit(1))).alias("overlap")).withColumn("compatible", F.col("overlap") >= 0.5)


def name_patterns(names: DataFrame, name: str, label: str, least: int = 3) -> DataFrame:
    """token, label, n, precision of the name tokens that go with a label at least ``least`` times: candidates for rules."""
    from ..functions.text import tokens

    rows = names.select(F.explode(F.array_distinct(tokens(F.col(name)))).alias("token"), F.col(label).alias("label"))
    every = rows.groupBy("token").agg(F.count(F.lit(1)).alias("all"))
    return rows.groupBy("token", "label").agg(F.count(F.lit(1)).alias("n")).filter(f"n >= {least}").join(every, "token").select("token", "label", "n", (F.col("n") / F.col("all")).alias("precision"))
