"""What changed between two states of a source, what of it needs a review, and how well learned rules hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# What makes a rule suspicious.
MOST_TABLES = 100
MOST_DOMAINS = 3
LEAST_CONFIDENCE = 0.60
MOST_SHARE = 0.25
#: The mark that a learned rule leaves in the evidence of an assignment.
RULE_MARK = r"learned rule \[([A-Z]+)\] '([^']+)'"


def classification_diff(before: DataFrame | None, after: DataFrame) -> DataFrame:
    """table_name, change (added, removed, modified) of two tables of (table_name, table_class); without a first state all are added.

    A class that is null on both sides is no change.
    """
    now = after.select("table_name", F.lit(True).alias("there"), F.col("table_class").alias("now"))
    if before is None:
        return now.select("table_name", F.lit("added").alias("change"))
    was = before.select("table_name", F.lit(True).alias("known"), F.col("table_class").alias("was"))
    change = F.when(F.col("known").isNull(), "added").when(F.col("there").isNull(), "removed").when(~F.col("was").eqNullSafe(F.col("now")), "modified")
    return was.join(now, "table_name", "full").select("table_name", change.alias("change")).filter("change is not null")


def merge_changes(schema: DataFrame, profiling: DataFrame) -> DataFrame:
    """Both sets of (table_name, change), each pair once; only the schema tells of removed tables."""
    return schema.select("table_name", "change").unionByName(profiling.filter("change <> 'removed'").select("table_name", "change")).distinct()


def _items(rows: DataFrame, kind: str, column: str | None, signal) -> DataFrame:
    return rows.select(F.lit(kind).alias("object_type"), "table_name", (F.col(column) if column else F.lit("")).alias("column_name"), signal.alias("signal"))


def new_pii(before: DataFrame, after: DataFrame) -> DataFrame:
    """Review items of columns (table_name, column_name, pii) that are personal data now and were not, or were not there."""
    key = ["table_name", "column_name"]
    rows = after.filter("pii").join(before.filter("pii").select(*key), key, "left_anti")
    return _items(rows, "pii.new", "column_name", F.lit("pii_risk flagged"))


def reclassified(before: DataFrame, after: DataFrame, kind: str) -> DataFrame:
    """Review items of tables (table_name, value) with another value than before; a first value is none."""
    rows = before.filter("value is not null").select("table_name", F.col("value").alias("was")).join(after, "table_name").filter("not (was <=> value)")
    return _items(rows, kind, None, F.concat(F.lit("changed from "), F.col("was"), F.lit(" to "), F.coalesce("value", F.lit("nothing"))))


def drift_items(changes: DataFrame) -> DataFrame:
    """Review items of the removals in a schema_diff; additions need none."""
    rows = changes.filter("change in ('removed', 'table_removed')")
    signal = F.when(F.col("change") == "removed", "column removed").otherwise("table removed")
    return _items(rows.withColumn("column_name", F.coalesce("column_name", F.lit(""))), "schema.drift", "column_name", signal)


def rule_quality(rules: DataFrame, assignments: DataFrame) -> DataFrame:
    """rule_id, tables_matched, confidence_avg, unique_generic_domains, share and flags of each rule; a rule without flags is healthy.

    ``rules``: rule_id, pattern_type, pattern_value. ``assignments``: table_name, domain,
    confidence, evidence (array of text; the first mark in it names the rule),
    generic_domain (what the general rules would say; may be null).
    """
    marked = F.get(F.filter("evidence", lambda e: e.rlike(RULE_MARK)), F.lit(0))
    rows = assignments.select("domain", "confidence", "generic_domain", marked.alias("mark"))
    matched = rows.filter("mark is not null").groupBy(F.regexp_extract("mark", RULE_MARK, 1).alias("pattern_type"), F.regexp_extract("mark", RULE_MARK, 2).alias("pattern_value"))
    counted = matched.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence"), 3).alias("mean"), F.count_distinct("generic_domain").alias("domains"))
    total = rows.agg(F.count_if(F.col("domain") != "Unknown").alias("assigned"))
    n, mean, domains = F.coalesce("n", F.lit(0)), F.coalesce("mean", F.lit(0.0)), F.coalesce("domains", F.lit(0))
    share = F.coalesce(n / F.nullif(F.col("assigned").cast("double"), F.lit(0.0)), F.lit(0.0))
    flags = [F.when(n > MOST_TABLES, "high_coverage"), F.when(domains > MOST_DOMAINS, "domain_spread"), F.when((n > 0) & (mean < LEAST_CONFIDENCE), "low_confidence"), F.when(share > MOST_SHARE, "high_share")]
    judged = rules.join(counted, ["pattern_type", "pattern_value"], "left").crossJoin(F.broadcast(total))  # one row
    return judged.select("rule_id", n.alias("tables_matched"), mean.alias("confidence_avg"), domains.alias("unique_generic_domains"), F.round(share, 6).alias("share"), F.array_compact(F.array(*flags)).alias("flags"))
