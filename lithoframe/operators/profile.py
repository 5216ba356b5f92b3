"""Column and table profiles: all columns of a table in one aggregation, long results in one more job."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as text_
from ..functions.tiers import percentage
from ..sources.types import logical_type
from .quantiles import quantile_rows

STATS = ("total", "populated", "nulls", "distinct_values", "min_value", "max_value", "mean_value", "stddev_value", "zero_count", "blank_count", "min_length", "max_length", "avg_length")
_SCHEMA = {"total": "bigint", "populated": "bigint", "nulls": "bigint", "distinct_values": "bigint", "min_value": "string", "max_value": "string", "mean_value": "double", "stddev_value": "double", "zero_count": "bigint", "blank_count": "bigint", "min_length": "int", "max_length": "int", "avg_length": "double"}


def _stats(c: str, kind: str) -> dict[str, Column]:
    col = F.col(f"`{c}`")
    out = {"total": F.count(F.lit(1)), "populated": F.count(col), "nulls": F.count_if(col.isNull())}
    if kind in ("OTHER", "BINARY", "JSON"):
        return out
    out["distinct_values"] = F.count_distinct(col)
    if kind == "TEXT":
        length = F.length(col)
        out |= {"min_value": F.min(col), "max_value": F.max(col), "blank_count": F.count_if(F.length(F.trim(col)) == 0), "min_length": F.min(length), "max_length": F.max(length), "avg_length": F.avg(length)}
    elif kind in ("INTEGER", "DECIMAL"):
        out |= {"min_value": F.min(col), "max_value": F.max(col), "mean_value": F.avg(col), "stddev_value": F.stddev_samp(col), "zero_count": F.count_if(col == 0)}
    elif kind == "BOOLEAN":
        out["zero_count"] = F.count_if(~col)
    else:
        out |= {"min_value": F.min(col), "max_value": F.max(col)}
    return out


def _distinct_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """column_name, distinct_values: values go long and are counted in two steps, so that many columns don't multiply the rows of one aggregation.

    Rows are dealt evenly first: a file's row group, however large, is read by one task,
    which would hold the distinct values of all its columns.
    """
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df = df.select(*[F.col(f"`{c}`") for c in columns]).repartition(tasks, F.xxhash64(*[F.col(f"`{c}`") for c in columns]))
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("string").alias("v")) for c in columns])).alias("x")).select("x.*")
    return long.filter("v is not null").distinct().groupBy("column_name").agg(F.count(F.lit(1)).alias("distinct_values"))


def column_stats(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """A row per column: STATS that its logical type has, others null. Two passes: one aggregation, and one for distinct counts."""
    fields = [f for f in df.schema.fields if columns is None or f.name in columns]
    kinds = {f.name: logical_type(f.dataType) for f in fields}
    parts = {f.name: _stats(f.name, kinds[f.name]) for f in fields}
    counted = [c for c, p in parts.items() if p.pop("distinct_values", None) is not None]
    wide = df.agg(*[e.alias(f"{k}__{s}") for k, f in enumerate(fields) for s, e in parts[f.name].items()])

    def row(k: int, name: str) -> Column:
        have = parts[name]
        values = [(F.col(f"{k}__{s}").cast(t) if s in have else F.lit(None).cast(t)).alias(s) for s, t in _SCHEMA.items() if s != "distinct_values"]
        return F.struct(F.lit(name).alias("column_name"), F.lit(kinds[name]).alias("logical_type"), *values)

    rows = wide.select(F.explode(F.array(*[row(k, f.name) for k, f in enumerate(fields)])).alias("x")).select("x.*")
    if not counted:
        return rows.withColumn("distinct_values", F.lit(None).cast("bigint"))
    return rows.join(_distinct_counts(df, counted), "column_name", "left").withColumn("distinct_values", F.when(F.col("column_name").isin(counted), F.coalesce("distinct_values", F.lit(0))))


def derived_rates(stats: DataFrame) -> DataFrame:
    """Percentages and uniqueness beside the statistics; variance from the deviation."""
    return stats.select(
        "*",
        percentage(F.col("nulls"), F.col("total")).alias("null_percentage"),
        percentage(F.col("populated"), F.col("total")).alias("populated_percentage"),
        percentage(F.col("distinct_values"), F.col("populated")).alias("distinct_percentage"),
        (F.col("distinct_values") / F.nullif(F.col("populated").cast("double"), F.lit(0.0))).alias("uniqueness"),
        percentage(F.col("blank_count"), F.col("total")).alias("blank_percentage"),
        (F.col("stddev_value") * F.col("stddev_value")).alias("variance_value"),
        (F.col("populated") - F.col("distinct_values")).alias("duplicate_count"),
    )


def percentiles(df: DataFrame, columns: list[str], points: tuple[float, ...] = (0.05, 0.25, 0.5, 0.75, 0.95)) -> DataFrame:
    """column_name and one interpolated percentile per point (p5, p25, ...), exact (see ``quantiles``)."""
    return quantile_rows(df, columns, {f"p{round(100 * p)}": p for p in points})


def histogram(df: DataFrame, column: str, buckets: int = 10) -> DataFrame:
    """bucket (from 0), low, high, n: equal widths, the maximum in the last bucket, empty buckets filled; a constant column has one bucket."""
    value = F.col(f"`{column}`").cast("double")
    ends = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / buckets
    index = F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.greatest(F.lit(0), F.least(F.lit(buckets - 1), F.floor((F.col("v") - F.col("lo")) / width).cast("int"))))
    counts = df.select(value.alias("v")).filter("v is not null").crossJoin(F.broadcast(ends)).select(index.alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))  # one row of ends
    frame = ends.filter("lo is not null").select("lo", "hi", F.explode(F.sequence(F.lit(0), F.when(F.col("hi") == F.col("lo"), 0).otherwise(buckets - 1))).alias("bucket"))
    return frame.join(F.broadcast(counts), "bucket", "left").select("bucket", (F.col("lo") + F.col("bucket") * width).alias("low"), (F.col("lo") + (F.col("bucket") + 1) * width).alias("high"), F.coalesce("n", F.lit(0)).alias("n"))


def top_values(df: DataFrame, columns: list[str], k: int = 10, max_chars: int | None = None) -> DataFrame:
    """column_name, value, n, percent (of populated), place: the k commonest values of each column, ties by value; all columns in one job. ``max_chars`` shortens values before they are counted; None counts whole ones."""
    from pyspark.sql import Window

    shown = lambda c: c if max_chars is None else F.substring(c, 1, max_chars)
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), shown(F.col(f"`{c}`").cast("string")).alias("value")) for c in columns])).alias("x")).select("x.*")
    counts = long.filter("value is not null").groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("column_name").agg(F.sum("n").alias("populated"))
    # each hash group keeps its k first before the columns' groups meet
    part = Window.partitionBy("column_name", F.pmod(F.xxhash64("value"), F.lit(64))).orderBy(F.desc("n"), "value")
    some = counts.withColumn("part", F.row_number().over(part)).filter(f"part <= {k}")
    place = F.row_number().over(Window.partitionBy("column_name").orderBy(F.desc("n"), "value"))
    return some.withColumn("place", place).filter(f"place <= {k}").join(F.broadcast(totals), "column_name").select("column_name", "value", "n", (100.0 * F.col("n") / F.col("populated")).alias("percent"), "place")  # one total per column


def pattern_rates(df: DataFrame, columns: list[str]) -> DataFrame:
    """Percent of non-blank values that look like each kind; null without such values."""
    kinds = {"email_rate": text_.is_email, "phone_rate": text_.is_phone, "guid_rate": lambda c: text_.matches(c, text_.GUID), "date_rate": lambda c: text_.matches(c, text_.DATE), "numeric_rate": lambda c: text_.matches(c, text_.NUMBER), "masked_rate": lambda c: text_.matches(c, text_.MASKED)}
    full = {c: F.when(F.trim(F.col(f"`{c}`").cast("string")) != "", F.col(f"`{c}`").cast("string")) for c in columns}
    wide = df.agg(*[text_.rate(f(v)).alias(f"{c}__{k}") for c, v in full.items() for k, f in kinds.items()])
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), *[F.col(f"`{c}__{k}`").alias(k) for k in kinds]) for c in columns])
    return wide.select(F.explode(rows).alias("x")).select("x.*")


def dominant_patterns(df: DataFrame, columns: list[str]) -> DataFrame:
    """column_name, pattern, coverage (percent of non-blank values): the commonest shape, ties by shape."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), text_.shape(F.trim(F.col(f"`{c}`").cast("string"))).alias("pattern")) for c in columns])).alias("x")).select("x.*").filter("pattern <> ''")
    counts = long.groupBy("column_name", "pattern").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("column_name").agg(F.max("n").alias("most"), F.sum("n").alias("all"))
    return counts.join(best, "column_name").filter("n = most").groupBy("column_name").agg(F.min("pattern").alias("pattern"), F.max(100.0 * F.col("most") / F.col("all")).alias("coverage"))


def validity_status(validator_rate: Column) -> Column:
    return F.when(validator_rate >= 95, "valid").when(validator_rate >= 50, "partially_valid").when(validator_rate.isNotNull(), "invalid").otherwise("unknown")


def validator_rate(semantic_type: Column) -> Column:
    """Which match rate (columns email_rate, phone_rate, guid_rate, date_rate) judges a column; null if none does."""
    by_type = F.when(semantic_type == "EMAIL", F.col("email_rate")).when(semantic_type == "PHONE", F.col("phone_rate")).when(semantic_type == "ID", F.col("guid_rate"))
    return F.coalesce(by_type, F.when(F.col("guid_rate") >= 50, F.col("guid_rate")), F.when(F.col("date_rate") >= 80, F.col("date_rate")))


def quality_notes(null_percent: Column, blank_percent: Column, uniqueness: Column, populated: Column, coverage: Column, status: Column) -> tuple[Column, Column, Column]:
    """Strengths, issues and recommendations as arrays."""
    null_, blank = F.coalesce(null_percent, F.lit(0.0)), F.coalesce(blank_percent, F.lit(0.0))
    known = null_percent.isNotNull()
    strengths = [F.when(known & (null_ == 0) & (blank == 0), "complete").when(known & (null_ < 5) & (blank < 5), "nearly complete"), F.when(uniqueness == 1, "unique"), F.when(coverage >= 95, "consistent format"), F.when(status == "valid", "valid")]
    issues = [F.when(null_ > 20, "many nulls"), F.when(known & (blank > 5), "many blanks"), F.when((uniqueness < 0.1) & (populated > 100), "many duplicates"), F.when(coverage < 50, "mixed formats"), F.when(status.isin("invalid", "partially_valid"), "invalid values")]
    advice = [F.when(null_ > 20, "look for the cause of missing values"), F.when(known & (blank > 5), "store nulls instead of empty text"), F.when(coverage < 50, "use one format"), F.when(status == "invalid", "cleanse at the source").when(status == "partially_valid", "review and correct values")]
    return tuple(F.array_compact(F.array(*x)) for x in (strengths, issues, advice))


# Points of a table's priority.
CLASS_POINTS = {"Master": 50, "Transactional": 40, "Reference": 25, "Audit": -25}


def table_priority(table_class: Column, referenced_by: Column, foreign_keys: Column, has_date: Column, key_columns: Column, name: Column) -> Column:
    low = F.lower(name)
    points = [F.coalesce(*[F.when(table_class == c, p) for c, p in CLASS_POINTS.items()], F.lit(0)), F.when(referenced_by >= 5, 20), F.when(foreign_keys > 0, 15), F.when(has_date, 10), F.when(key_columns > 0, 10), F.when(low.rlike("^(tmp|temp|bak|backup|old|test|stg|staging)_"), -50), F.when(low.contains("migration"), -25)]
    return reduce(lambda a, b: a + b, [F.coalesce(p, F.lit(0)) for p in points])


def table_role(foreign_keys: Column, columns: Column, inbound: Column) -> Column:
    """junction, root, leaf or inner."""
    return F.when((foreign_keys >= 2) & (columns <= foreign_keys + 2), "junction").when(foreign_keys == 0, "root").when(inbound == 0, "leaf").otherwise("inner")


def normalize_cells(df: DataFrame, max_chars: int = 2000) -> DataFrame:
    """Values as an answer shows them: dates as ISO text, bytes as lower-case hex, long text cut, nested values as a mark."""

    def shown(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`")
        kind = logical_type(f.dataType)
        if kind == "DATETIME":
            return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss") if "timestamp" in f.dataType.simpleString() else c.cast("string")
        if kind == "BINARY":
            return F.lower(F.hex(c))
        if kind == "TEXT":
            return F.substring(c, 1, max_chars)
        return F.when(c.isNotNull(), f"<unsupported:{f.dataType.typeName()}>") if kind == "OTHER" else c

    return df.select(*[shown(f).alias(f.name) for f in df.schema.fields])
