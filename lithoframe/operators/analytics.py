"""Comparison, trend, share, drift, forecast and result insights."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def change(current: Column, previous: Column) -> tuple[Column, Column, Column]:
    """percentage_change (2 places, over the absolute previous value), direction, warning."""
    diff = current - previous
    percent = F.when(current.isNull() | previous.isNull(), None).when((previous == 0) & (current == 0), 0.0).when(previous == 0, None).otherwise(F.round(100.0 * diff / F.abs(F.nullif(previous, F.lit(0.0))), 2))
    direction = F.when(current.isNull() | previous.isNull(), "unknown").when(diff > 0, "up").when(diff < 0, "down").otherwise("flat")
    warning = F.when(current.isNull() | previous.isNull(), "incomplete").when((previous == 0) & (current != 0), "previous is zero")
    return percent, direction, warning


def compare_periods(df: DataFrame, day: Column, value: Column, current: tuple[date, date], previous: tuple[date, date]) -> DataFrame:
    """current_value, previous_value, absolute_change, percentage_change, direction, warning: both periods in one scan, whole last days included."""
    inside = lambda p: (day >= F.lit(p[0])) & (day < F.date_add(F.lit(p[1]), 1))
    sums = df.filter(inside(current) | inside(previous)).agg(F.sum(F.when(inside(current), value)).alias("current_value"), F.sum(F.when(inside(previous), value)).alias("previous_value"))
    percent, direction, warning = change(F.col("current_value"), F.col("previous_value"))
    return sums.select("current_value", "previous_value", (F.col("current_value") - F.col("previous_value")).alias("absolute_change"), percent.alias("percentage_change"), direction.alias("direction"), warning.alias("warning"))


def period_over_period(series: DataFrame, period: str, value: str) -> DataFrame:
    """Each period with the one before and the change in percent; null where that was 0. ``series`` is already one row per period."""
    before = F.lag(value).over(Window.orderBy(period))
    return series.withColumn("previous", before).withColumn("change_percent", 100.0 * (F.col(value) - F.col("previous")) / F.nullif(F.col("previous"), F.lit(0.0)))


def share_of_total(groups: DataFrame, value: str) -> DataFrame:
    """Grouped rows with share, in percent of all groups."""
    return groups.withColumn("share", 100.0 * F.col(value) / F.nullif(F.sum(value).over(Window.partitionBy()), F.lit(0.0)))


def leader_gap(groups: DataFrame, label: str, value: str) -> DataFrame:
    """The first group, the second and the distance between them."""
    w = Window.orderBy(F.desc(value), label)
    top = groups.orderBy(F.desc(value), label).limit(2)
    return top.select(F.col(label).alias("leader"), F.col(value).alias("leader_value"), F.lead(label).over(w).alias("runner_up"), (F.col(value) - F.lead(value).over(w)).alias("gap"), F.row_number().over(w).alias("place")).filter("place = 1").drop("place")


def category_insights(groups: DataFrame, label: str, value: str) -> DataFrame:
    """kind, labels, value: highest and lowest (all that tie), top gap, share of the highest."""
    ends = groups.agg(F.max(value).alias("hi"), F.min(value).alias("lo"), F.sum(value).alias("total"))
    tagged = groups.crossJoin(F.broadcast(ends))  # one row of ends
    named = lambda kind, end: tagged.filter(F.col(value) == F.col(end)).groupBy(F.lit(kind).alias("kind")).agg(F.array_join(F.array_sort(F.collect_list(F.col(label).cast("string"))), ",").alias("labels"), F.max(F.col(value).cast("double")).alias("value"))
    gap = leader_gap(groups, label, value).select(F.lit("top_gap").alias("kind"), F.col("leader").cast("string").alias("labels"), F.col("gap").cast("double").alias("value"))
    share = tagged.filter(F.col(value) == F.col("hi")).groupBy(F.lit("top_share").alias("kind")).agg(F.min(F.col(label).cast("string")).alias("labels"), F.max(100.0 * F.col(value) / F.col("total")).alias("value"))
    return named("highest", "hi").unionByName(named("lowest", "lo")).unionByName(gap).unionByName(share)


def drift(snapshots: DataFrame, metric: str, taken: str, value: str, least: int = 3, top: int = 8) -> DataFrame:
    """Each metric's latest value against the mean of its earlier snapshots (at least 3): percent and level (low 10, medium 20, high 40)."""
    newest = snapshots.groupBy(metric).agg(F.max(taken).alias("newest"))
    tagged = snapshots.join(newest, metric)
    out = tagged.groupBy(metric).agg(F.max(F.when(F.col(taken) == F.col("newest"), F.col(value))).alias("latest"), F.avg(F.when(F.col(taken) < F.col("newest"), F.col(value))).alias("baseline"), F.count_if(F.col(taken) < F.col("newest")).alias("n_before")).filter(f"n_before >= {least}")
    percent = 100.0 * (F.col("latest") - F.col("baseline")) / F.nullif(F.abs("baseline"), F.lit(0.0))
    size = F.abs("drift_percent")
    level = F.when(size >= 40, "high").when(size >= 20, "medium").otherwise("low")
    return out.withColumn("drift_percent", percent).filter(size >= 10).withColumn("level", level).orderBy(F.desc(size), metric).limit(top)


def forecast(series: DataFrame, period: str, value: str) -> DataFrame:
    """step, estimate, low, high by least squares over a series of at least 6 periods; the band is the population deviation of residuals; nothing falls below 0."""
    numbered = series.select(F.row_number().over(Window.orderBy(period)).cast("double").alias("x"), F.col(value).cast("double").alias("y"))  # a row per period
    x0 = numbered.withColumn("x", F.col("x") - 1)
    fit = x0.agg(F.count(F.lit(1)).alias("n"), F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("base")).filter("n >= 6")
    resid = x0.crossJoin(F.broadcast(fit)).agg(F.max("n").alias("n"), F.max("slope").alias("slope"), F.max("base").alias("base"), F.stddev_pop(F.col("y") - F.col("base") - F.col("slope") * F.col("x")).alias("band")).filter("n is not null")  # one row of the fit
    ahead = resid.select("*", F.explode(F.sequence(F.lit(1), F.least(F.lit(3), F.greatest(F.lit(1), F.expr("cast(n div 4 as int)"))))).alias("step"))
    point = F.col("base") + F.col("slope") * (F.col("n") - 1 + F.col("step"))
    return ahead.select("step", F.greatest(F.lit(0.0), point).alias("estimate"), F.greatest(F.lit(0.0), point - F.col("band")).alias("low"), F.greatest(F.lit(0.0), point + F.col("band")).alias("high"))


def page(df: DataFrame, order: list[Column], number: int, size: int) -> tuple[DataFrame, bool]:
    """One page of ordered rows, and whether more follow; the page's size is at most 1000."""
    size = min(size, 1000)
    rows = df.orderBy(*order).offset((number - 1) * size).limit(size + 1)
    return rows.limit(size), rows.count() > size


def row_budget(df: DataFrame, order: list[Column], characters: int) -> DataFrame:
    """The longest prefix of ordered rows whose cells hold at most so many characters; stops at the first row that doesn't fit. For answers, which are bounded already."""
    length = sum(F.length(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in df.columns)
    total = F.sum(length).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("total_chars", total).filter(F.col("total_chars") <= characters)


def result_shape(df: DataFrame, measures: dict[str, str], ranked: bool = False) -> str:
    """empty, null_scalar, scalar_<aggregation>, ranked, grouped or tabular, from at most two rows."""
    rows = df.limit(2).collect()
    if not rows:
        return "empty"
    if len(rows) == 1 and len(df.columns) == 1:
        if rows[0][0] is None:
            return "null_scalar"
        kind = measures.get(df.columns[0])
        return f"scalar_{'minmax' if kind in ('min', 'max') else kind}" if kind else "tabular"
    return "ranked" if ranked and measures else "grouped" if measures else "tabular"


def choose_chart(df: DataFrame, rows: int, truncated: bool = False) -> str | None:
    """line, bar, donut, scatter, grouped_line or none, from the types of a bounded answer's columns."""
    from ..sources.types import logical_type

    kinds = [logical_type(f.dataType) for f in df.schema.fields]
    numbers = sum(k in ("INTEGER", "DECIMAL") for k in kinds)
    dates, labels = kinds.count("DATETIME"), kinds.count("TEXT")
    if truncated or rows < 2 or rows > 25:
        return None
    if dates == 1 and len(kinds) == 2 and numbers == 1:
        return "line"
    if dates == 1 and 2 <= numbers <= 4 and len(kinds) == numbers + 1:
        return "grouped_line"
    if labels == 1 and numbers == 1 and len(kinds) == 2:
        return "donut" if rows <= 6 else "bar"
    return "scatter" if numbers == 2 and len(kinds) == 2 and rows >= 3 else None


def validate_result(df: DataFrame, expected: list[str], ordered_by: str | None = None) -> list[str]:
    """Faults of an answer: missing columns, or rows that aren't in descending order."""
    faults = [f"{c} is missing" for c in expected if c not in df.columns]
    if ordered_by and ordered_by in df.columns:
        values = [r[0] for r in df.select(ordered_by).limit(1001).collect() if r[0] is not None]
        if any(a < b for a, b in zip(values, values[1:], strict=False)):
            faults.append(f"{ordered_by} is not in descending order")
    return faults


def empty_like(spark: SparkSession, df: DataFrame) -> DataFrame:
    return spark.createDataFrame([], df.schema)
