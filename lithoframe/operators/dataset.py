"""Uploaded datasets: numeric, categorical and date profiles, segmentation, KPIs and rules, over all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import long_values, quantile_rows, select_ranks

# Segmentation limits.
SEGMENT_PAIRS, SEGMENT_ROWS, SEGMENT_TOP, DIMENSION_VALUES = 12, 10, 20, (2, 50)


def _long(df: DataFrame, columns: list[str], kind: str) -> DataFrame:
    return df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast(kind).alias("v")) for c in columns])).alias("x")).select("x.*")


def numeric_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """A row per column: min, max, mean, sum, std, median, p25, p75, p90, null, zero and negative counts."""
    v = F.col("v")
    quarters = quantile_rows(df, columns, {"median_value": 0.5, "p25": 0.25, "p75": 0.75, "p90": 0.9})
    out = _long(df, columns, "double").groupBy("column_name").agg(F.count(F.lit(1)).alias("n_rows"), F.min(v).alias("min_value"), F.max(v).alias("max_value"), F.avg(v).alias("mean_value"), F.sum(v).alias("sum_value"), F.stddev_samp(v).alias("std_value"), F.count_if(v.isNull()).alias("null_count"), F.count_if(v == 0).alias("zero_count"), F.count_if(v < 0).alias("negative_count"))
    return out.join(F.broadcast(quarters), "column_name")  # a row per column


def iqr_outliers(df: DataFrame, columns: list[str], factor: float = 1.5) -> DataFrame:
    """column_name, low, high, outliers: values beyond factor interquartile ranges from the quartiles (rounded to 4 places)."""
    quarter = quantile_rows(df, columns, {"p25": 0.25, "p75": 0.75}).select("column_name", F.round("p25", 4).alias("q1"), F.round("p75", 4).alias("q3"))
    fences = quarter.select("column_name", (F.col("q1") - factor * (F.col("q3") - F.col("q1"))).alias("low"), (F.col("q3") + factor * (F.col("q3") - F.col("q1"))).alias("high"))
    long = _long(df, columns, "double").join(F.broadcast(fences), "column_name")  # a row per column
    return long.groupBy("column_name", "low", "high").agg(F.count_if((F.col("v") < F.col("low")) | (F.col("v") > F.col("high"))).alias("outliers"))


def categorical_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """column_name, unique_values, top_value, top_share (of all rows), entropy (natural log): ties by value."""
    counts = _long(df, columns, "string").groupBy("column_name", "v").agg(F.count(F.lit(1)).alias("n"))
    every = counts.groupBy("column_name").agg(F.sum("n").alias("n_rows"), F.sum(F.when(F.col("v").isNotNull(), F.col("n"))).alias("populated"), F.max(F.when(F.col("v").isNotNull(), F.col("n"))).alias("most"))
    p = F.col("n") / F.col("populated")
    full = counts.filter("v is not null").join(F.broadcast(every), "column_name")  # a row per column
    return full.groupBy("column_name").agg(F.count(F.lit(1)).alias("unique_values"), F.min(F.when(F.col("n") == F.col("most"), F.col("v"))).alias("top_value"), F.max(F.col("most") / F.col("n_rows")).alias("top_share"), F.sum(-p * F.ln(p)).alias("entropy"))


def correlations(df: DataFrame, columns: list[str], keep: int | None = 20) -> DataFrame:
    """column_a, column_b, r, strength of all pairs in one job, the strongest first; rows with a null in the pair don't count for it."""
    pairs = [(a, b) for k, a in enumerate(columns) for b in columns[k + 1 :]]
    wide = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"{k}") for k, (a, b) in enumerate(pairs)])
    rows = F.array(*[F.struct(F.lit(a).alias("column_a"), F.lit(b).alias("column_b"), F.col(f"`{k}`").alias("r")) for k, (a, b) in enumerate(pairs)])
    out = wide.select(F.explode(rows).alias("x")).select("x.*").filter("r is not null and not isnan(r)")
    return out.withColumn("strength", F.when(F.abs("r") >= 0.7, "strong").when(F.abs("r") >= 0.4, "moderate").otherwise("weak")).orderBy(F.desc(F.abs("r")), "column_a", "column_b").limit(len(pairs) if keep is None else keep)


def date_profile(df: DataFrame, column: str) -> DataFrame:
    """earliest, latest, range_days, valid, nulls, median_gap, granularity of the distinct days."""
    day = df.select(F.to_date(F.try_to_timestamp(F.col(column).cast("string"))).alias("d"))
    ends = day.agg(F.min("d").alias("earliest"), F.max("d").alias("latest"), F.count("d").alias("valid"), F.count_if(F.col("d").isNull()).alias("nulls"))
    days = day.filter("d is not null").distinct()
    # gaps inside a month, and from each month's last day to the next month's first: no window runs over all days at once
    month = F.trunc("d", "month")
    inner = days.withColumn("m", month).withColumn("gap", F.datediff("d", F.lag("d").over(Window.partitionBy("m").orderBy("d"))))
    edges = inner.groupBy("m").agg(F.min("d").alias("first"), F.max("d").alias("last"))
    between = edges.select(F.datediff("first", F.lag("last").over(Window.orderBy("m"))).alias("gap"))  # a row per month
    gap = inner.select("gap").unionByName(between).agg(F.percentile("gap", F.lit(0.5)).alias("median_gap"))
    grain = F.when(F.col("median_gap") <= 1.5, "daily").when(F.col("median_gap") <= 8, "weekly").when(F.col("median_gap") <= 32, "monthly").otherwise("irregular")
    return ends.crossJoin(gap).select("earliest", "latest", F.datediff("latest", "earliest").alias("range_days"), "valid", "nulls", "median_gap", grain.alias("granularity"))  # one row each


def monthly_counts(df: DataFrame, column: str, months: int | None = 24) -> DataFrame:
    """month (yyyy-MM), n of the first months, or of all if ``months`` is None."""
    out = df.filter(F.col(column).isNotNull()).groupBy(F.date_format(column, "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n")).orderBy("month")
    return out if months is None else out.limit(months)


def split_half(df: DataFrame, order: list[str], value: str) -> DataFrame:
    """n, first_mean, second_mean, change_percent, direction of the first n // 2 rows against the rest; null with fewer than 4 rows.

    ``order``: a time or number, then a number that tells equal ones apart. The last row of
    the first half is found by selecting its rank, not by numbering the rows.
    """
    first, second = order
    seconds = lambda c: F.unix_micros(F.col(c).cast("timestamp")) if "timestamp" in dict(df.dtypes)[c] else F.col(c)
    rows = df.filter(F.col(value).isNotNull()).select(seconds(first).cast("double").alias("a"), F.col(second).cast("double").alias("b"), F.col(value).cast("double").alias("v"))
    n, low, high = rows.agg(F.count(F.lit(1)), F.min("a"), F.max("a")).first()
    if n < 4:
        return rows.sparkSession.createDataFrame([], "n bigint, first_mean double, second_mean double, change_percent double, direction string")
    edge = select_ranks(long_values(rows, ["a"]), {"a": {n // 2 - 1}}, {"a": (low, high)})["a", n // 2 - 1]
    before, least, most = rows.agg(F.count_if(F.col("a") < edge), F.min(F.when(F.col("a") == edge, F.col("b"))), F.max(F.when(F.col("a") == edge, F.col("b")))).first()
    place = n // 2 - 1 - before
    tie = select_ranks(long_values(rows.filter(F.col("a") == edge), ["b"]), {"b": {place}}, {"b": (least, most)})["b", place]
    is_first = (F.col("a") < edge) | (F.col("a") == edge) & (F.col("b") <= tie)
    out = rows.agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(is_first, F.col("v"))).alias("first_mean"), F.avg(F.when(~is_first, F.col("v"))).alias("second_mean"))
    change = 100.0 * (F.col("second_mean") - F.col("first_mean")) / F.nullif(F.abs("first_mean"), F.lit(0.0))
    return out.withColumn("change_percent", change).withColumn("direction", F.when(F.abs(change) < 5, "stable").when(change > 0, "rising").when(change < 0, "falling"))


def segments(df: DataFrame, dimension: str, metric: str, kind: str = "sum", top: int | None = SEGMENT_TOP) -> DataFrame:
    """segment, value, n, share (percent of the segments kept), place: sum, count or avg of a metric by a dimension."""
    value = {"sum": F.sum, "count": F.count, "avg": F.avg}[kind](F.col(metric))
    kept = df.filter(F.col(dimension).isNotNull()).groupBy(F.col(dimension).cast("string").alias("segment")).agg(value.alias("value"), F.count(F.lit(1)).alias("n"))
    kept = kept if top is None else kept.orderBy(F.desc("value"), "segment").limit(top)
    every = Window.partitionBy()  # at most ``top`` rows, or one for each value of the dimension
    return kept.select("segment", "value", "n", (100.0 * F.col("value") / F.nullif(F.sum("value").over(every), F.lit(0.0))).alias("share"), F.row_number().over(Window.orderBy(F.desc("value"), "segment")).alias("place"))


def segment_dimensions(df: DataFrame, columns: list[str]) -> DataFrame:
    """column_name, distinct_values of the columns that can serve as dimensions: 2 to 50 values, at least 10 rows."""
    counts = _long(df, columns, "string").filter("v is not null").groupBy("column_name", "v").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("column_name").agg(F.count(F.lit(1)).alias("distinct_values"), F.sum("n").alias("n_rows")).filter(f"distinct_values between {DIMENSION_VALUES[0]} and {DIMENSION_VALUES[1]} and n_rows >= {SEGMENT_ROWS}")


def top_and_bottom(segments_: DataFrame, n: int = 5) -> DataFrame:
    """The n first and n last segments by value, tagged."""
    top = segments_.orderBy(F.desc("value"), "segment").limit(n).withColumn("side", F.lit("top"))
    return top.unionByName(segments_.orderBy("value", "segment").limit(n).withColumn("side", F.lit("bottom")))


def ratio_metrics(df: DataFrame, by: list[str], ratios: dict[str, tuple[str, str]]) -> DataFrame:
    """Derived metrics sum(a) / sum(b) by group; null where the denominator is 0."""
    return df.groupBy(*by).agg(*[(F.sum(a) / F.nullif(F.sum(b).cast("double"), F.lit(0.0))).alias(name) for name, (a, b) in ratios.items()])


def business_kpis(df: DataFrame, revenue: Column, cost: Column, quantity: str, price: Column, customer: str) -> DataFrame:
    """revenue, cost, profit, margin_percent, quantity, avg_price, customers in one row."""
    r, c = F.sum(revenue), F.sum(cost)
    return df.agg(r.alias("revenue"), c.alias("cost"), (r - c).alias("profit"), (100.0 * (r - c) / F.nullif(r, F.lit(0.0))).alias("margin_percent"), F.sum(quantity).alias("quantity"), F.avg(price).alias("avg_price"), F.count_distinct(customer).alias("customers"))


def _flags(*rules: tuple[str, Column, str | Column]) -> Column:
    items = [F.when(test, F.struct(F.lit(code).alias("rule"), (F.lit(level) if isinstance(level, str) else level).alias("severity"))) for code, test, level in rules]
    return F.array_compact(F.array(*items))


def numeric_anomalies(df: DataFrame, columns: list[str]) -> DataFrame:
    """column_name, rule, severity from numeric profiles: missing values, extremes, outliers, spread."""
    p = numeric_profile(df, columns).join(iqr_outliers(df, columns), "column_name")
    missing = F.col("null_count") / F.col("n_rows")
    density = F.col("outliers") / F.col("n_rows")
    spread = F.abs(F.col("std_value") / F.nullif(F.col("mean_value"), F.lit(0.0)))
    ratio = F.abs(F.col("max_value") / F.nullif(F.col("min_value"), F.lit(0.0)))
    level = lambda x, hi: F.when(x >= hi, "high").otherwise("medium")
    rules = _flags(
        ("missing", missing >= 0.10, level(missing, 0.25)),
        ("extreme_range", (ratio > 1000) | (F.col("max_value") > 10 * F.col("mean_value")) & (F.col("mean_value") > 0), "medium"),
        ("outlier_density", density >= 0.10, level(density, 0.20)),
        ("dispersion", spread > 2, F.when(spread > 5, "high").otherwise("medium")),
    )
    return p.select("column_name", F.explode(rules).alias("f")).select("column_name", "f.rule", "f.severity")


def categorical_anomalies(df: DataFrame, columns: list[str]) -> DataFrame:
    """column_name, rule, severity from categorical profiles: dominance and low entropy."""
    p = categorical_profile(df, columns)
    rules = _flags(("dominance", F.col("top_share") >= 0.80, F.when(F.col("top_share") >= 0.90, "high").otherwise("medium")), ("low_entropy", (F.col("entropy") < 0.30) & (F.col("unique_values") > 1), "low"))
    return p.select("column_name", F.explode(rules).alias("f")).select("column_name", "f.rule", "f.severity")


def readiness(df: DataFrame, numeric: list[str], categorical: list[str], dates: list[str]) -> DataFrame:
    """score (0 to 100, five times 20) and level of a dataset: size, completeness, numeric, categorical and date columns."""
    columns = [*numeric, *categorical, *dates]
    some = df.agg(F.count(F.lit(1)).alias("n_rows"), *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in columns])
    missing = sum((F.col(f"null_{c}") for c in columns), F.lit(0))
    complete = 1 - missing / F.nullif(F.col("n_rows") * len(columns), F.lit(0))
    size = F.when(F.col("n_rows") >= 100, 20).when(F.col("n_rows") >= 30, 10).otherwise(0)
    score = size + F.when(complete >= 0.95, 20).when(complete >= 0.80, 10).otherwise(0) + F.lit(20 * bool(numeric) + 20 * bool(categorical) + 20 * bool(dates))
    return some.select("n_rows", F.round(100 * complete, 2).alias("completeness"), score.cast("int").alias("score"), F.when(score >= 80, "ready").when(score >= 50, "partial").otherwise("not_ready").alias("level"))
