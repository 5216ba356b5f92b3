"""Rules of a dataset's report: anomalies of the whole, trends, and the comparison with an earlier run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .dataset import categorical_profile, correlations, numeric_profile
from .profile import histogram

# Most pairs of metric and dimension that are broken down at once.
PAIRS = 12


def _rows(one: DataFrame, *rules: tuple[str, str, Column]) -> DataFrame:
    """subject, rule, level of the rules whose level isn't null, from one row of figures."""
    items = F.array(*[F.struct(F.lit(s).alias("subject"), F.lit(r).alias("rule"), level.alias("level")) for s, r, level in rules])
    return one.select(F.explode(items).alias("x")).select("x.*").filter("level is not null")


def dataset_anomalies(df: DataFrame, columns: list[str], numeric: list[str], halves: DataFrame | None = None, bins: int = 10) -> DataFrame:
    """subject, rule, level: completeness (below 80 %, 95 %), few rows (below 30, 100), a trend of 200 % or more (``halves``: change_percent), histograms of which more than half the bins are empty, and correlations of 0.90 or more."""
    one = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"null_{k}") for k, c in enumerate(columns)])
    nulls = sum((F.col(f"null_{k}") for k in range(len(columns))), F.lit(0))
    complete = 100.0 * (1 - nulls / F.nullif(F.col("n") * len(columns), F.lit(0)))
    out = _rows(one, ("dataset", "completeness", F.when(complete < 80, "high").when(complete < 95, "medium")), ("dataset", "few_rows", F.when(F.col("n") < 30, "high").when(F.col("n") < 100, "medium")))
    if halves is not None:
        out = out.unionByName(_rows(halves, ("dataset", "strong_trend", F.when(F.abs("change_percent") >= 200, "medium"))))
    sparse = None
    for c in numeric:
        share = histogram(df, c, bins).agg(F.count(F.lit(1)).alias("bins"), (F.count_if(F.col("n") == 0) / F.count(F.lit(1))).alias("empty")).select(F.lit(c).alias("subject"), "bins", "empty")
        sparse = share if sparse is None else sparse.unionByName(share)
    if sparse is not None:
        out = out.unionByName(sparse.filter("bins >= 5 and empty > 0.5").select("subject", F.lit("sparse_histogram").alias("rule"), F.lit("medium").alias("level")))
    if len(numeric) > 1:
        strong = correlations(df, numeric, None).filter("abs(r) >= 0.90")
        out = out.unionByName(strong.select(F.concat_ws("~", "column_a", "column_b").alias("subject"), F.lit("correlated").alias("rule"), F.lit("medium").alias("level")))
    return out


def trend_rules(df: DataFrame, numeric: list[str], categorical: list[str], month: Column, halves: DataFrame) -> DataFrame:
    """subject, rule, level: direction of the halves, completeness, concentration of a category, spread of a number, and monthly volume."""
    change = F.col("change_percent")
    way = F.when(F.abs(change) <= 5, "stable").when(change > 0, "up").otherwise("down")
    out = _rows(halves, ("dataset", "direction", way), ("dataset", "strength", F.when(F.abs(change) >= 100, "high").when(F.abs(change) >= 30, "medium").otherwise("low")))
    columns = [*numeric, *categorical]
    one = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"null_{k}") for k, c in enumerate(columns)])
    complete = 100.0 * (1 - sum((F.col(f"null_{k}") for k in range(len(columns))), F.lit(0)) / F.nullif(F.col("n") * len(columns), F.lit(0)))
    out = out.unionByName(_rows(one, ("dataset", "completeness", F.when(complete >= 98, "high").when(complete >= 80, "medium").otherwise("low"))))
    if categorical:
        # the most concentrated category, the spread of the widest number: a row per column
        top = categorical_profile(df, categorical).select("top_share", F.col("column_name").alias("c")).agg(F.max(F.struct("top_share", "c")).alias("m"))
        level = F.when(F.col("m.top_share") >= 0.80, "high").when(F.col("m.top_share") >= 0.50, "medium").otherwise("low")
        out = out.unionByName(top.select(F.col("m.c").alias("subject"), F.lit("concentration").alias("rule"), level.alias("level")))
    if numeric:
        ratio = F.abs((F.col("max_value") - F.col("min_value")) / F.nullif(F.col("mean_value"), F.lit(0.0)))
        wide = numeric_profile(df, numeric).select(ratio.alias("ratio"), F.col("column_name").alias("c")).filter("ratio is not null").agg(F.max(F.struct("ratio", "c")).alias("m")).filter("m is not null")
        out = out.unionByName(wide.select(F.col("m.c").alias("subject"), F.lit("spread").alias("rule"), F.when(F.col("m.ratio") > 10, "medium").otherwise("low").alias("level")))
    months = df.select(month.alias("month")).filter("month is not null").groupBy("month").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.orderBy("month"))  # a row per month
    numbered = months.select("n", place.alias("place"), F.count(F.lit(1)).over(Window.partitionBy()).alias("all")).filter(F.col("all") >= 3)
    is_first = F.col("place") <= F.expr("`all` div 2")
    volume = numbered.agg(F.avg(F.when(is_first, F.col("n"))).alias("a"), F.avg(F.when(~is_first, F.col("n"))).alias("b")).filter("a is not null")
    return out.unionByName(_rows(volume, ("dataset", "monthly_volume", F.when(F.col("b") > 1.15 * F.col("a"), "rising").when(F.col("b") < 0.85 * F.col("a"), "falling").otherwise("steady"))))


#: Metrics of which less is better, and those that are only good or neutral.
LESS_IS_BETTER, NEVER_BAD = ("High-Severity Anomalies", "High-Priority Recommendations"), ("Upward Trend Signals",)


def compare_runs(now: DataFrame, before: DataFrame, tolerance: dict[str, float] | None = None) -> DataFrame:
    """metric, current_value, previous_value, change, change_type, severity of metrics (metric, value) that both runs have; ``tolerance``: changes below it are none."""
    change = F.round(F.col("current_value") - F.col("previous_value"), 2)
    least = F.coalesce(*[F.when(F.col("metric") == m, t) for m, t in (tolerance or {}).items()], F.lit(0.0))
    still = (change == 0) | (F.abs(change) < least)
    better = F.when(F.col("metric").isin(*LESS_IS_BETTER), change < 0).otherwise(change > 0)
    severity = F.when(still, "neutral").when(better, "positive").when(F.col("metric").isin(*NEVER_BAD), "neutral").otherwise("warning")
    both = now.select("metric", F.col("value").alias("current_value")).join(before.select("metric", F.col("value").alias("previous_value")), "metric").filter("current_value is not null and previous_value is not null")
    return both.select("metric", "current_value", "previous_value", change.alias("change"), F.when(still, "stable").when(change > 0, "increase").otherwise("decrease").alias("change_type"), severity.alias("severity"))


def segment_pairs(df: DataFrame, metrics: list[str], dimensions: list[str], pairs: int | None = PAIRS) -> DataFrame:
    """metric, dimension, segment, value (sum), n, share (percent of the metric over all segments) of every pair of metric and dimension, in one pass over the rows; ``pairs``: most pairs, metric by metric, None: all."""
    asked = [(m, x) for m in metrics for x in dimensions][:pairs]
    items = F.array(*[F.struct(F.lit(m).alias("metric"), F.lit(x).alias("dimension"), F.col(f"`{x}`").cast("string").alias("segment"), F.col(f"`{m}`").cast("double").alias("v")) for m, x in asked])
    sums = df.select(F.explode(items).alias("x")).select("x.*").filter("segment is not null").groupBy("metric", "dimension", "segment").agg(F.sum("v").alias("value"), F.count("v").alias("n"))
    every = sums.groupBy("metric", "dimension").agg(F.sum("value").alias("all"))
    return sums.join(F.broadcast(every), ["metric", "dimension"]).select("metric", "dimension", "segment", "value", "n", (100.0 * F.col("value") / F.nullif(F.col("all"), F.lit(0.0))).alias("share"))  # a row per pair


def graph_summary(tables: DataFrame, edges: DataFrame) -> DataFrame:
    """One row of tables, relationships, sources (tables with foreign keys), density and isolated tables; tables: table_name, edges: from_table, to_table."""
    linked = edges.select(F.col("from_table").alias("table_name")).union(edges.select("to_table")).distinct().withColumn("hit", F.lit(1))
    nodes = tables.select("table_name").distinct().join(linked, "table_name", "left").agg(F.count(F.lit(1)).alias("n_tables"), F.count_if(F.col("hit").isNull()).alias("isolated"))
    arcs = edges.agg(F.count(F.lit(1)).alias("relationships"), F.count_distinct("from_table").alias("sources"))
    return nodes.crossJoin(F.broadcast(arcs)).withColumn("density", F.round(F.col("relationships") / F.nullif(F.col("n_tables"), F.lit(0)), 3))  # one row each


def related_tables(edges: DataFrame, start: str) -> DataFrame:
    """table_name, direction (references, referenced_by), links of the tables next to one."""
    out = edges.filter(F.col("from_table") == start).select(F.col("to_table").alias("table_name"), F.lit("references").alias("direction"))
    back = edges.filter(F.col("to_table") == start).select(F.col("from_table").alias("table_name"), F.lit("referenced_by").alias("direction"))
    return out.unionByName(back).groupBy("table_name", "direction").agg(F.count(F.lit(1)).alias("links"))
