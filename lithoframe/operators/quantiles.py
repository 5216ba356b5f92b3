"""Exact order statistics without a sort of all rows or an aggregate that holds them.

The k-th smallest values of many columns are found together by narrowing intervals:
each pass counts, for every interval that is still open, how many of its values fall
into each of ``BINS`` equal parts, with the least and greatest value of each part; the
part that holds the wanted rank is the next interval. An interval ends when its least
and greatest values are equal. What goes to the driver is a row for each column and
wanted rank in each pass; what is shuffled is the parts' counts, combined beforehand.
A pass narrows an interval by a factor of ``BINS``, so usual columns need two to five.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BINS = 4096


def long_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """column_name, v (double) of all values that are neither null nor NaN."""
    rows = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("double").alias("v")) for c in columns])).alias("x")).select("x.*")
    return rows.filter("v is not null and not isnan(v)")


def select_ranks(values: DataFrame, wanted: dict[str, set[int]], ends: dict[str, tuple[float, float]]) -> dict[tuple[str, int], float]:
    """The value at each rank (from 0) of each column; ``ends``: the least and greatest value of each column."""
    found: dict[tuple[str, int], float] = {}
    # open intervals: (column, low, high) -> {rank: rank within the interval}
    live = {(c, *ends[c]): {r: r for r in ranks} for c, ranks in wanted.items() if c in ends}
    spark = values.sparkSession
    while live:
        for key in [k for k in live if k[1] == k[2]]:
            found |= {(key[0], r): key[1] for r in live.pop(key)}
        if not live:
            break
        keys = list(live)
        table = spark.createDataFrame([(i, *k) for i, k in enumerate(keys)], "i int, column_name string, low double, high double")
        inside = values.join(F.broadcast(table), "column_name").filter("v >= low and v <= high")  # as many rows as columns times ranks
        # halves first: the width of an interval may be more than a double holds
        part = F.floor(((F.col("v") / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2)) * BINS)
        counts = inside.select("i", "v", F.least(F.lit(BINS - 1), part.cast("int")).alias("bin")).groupBy("i", "bin").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        upto = counts.withColumn("upto", F.sum("n").over(Window.partitionBy("i").orderBy("bin")))  # at most BINS rows of each interval
        asked = spark.createDataFrame([(i, r, p) for i, k in enumerate(keys) for r, p in live[k].items()], "i int, rank bigint, place bigint")
        rows = upto.join(F.broadcast(asked), "i").filter("place < upto and place >= upto - n").select("i", "rank", (F.col("place") - F.col("upto") + F.col("n")).alias("place"), "low", "high").collect()
        narrowed: dict[tuple[str, float, float], dict[int, int]] = {}
        for r in rows:
            narrowed.setdefault((keys[r.i][0], r.low, r.high), {})[r["rank"]] = r.place
        live = narrowed
    return found


def quantiles(df: DataFrame, columns: list[str], points: tuple[float, ...]) -> dict[str, list[float | None]]:
    """For each column its interpolated quantiles at the points (0 to 1); None for a column without values."""
    values = long_values(df, columns)
    sizes = {r.column_name: r for r in values.groupBy("column_name").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).collect()}  # a row per column
    places = {c: [(r.n - 1) * p for p in points] for c, r in sizes.items()}
    wanted = {c: {int(x) for x in at} | {min(int(x) + 1, sizes[c].n - 1) for x in at} for c, at in places.items()}
    found = select_ranks(values, wanted, {c: (r.low, r.high) for c, r in sizes.items()})

    def at(c: str, x: float) -> float:
        low, high = found[c, int(x)], found[c, min(int(x) + 1, sizes[c].n - 1)]
        return low if x == int(x) else (int(x) + 1 - x) * low + (x - int(x)) * high

    return {c: [at(c, x) for x in places[c]] if c in places else [None] * len(points) for c in columns}


def quantile_rows(df: DataFrame, columns: list[str], points: dict[str, float]) -> DataFrame:
    """column_name and a column for each named point; a row per column."""
    found = quantiles(df, columns, tuple(points.values()))
    return df.sparkSession.createDataFrame([(c, *found[c]) for c in columns], "column_name string, " + ", ".join(f"{n} double" for n in points))
