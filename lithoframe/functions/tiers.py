"""Rates, tiers, shapes of distributions and quality grades, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def percentage(part: Column, whole: Column) -> Column:
    """Null if the whole is null or 0."""
    return 100.0 * part / F.nullif(whole.cast("double"), F.lit(0.0))


def row_tier(n: Column) -> Column:
    return F.when(n == 0, "EMPTY").when(n < 1_000, "TINY").when(n < 100_000, "SMALL").when(n < 1_000_000, "MEDIUM").when(n < 10_000_000, "LARGE").otherwise("VERY_LARGE")


def cardinality_tier(distinct: Column, populated: Column) -> Column:
    """CONSTANT, BINARY, UNIQUE, HIGH, MEDIUM or LOW, the first that fits; null without values."""
    share = distinct / F.nullif(populated.cast("double"), F.lit(0.0))
    tier = F.when(distinct == 1, "CONSTANT").when(distinct == 2, "BINARY").when(distinct >= populated, "UNIQUE").when(share > 0.95, "HIGH").when(share > 0.10, "MEDIUM").otherwise("LOW")
    return F.when(populated > 0, tier)


def currency(latest: Column, as_of: Column) -> Column:
    days = F.datediff(as_of, latest)
    return F.when(latest.isNull(), "UNKNOWN").when(days < 30, "ACTIVE").when(days <= 180, "RECENT").otherwise("HISTORICAL")


def distribution_shape(distinct: Column, null_percent: Column, p25: Column, p50: Column, p75: Column) -> Column:
    """Bowley skewness in words."""
    spread = p75 - p25
    skew = (p75 - 2 * p50 + p25) / F.nullif(spread, F.lit(0.0))
    return F.when(distinct <= 1, "constant").when(null_percent > 80, "sparse").when(spread == 0, "constant").when(F.abs(skew) > 0.5, "highly_skewed").when(skew > 0.1, "right_skewed").when(skew < -0.1, "left_skewed").otherwise("symmetric")


def weighted_quality(completeness: Column, consistency: Column, validity: Column) -> Column:
    """Weights .4, .3, .3 over the dimensions that are there; null if none is."""
    parts = ((completeness, 0.4), (consistency, 0.3), (validity, 0.3))
    total = sum(F.coalesce(c * w, F.lit(0.0)) for c, w in parts)
    weight = sum(F.when(c.isNotNull(), w).otherwise(0.0) for c, w in parts)
    return total / F.nullif(weight, F.lit(0.0))


def quality_grade(score: Column) -> Column:
    return F.when(score >= 90, "A").when(score >= 75, "B").when(score >= 60, "C").when(score >= 40, "D").when(score.isNotNull(), "F")
