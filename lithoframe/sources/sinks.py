"""Sinks: files, append-only snapshots, upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def append_snapshot(df: DataFrame, path: str, taken_at: Column) -> None:
    """Add rows to an append-only table, stamped with the time given."""
    df.withColumn("created_at", taken_at).write.mode("append").parquet(path)


def latest_per_key(df: DataFrame, keys: list[str], newest: list[Column]) -> DataFrame:
    """One row of each key: the newest."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*newest))
    return df.withColumn("__place", place).filter("__place = 1").drop("__place")


def upsert(stored: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """ON CONFLICT DO UPDATE: incoming rows replace stored rows of the same key."""
    return stored.join(incoming.select(*keys).distinct(), keys, "left_anti").unionByName(incoming)


def insert_ignore(stored: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """ON CONFLICT DO NOTHING: stored rows stay, incoming rows of new keys are added."""
    return stored.unionByName(incoming.join(stored.select(*keys).distinct(), keys, "left_anti"))
