"""Latest rows, change logs and work lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each key that is last by order. One aggregation with map-side maxima, no window sort of whole groups."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, "r.*").select(*df.columns)


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, "r.*").select(*df.columns)


def change_log(df: DataFrame, keys: list[str], order: list[str], tracked: list[str]) -> DataFrame:
    """Rows whose tracked values differ (null-safe) from the row before, and each key's first row."""
    w = Window.partitionBy(*keys).orderBy(*order)
    before = F.lag(F.struct(*tracked)).over(w)
    return df.withColumn("_before", before).where(F.col("_before").isNull() | ~F.struct(*tracked).eqNullSafe(F.col("_before"))).drop("_before")


def retry_list(df: DataFrame, key: str, failed: Column, most: int) -> DataFrame:
    """Keys whose attempts all failed and are fewer than most."""
    return df.groupBy(key).agg(F.count("*").alias("attempts"), F.bool_and(failed).alias("all_failed")).where(F.col("all_failed") & (F.col("attempts") < most)).select(key, "attempts")


def never_processed(df: DataFrame, done: DataFrame, on: list[str]) -> DataFrame:
    return df.join(done, on, "left_anti")
