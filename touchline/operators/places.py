"""Places within groups of any size: rows are dealt by ranges of their order, numbered inside each range, and the ranges' sums are added up.

A window over a group puts the whole group into one task; here a group of a third of all rows spreads over as many tasks as
it fills ranges. What is summed over ranges has one row for each group in each range that it touches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import written


def matched(df: DataFrame, other: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join on keys that may be null; other's keys go."""
    names = {k: f"_key_{k}" for k in keys}
    renamed = other.withColumnsRenamed(names)
    same = [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()]
    return df.join(renamed, same, how).drop(*names.values())


def sum_before(df: DataFrame, groups: list[str], order: list[Column], amount: Column, name: str) -> DataFrame:
    """df and the sum of amount over the rows of its group that come before each row. order must tell a group's rows apart.

    The dealt rows are written before they are numbered: ranges that were sampled anew would not fit their sums.
    """
    dealt = written(df.withColumn("_amount", amount.cast("bigint")).repartitionByRange(*[F.col(g) for g in groups], *order).withColumn("_part", F.spark_partition_id()))
    inside = Window.partitionBy("_part", *groups).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy(*groups, "_part").agg(F.sum("_amount").alias("_sum"))
    offsets = sums.withColumn("_offset", F.coalesce(F.sum("_sum").over(earlier), F.lit(0))).drop("_sum")
    own = dealt.withColumn("_own", F.coalesce(F.sum("_amount").over(inside), F.lit(0)))
    return matched(own, offsets, [*groups, "_part"]).withColumn(name, F.col("_offset") + F.col("_own")).drop("_amount", "_part", "_own", "_offset")


def row_places(df: DataFrame, groups: list[str], order: list[Column], name: str) -> DataFrame:
    """1, 2, ... within each group; order must tell a group's rows apart."""
    return sum_before(df, groups, order, F.lit(1), name).withColumn(name, F.col(name) + 1)


def competition_places(df: DataFrame, groups: list[str], value: str, name: str) -> DataFrame:
    """1 + the rows of the group with a greater value; nulls come last. Equal values are counted before they are dealt, so a value that
    very many rows share is one row there."""
    counts = df.groupBy(*groups, value).agg(F.count("*").alias("_n"))
    placed = sum_before(counts, groups, [F.col(value).desc_nulls_last()], F.col("_n"), name).drop("_n").withColumn(name, F.col(name) + 1)
    return matched(df, placed, [*groups, value])


def with_extremes(df: DataFrame, groups: list[str], value: str, most: str, least: str) -> DataFrame:
    """df with its group's largest and smallest value, from an aggregate that is formed before the shuffle."""
    return matched(df, df.groupBy(*groups).agg(F.max(value).alias(most), F.min(value).alias(least)), groups)
