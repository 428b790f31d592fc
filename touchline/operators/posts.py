"""Posts and what was extracted from them: current extractions, predicates at read, windows, newness, work lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .latest import latest_per_key

#: Hours between a line-up post and the next start beyond which it is stale.
STALE_HOURS = 60


def current(runs: DataFrame, key: str, order: list[str], ok: str, since: Column, until: Column, at: str) -> DataFrame:
    """The newest successful run of each key inside the half-open window. The window narrows before the choice; any other filter belongs after it."""
    return latest_per_key(runs.where((F.col(at) >= since) & (F.col(at) < until) & F.col(ok)), [key], order)


def with_survivors(runs: DataFrame, found: DataFrame, key: str, item: str) -> DataFrame:
    """Each run with the ordered list of its items that survive in found; a run without any keeps an empty list."""
    lists = found.groupBy(key).agg(F.sort_array(F.collect_set(item)).alias("_items"))
    return runs.join(lists, key, "left").withColumn("items", F.coalesce(F.array_join("_items", ","), F.lit(""))).drop("_items")


def stale(is_lineup: Column, created: Column, next_start: Column) -> Column:
    """A line-up post more than STALE_HOURS before the next start; without a next start it isn't stale."""
    return is_lineup & F.coalesce(F.unix_micros(next_start.cast("timestamp")) - F.unix_micros(created.cast("timestamp")) > STALE_HOURS * 3600 * 10**6, F.lit(False))


def kept_at_read(is_lineup: Column, answer: Column, is_stale: Column) -> Column:
    """What is no line-up stays; an explicit false drops it; otherwise it stays unless it is stale."""
    return F.when(~is_lineup, True).when(F.coalesce(~answer, F.lit(False)), False).otherwise(~is_stale)


def next_of(keys: list[str], at: str, is_start: Column) -> Column:
    """The time of the next starting row strictly after each row, by key."""
    later = Window.partitionBy(*keys).orderBy(F.unix_micros(F.col(at).cast("timestamp"))).rangeBetween(1, Window.unboundedFollowing)
    return F.min(F.when(is_start, F.col(at))).over(later)
