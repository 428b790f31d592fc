"""Mutation semantics as DataFrame algebra: what a keyed table holds after rows come in. Results are new tables; writers choose the mode."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert(base: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Incoming rows replace those of their key, others stay."""
    return base.join(incoming.select(*keys), keys, "left_anti").unionByName(incoming)


def merge_upsert(base: DataFrame, incoming: DataFrame, keys: list[str], rules: dict[str, Column]) -> DataFrame:
    """Full outer merge. A rule gives a column's new value from base.<c> and incoming.<c> (aliases b and i); without one the incoming value wins where there is one."""
    b, i = base.alias("b"), incoming.alias("i")
    joined = b.join(i, [F.col(f"b.{k}") == F.col(f"i.{k}") for k in keys], "full_outer")
    new, old = F.col(f"b.{keys[0]}").isNull(), F.col(f"i.{keys[0]}").isNull()
    value = lambda c: F.when(new, F.col(f"i.{c}")).when(old, F.col(f"b.{c}")).otherwise(rules.get(c, F.col(f"i.{c}")))
    return joined.select(*[F.coalesce(f"b.{k}", f"i.{k}").alias(k) for k in keys], *[value(c).alias(c) for c in base.columns if c not in keys])


def additive_upsert(base: DataFrame, incoming: DataFrame, keys: list[str], added: list[str]) -> DataFrame:
    """An upsert in which the added columns are summed with what was there."""
    return merge_upsert(base, incoming, keys, {c: F.col(f"b.{c}") + F.col(f"i.{c}") for c in added})


def insert_if_absent(base: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of keys that are not there yet; of several incoming rows of a key one is taken."""
    return base.unionByName(incoming.dropDuplicates(keys).join(base.select(*keys), keys, "left_anti"))


def replace_partitions(base: DataFrame, incoming: DataFrame, partition: list[str]) -> DataFrame:
    """Every partition that incoming has rows of is replaced as a whole (dynamic partition overwrite)."""
    return base.join(incoming.select(*partition).distinct(), partition, "left_anti").unionByName(incoming)


def merge_duplicates(df: DataFrame, key: str, all_true: list[str], any_true: list[str], first_known: dict[str, str]) -> DataFrame:
    """One row per key: flags and-ed or or-ed, and of each other column the first known value by its order column (ties: the smallest)."""
    return df.groupBy(key).agg(
        *[F.bool_and(c).alias(c) for c in all_true],
        *[F.bool_or(c).alias(c) for c in any_true],
        *[F.min_by(c, F.when(F.col(c).isNotNull(), F.struct(o, c))).alias(c) for c, o in first_known.items()],
    )


def lost_members(before: Column, now: Column) -> Column:
    """How many of an array's members are gone: a snapshot that lost too many is refused."""
    return F.size(F.array_except(before, now))
