"""Streams of posts and flags: late and repeated rows, changes of a key's values, and counts of windows. Keyed tables are written by sources.keyed.sink().

Every function takes a streaming DataFrame and returns one; state is kept per key and is bounded by the
watermark or by the number of keys.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def follow(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """A stream over a folder (or file) of Parquet, with the schema that it has now."""
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def first_seen(stream: DataFrame, keys: list[str], at: str, late: str) -> DataFrame:
    """The first row of each key; copies that come within the lateness are dropped, and a key's state goes after it."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def window_counts(stream: DataFrame, at: str, late: str, width: str, keys: list[str]) -> DataFrame:
    """Rows of each window and key. With append output a window comes once, when the watermark has passed it."""
    return stream.withWatermark(at, late).groupBy(F.window(at, width).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def changes(stream: DataFrame, key: str, order: str, tracked: str) -> DataFrame:
    """(key, order, was, now): each key's rows whose tracked text differs from the row before, the first row included.

    The state is the last value of a key. Rows of one micro-batch are put in order; a row older than the last one of its key is dropped,
    as a flag that has been overtaken. Null is a value of its own; rows with a null key or order are left out.
    """
    kinds = {f.name: f.dataType.simpleString() for f in stream.schema.fields}

    def step(names: tuple, frames, state: GroupState):
        last, before, seen = state.get if state.exists else (None, None, False)
        rows = pd.concat(list(frames)).sort_values(["at", "value"], na_position="first", kind="stable")
        out = []
        for at, value in zip(rows["at"], rows["value"], strict=True):
            value = None if pd.isna(value) else value
            micros = pd.Timestamp(at).value // 1000
            if last is not None and micros < last:
                continue
            if not seen or value != before:
                out.append((names[0], at, before, value))
            last, before, seen = micros, value, True
        state.update((last, before, seen))
        yield pd.DataFrame(out, columns=[key, order, "was", "now"])

    slim = stream.where(F.col(key).isNotNull() & F.col(order).isNotNull()).select(F.col(key), F.col(order).alias("at"), F.col(tracked).cast("string").alias("value"))
    return slim.groupBy(key).applyInPandasWithState(step, f"{key} {kinds[key]}, {order} {kinds[order]}, was string, now string", "last bigint, before string, seen boolean", "append", GroupStateTimeout.NoTimeout)
