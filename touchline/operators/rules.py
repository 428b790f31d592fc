"""Corroboration rules: labels of claim pairs, anchors, accounts, grades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Pairs (anchor, other) of event types that contradict each other, in either order.
CONTRADICT = (("available", "out"), ("available", "doubt"), ("benched", "out"), ("confirmed_starter", "out"), ("confirmed_starter", "doubt"), ("confirmed_starter", "benched"))


def label(anchor: Column, other: Column) -> Column:
    against = F.lit(False)
    for a, b in CONTRADICT:
        against = against | ((anchor == a) & (other == b)) | ((anchor == b) & (other == a))
    return F.when(anchor == other, "supports").when(against, "contradicts").otherwise("related")


def newest_per_account(df: DataFrame, topic: list[str], account: str, order: list[str]) -> DataFrame:
    """The newest row of each account on a topic."""
    w = Window.partitionBy(*topic, account).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def grade(weight: Column, certainty: Column, contradicted: Column) -> Column:
    """high from weight 2, or confirmed with 1; medium if confirmed, likely or weight 1; a contradiction takes one step off."""
    level = F.when((weight >= 2) | ((certainty == "confirmed") & (weight >= 1)), 2).when(certainty.isin("confirmed", "likely") | (weight >= 1), 1).otherwise(0)
    return F.element_at(F.array(F.lit("low"), F.lit("medium"), F.lit("high")), F.greatest(level - F.when(contradicted, 1).otherwise(0), F.lit(0)) + 1)
