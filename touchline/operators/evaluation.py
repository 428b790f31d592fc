"""Evaluation measures: precision and recall, confusion, agreement, ranked retrieval, strata, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def precision_recall(df: DataFrame, truth: Column, found: Column) -> DataFrame:
    """One row of counts and rates; a rate without a denominator is 0."""
    n = lambda c: F.count_if(c)
    out = df.agg(n(truth & found).alias("tp"), n(~truth & found).alias("fp"), n(truth & ~found).alias("fn"))
    rate = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.expr(b).cast("double")), F.lit(0.0))
    return out.withColumn("precision", rate("tp", "tp + fp")).withColumn("recall", rate("tp", "tp + fn")).withColumn("f1", F.coalesce(F.try_divide(2.0 * F.col("tp"), (2 * F.col("tp") + F.col("fp") + F.col("fn")).cast("double")), F.lit(0.0)))


def cohen_kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """Agreement of two binary judges beyond chance: n, agree, kappa (null where chance agreement is 1)."""
    out = df.agg(F.count("*").alias("n"), F.count_if(F.col(a) == F.col(b)).alias("agree"), F.avg(F.col(a).cast("double")).alias("pa"), F.avg(F.col(b).cast("double")).alias("pb"))
    chance = F.col("pa") * F.col("pb") + (1 - F.col("pa")) * (1 - F.col("pb"))
    return out.select("n", "agree", F.try_divide(F.col("agree") / F.col("n") - chance, 1 - chance).alias("kappa"))


def recall_and_rank(ranked: DataFrame, relevant: DataFrame, query: str, item: str, place: str, k: int) -> DataFrame:
    """Per query with relevant items: recall at k and reciprocal rank of the first relevant one (0 without)."""
    total = relevant.groupBy(query).agg(F.count("*").alias("n_relevant"))
    hit = ranked.join(relevant, [query, item], "left_semi").groupBy(query).agg(F.count_if(F.col(place) <= k).alias("hits"), F.min(place).alias("first"))
    return total.join(hit, query, "left").select(query, "n_relevant", (F.coalesce("hits", F.lit(0)) / F.col("n_relevant")).alias("recall"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("reciprocal_rank"))


def match_multisets(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Greedy one-to-one matching of equal rows: how many of each key are matched, only in a, only in b."""
    x, y = a.groupBy(*keys).agg(F.count("*").alias("na")), b.groupBy(*keys).agg(F.count("*").alias("nb"))
    na, nb = F.coalesce("na", F.lit(0)), F.coalesce("nb", F.lit(0))
    return x.join(y, keys, "full_outer").select(*keys, F.least(na, nb).alias("matched"), F.greatest(na - nb, F.lit(0)).alias("only_a"), F.greatest(nb - na, F.lit(0)).alias("only_b"))


def weighted_estimate(df: DataFrame, stratum: str, reviewed: Column, hit: Column) -> DataFrame:
    """Share of hits over all strata, each reviewed row standing for size / reviewed rows of its stratum."""
    per = df.groupBy(stratum).agg(F.count("*").alias("size"), F.count_if(reviewed).alias("seen"), F.count_if(reviewed & hit).alias("hits")).where("seen > 0")
    return per.agg(F.sum("size").alias("size"), (F.sum(F.col("size") * F.col("hits") / F.col("seen")) / F.sum("size")).alias("share"))


def stratified_sample(df: DataFrame, stratum: str, key: str, quota: int, seed: str) -> DataFrame:
    """quota rows of each stratum in the order of a seeded digest of the key."""
    w = Window.partitionBy(stratum).orderBy(F.md5(F.concat(F.lit(seed), F.col(key).cast("string"))), key)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= quota).drop("_n")
