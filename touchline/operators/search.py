"""Full-text search without an index, rank fusion, and dictionary linking."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import plain_letters


def first_hits(terms: list[str], prefix_from: int) -> list[str]:
    """Expressions that find the words of each term, without those that an earlier term has; none for a term that earlier ones cover, or
    that no word can have."""
    out, terms = [], [t for t in terms if re.fullmatch("[a-z0-9]+", t)]
    for k, t in enumerate(terms):
        if any(t == x or (len(x) >= prefix_from and t.startswith(x)) for x in terms[:k]):
            continue
        whole = len(t) < prefix_from
        longer = "" if whole else "".join(f"(?!{x[len(t):]}{'' if len(x) >= prefix_from else '(?![a-z0-9])'})" for x in terms[:k] if x.startswith(t))
        out.append(f"{t}(?<![a-z0-9]{t}){'(?![a-z0-9])' if whole else longer}")  # the letters first: they are searched for without trying each place
    return out


def full_text(docs: DataFrame, id_col: str, text_col: str, terms: list[str], depth: int, prefix_from: int = 3) -> DataFrame:
    """Documents with any query term, terms of prefix_from letters or more as prefixes: most distinct terms matched, then
    highest count, then highest id; place, id, matched, tf. A word counts for the first term that it matches. No terms give nothing.

    Each document is scored where it is read; what is shuffled are the best rows of each partition.
    """
    if not terms:
        return docs.where("false").select(F.lit(0).cast("bigint").alias("place"), F.col(id_col).alias("id"), F.lit(0).cast("bigint").alias("matched"), F.lit(0).cast("bigint").alias("tf"))
    scored = docs.select(F.col(id_col).alias("id"), plain_letters(F.col(text_col)).alias("words"))
    scored = scored.select("id", *[F.regexp_count("words", F.lit(p)).alias(f"_{k}") for k, p in enumerate(first_hits(terms, prefix_from))])
    counts = [F.coalesce(f"_{k}", F.lit(0)) for k in range(len(scored.columns) - 1)]
    matched, tf = sum(((n > 0).cast("bigint") for n in counts), F.lit(0)), sum((n.cast("bigint") for n in counts), F.lit(0))
    scored = scored.select("id", matched.cast("bigint").alias("matched"), tf.cast("bigint").alias("tf"))
    top = scored.orderBy(F.desc("matched"), F.desc("tf"), F.desc("id")).limit(depth).where("tf > 0")  # after the limit: before it, the texts would be searched once more
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("matched"), F.desc("tf"), F.desc("id"))).cast("bigint"))


def fuse(legs: list[DataFrame], by: list[str], k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of legs (by, place, id): sum of 1 / (k + place) for each query; order by score, best place, id."""
    both = None
    for leg in legs:
        leg = leg.select(*by, "place", "id")
        both = leg if both is None else both.union(leg)
    return both.groupBy(*by, "id").agg(F.sum(1 / (F.lit(k) + F.col("place"))).alias("score"), F.min("place").alias("best"))


def resolve(mentions: DataFrame, keys: DataFrame, mention: str = "mention") -> DataFrame:
    """Per mention the candidates of its lowest matching tier: (mention, target, tier). keys: (key, target, tier)."""
    hit = mentions.join(keys, mentions[mention] == keys["key"]).select(mentions[mention], "target", "tier")
    return hit.withColumn("_low", F.min("tier").over(Window.partitionBy(mention))).where("tier = _low").drop("_low").distinct()
