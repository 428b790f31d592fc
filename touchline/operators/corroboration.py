"""Corroboration of all topics at once: the anchor and what it reverses, the accounts for and against it, the grade and its reasons.

A topic is what is looked at (a player in a window, say). Every step is a join on the topic or an aggregate that is formed before the
shuffle; no topic's claims are gathered in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import asof, rules


def _against(a: Column, b: Column) -> Column:
    return F.coalesce(rules.label(a, b) == "contradicts", F.lit(False))


def choose_anchor(claims: DataFrame, flags: DataFrame, topic: list[str], player: str, chosen: DataFrame | None = None) -> DataFrame:
    """topic, anchor_id, anchor_type, anchor_at, reversed_claim, reversed_flag, way: one row per topic that has a claim.

    claims: topic, post_id, created, type; player is one of topic. flags: player, flag_id, observed_at, status ('a' is available).
    chosen: topic, chosen_id; a post that is no claim of the topic counts as not chosen. The candidate is the chosen claim, else the
    newest (by time, then id). Another type than available is the anchor ('claim'). An available one is only where it is the newest and
    reverses the newest older claim ('claim reversed') or a flag that held at its moment ('flag reversed'); else the newest claim of
    another type steps in ('fallback'), unless being available contradicts it; then there is no anchor ('none', nulls).
    """
    key = F.struct("created", "post_id", "type")
    per = claims.groupBy(*topic).agg(F.max(key).alias("newest"), F.max(F.when(F.col("type") != "available", key)).alias("other"))
    if chosen is None:
        per = per.withColumn("candidate", F.col("newest"))
    else:
        found = claims.join(chosen.withColumnRenamed("chosen_id", "post_id"), [*topic, "post_id"]).groupBy(*topic).agg(F.max(key).alias("found"))
        per = per.join(found, topic, "left").withColumn("candidate", F.coalesce("found", "newest")).drop("found")
    older = claims.join(per, topic).groupBy(*topic).agg(*(F.max(F.when(key < F.col(c), key)).alias(f"before_{c}") for c in ("candidate", "other")))
    asked = per.where("candidate.type = 'available' and candidate = newest").select(*topic, F.col("candidate.created").alias("_moment"))
    held = asof.around(asked, flags.select(player, "observed_at", "flag_id"), player, "_moment", "observed_at", "flag_id").select(*topic, F.col("prev_id").alias("flag_id"))
    held = held.join(flags.where("status <> 'a'").select("flag_id"), "flag_id")
    x = per.join(older, topic).join(held, topic, "left")
    c, other = F.col("candidate"), F.col("other")
    earlier = F.when(_against(c["type"], F.col("before_candidate.type")), F.col("before_candidate"))
    direct = c["type"] != "available"
    newest = (~direct) & (c == F.col("newest"))
    steps_in = other.isNotNull() & ~_against(F.lit("available"), other["type"])
    way = F.when(direct, "claim").when(newest & earlier.isNotNull(), "claim reversed").when(newest & F.col("flag_id").isNotNull(), "flag reversed").when(steps_in, "fallback").otherwise("none")
    x = x.withColumn("way", way).withColumn("anchor", F.when(F.col("way") == "fallback", other).when(F.col("way") != "none", c))
    reversed_claim = F.when(F.col("way") == "fallback", F.when(_against(other["type"], F.col("before_other.type")), F.col("before_other"))).when(F.col("way") != "none", earlier)
    return x.select(
        *topic, F.col("anchor.post_id").alias("anchor_id"), F.col("anchor.type").alias("anchor_type"), F.col("anchor.created").alias("anchor_at"),
        reversed_claim["post_id"].alias("reversed_claim"), F.when(F.col("way") == "flag reversed", F.col("flag_id")).alias("reversed_flag"), "way",
    )


def counted(label: Column, author: Column, quoted: Column) -> Column:
    """The account that a post counts for: the quoted one, unless the post contradicts."""
    return F.when((label != "contradicts") & quoted.isNotNull(), quoted).otherwise(author)


def account_lists(labelled: DataFrame, anchors: DataFrame, topic: list[str]) -> DataFrame:
    """topic, side, account, post_id, created, origin: the newest post of each account that is not the anchor and not unrelated. Accounts
    of the anchor neither support nor contradict it.

    labelled: topic, post_id, created, author, quoted, label, origin; anchors: topic, anchor_id, anchor_author, anchor_quoted.
    """
    x = labelled.join(anchors.select(*topic, "anchor_id", "anchor_author", "anchor_quoted"), topic).where("post_id <> anchor_id and label <> 'unrelated'")
    x = x.withColumn("account", counted(F.col("label"), F.col("author"), F.col("quoted")))
    own = (F.col("account") == F.col("anchor_author")) | (F.col("account") == F.coalesce("anchor_quoted", "anchor_author"))
    one = x.groupBy(*topic, "account").agg(F.max_by(F.struct("label", "post_id", "created", "origin", own.alias("own")), F.struct("created", "post_id")).alias("r")).select(*topic, "account", "r.*")
    side = F.when(F.col("label") == "supports", "supporting").when(F.col("label") == "contradicts", "contradicting").otherwise("related")
    return one.where("label = 'related' or not own").select(*topic, side.alias("side"), "account", "post_id", "created", "origin")


def graded(lists: DataFrame, anchors: DataFrame, topic: list[str], credibility: Column) -> DataFrame:
    """topic, weight, grade, reasons. anchors: topic, certainty, anchor_at, new_since; credibility weighs a row of lists.

    reasons say what raised the grade, then what lowered it: a contradicting account new since the last look, a judged contradicting
    post newer than the anchor.
    """
    against = F.col("side") == "contradicting"
    sums = lists.join(anchors.select(*topic, "anchor_at", "new_since"), topic).groupBy(*topic).agg(
        F.sum(F.when(F.col("side") == "supporting", credibility).otherwise(0)).alias("weight"),
        F.bool_or(against & (F.col("created") > F.col("new_since"))).alias("fresh"),
        F.bool_or(against & (F.col("origin") == "judge") & (F.col("created") > F.col("anchor_at"))).alias("newer"),
    )
    x = anchors.join(sums, topic, "left").withColumns({"weight": F.coalesce("weight", F.lit(0)).cast("bigint"), "fresh": F.coalesce("fresh", F.lit(False)), "newer": F.coalesce("newer", F.lit(False))})
    w, sure, likely = F.col("weight"), F.col("certainty") == "confirmed", F.col("certainty") == "likely"
    high, medium = (w >= 2) | (sure & (w >= 1)), sure | likely | (w >= 1)
    raised = F.when(high, F.concat_ws(",", F.when(sure & (w >= 1), "confirmed with support"), F.when(w >= 2, "weight"))).when(medium, F.concat_ws(",", F.when(sure | likely, F.col("certainty")), F.when(w >= 1, "weight"))).otherwise("little")
    lowered = F.concat_ws(",", F.when(F.col("fresh"), "new contradiction"), F.when(F.col("newer"), "newer contradiction"), F.when(~high & ~medium & (F.col("fresh") | F.col("newer")), "already low"))
    reasons = F.concat_ws(";", raised, F.when(lowered != "", lowered))
    return x.select(*topic, "weight", rules.grade(w, F.col("certainty"), F.col("fresh") | F.col("newer")).alias("grade"), reasons.alias("reasons"))
