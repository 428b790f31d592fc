"""Queries on corroboration and alerts. Events stand for claims: the kind is the type of the claim, users are accounts, the number in props is the player, days are slots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import latest, rules
from ..sources.tables import table
from .posts import POSTS, events
from .registry import Registry

query = Registry()
QUERIES, ORACLE = query.queries, query.oracle

KINDS = {"click": "available", "error": "out", "signup": "doubt", "view": "benched", "purchase": "confirmed_starter"}
_CASE = "CASE kind " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in KINDS.items()) + " END"
CLAIMS = f"{POSTS}, claims AS (SELECT post_id, author, created, {_CASE} AS type, k AS player, value FROM posts)"
ANCHORS = f"{CLAIMS}, anchor AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY player ORDER BY created DESC, post_id DESC) AS n FROM claims) WHERE n = 1)"
_AGAINST = " OR ".join(f"(a.type = '{x}' AND c.type = '{y}') OR (a.type = '{y}' AND c.type = '{x}')" for x, y in rules.CONTRADICT)
GRADED = f"""{ANCHORS}, labelled AS (SELECT a.player, a.post_id AS anchor_id, a.type AS anchor_type, a.created AS anchor_at, a.value AS anchor_value, c.post_id, c.author, c.created, c.post_id % 4 = 0 AS judged,
  CASE WHEN a.type = c.type THEN 'supports' WHEN {_AGAINST} THEN 'contradicts' ELSE 'related' END AS label FROM anchor a JOIN claims c ON c.player = a.player AND c.post_id <> a.post_id AND c.author <> a.author),
  used AS (SELECT * FROM labelled WHERE label <> 'related' AND (NOT judged OR label = 'contradicts')), one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY player, author ORDER BY created DESC, post_id DESC) AS n FROM used) WHERE n = 1),
  counted AS (SELECT a.player, a.post_id AS anchor_id, a.type AS anchor_type, a.value AS anchor_value, a.created AS anchor_at, count(o.post_id) FILTER (o.label = 'supports') AS supporting, count(o.post_id) FILTER (o.label = 'contradicts') AS contradicting,
  coalesce(sum(CASE WHEN o.author % 3 = 0 THEN 2 ELSE 1 END) FILTER (o.label = 'supports'), 0) AS weight, coalesce(bool_or(o.label = 'contradicts' AND o.created > a.created - INTERVAL 24 HOUR), false) AS newer
  FROM anchor a LEFT JOIN one o ON o.player = a.player GROUP BY 1, 2, 3, 4, 5),
  graded AS (SELECT *, CASE WHEN anchor_value > 30 THEN 'confirmed' WHEN anchor_value > 10 THEN 'likely' ELSE 'rumour' END AS certainty FROM counted)"""


def claims(spark: SparkSession, sf: str) -> DataFrame:
    kinds = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])
    return events(spark, sf).select("post_id", "author", "created", kinds[F.col("kind")].alias("type"), F.col("k").alias("player"), "value")


def _graded(spark: SparkSession, sf: str) -> DataFrame:
    c = claims(spark, sf)
    anchor = latest.latest_per_key(c, ["player"], ["created", "post_id"]).select("player", F.col("post_id").alias("anchor_id"), F.col("author").alias("anchor_author"), F.col("created").alias("anchor_at"), F.col("type").alias("anchor_type"), F.col("value").alias("anchor_value"))
    x = c.join(anchor, "player").where("post_id != anchor_id and author != anchor_author").withColumn("label", rules.label(F.col("anchor_type"), F.col("type")))
    x = x.where((F.col("label") != "related") & ((F.col("post_id") % 4 != 0) | (F.col("label") == "contradicts")))
    one = x.groupBy("player", "author").agg(F.max_by(F.struct("label", "created", "anchor_at"), F.struct("created", "post_id")).alias("r")).select("player", "author", "r.*")
    supports, against = F.col("label") == "supports", F.col("label") == "contradicts"
    counts = one.groupBy("player").agg(F.count_if(supports).alias("supporting"), F.count_if(against).alias("contradicting"), F.sum(F.when(supports, F.when(F.col("author") % 3 == 0, 2).otherwise(1)).otherwise(0)).alias("weight"), F.bool_or(against & (F.col("created") > F.col("anchor_at") - F.expr("interval 24 hours"))).alias("newer"))
    certainty = F.when(F.col("anchor_value") > 30, "confirmed").when(F.col("anchor_value") > 10, "likely").otherwise("rumour")
    zero = lambda n: F.coalesce(n, F.lit(0)).cast("bigint").alias(n)
    return anchor.join(counts, "player", "left").select("player", "anchor_id", "anchor_type", "anchor_at", "anchor_value", zero("supporting"), zero("contradicting"), zero("weight"), F.coalesce("newer", F.lit(False)).alias("newer"), certainty.alias("certainty"))


@query(f"""WITH {GRADED} SELECT player, anchor_id, certainty, supporting, contradicting, CAST(weight AS BIGINT) AS weight,
  ['low', 'medium', 'high'][greatest(CASE WHEN weight >= 2 OR certainty = 'confirmed' AND weight >= 1 THEN 2 WHEN certainty IN ('confirmed', 'likely') OR weight >= 1 THEN 1 ELSE 0 END - CASE WHEN newer THEN 1 ELSE 0 END, 0) + 1] AS grade,
  concat_ws(',', CASE WHEN weight >= 2 THEN 'weight' END, CASE WHEN certainty = 'confirmed' THEN 'confirmed' END, CASE WHEN newer THEN 'newer contradiction' END) AS reasons FROM graded""")
def corroborate(spark: SparkSession, sf: str) -> DataFrame:
    """Every player's newest claim, the accounts for and against it (the newest post of each; judged posts count only against), the sum of their credibility, the grade and its reasons. One job for all players."""
    g = _graded(spark, sf)
    reasons = F.concat_ws(",", F.when(F.col("weight") >= 2, "weight"), F.when(F.col("certainty") == "confirmed", "confirmed"), F.when(F.col("newer"), "newer contradiction"))
    return g.select("player", "anchor_id", "certainty", "supporting", "contradicting", "weight", rules.grade(F.col("weight"), F.col("certainty"), F.col("newer")).alias("grade"), reasons.alias("reasons"))


@query(f"""WITH {CLAIMS}, ranked AS (SELECT *, row_number() OVER (PARTITION BY player ORDER BY created DESC, post_id DESC) AS n FROM claims), newest AS (SELECT * FROM ranked WHERE n = 1),
  older AS (SELECT * FROM (SELECT r.*, row_number() OVER (PARTITION BY r.player ORDER BY r.created DESC, r.post_id DESC) AS m FROM ranked r JOIN newest w ON r.player = w.player AND r.type <> w.type) WHERE m = 1)
  SELECT w.player, w.post_id AS newest, o.post_id AS newest_of_another_type, CASE WHEN w.type <> 'available' OR o.type IN ('out', 'doubt') THEN w.post_id ELSE o.post_id END AS anchor FROM newest w LEFT JOIN older o ON o.player = w.player""")
def anchor_tiers(spark: SparkSession, sf: str) -> DataFrame:
    """The newest claim and the newest of another type; 'available' is an anchor only where it reverses something."""
    c = claims(spark, sf)
    order = F.struct("created", "post_id")
    by_type = c.groupBy("player", "type").agg(F.max(order).alias("last"))
    rank = F.row_number().over(Window.partitionBy("player").orderBy(F.desc("last")))
    x = by_type.withColumn("n", rank).where("n <= 2").groupBy("player").agg(*[F.max(F.when(F.col("n") == n, F.struct("type", "last"))).alias(f"t{n}") for n in (1, 2)])
    newest, other = F.col("t1.last.post_id"), F.col("t2.last.post_id")
    reverses = F.coalesce(F.col("t2.type").isin("out", "doubt"), F.lit(False))
    return x.select("player", newest.alias("newest"), other.alias("newest_of_another_type"), F.when((F.col("t1.type") != "available") | reverses, newest).otherwise(other).alias("anchor"))


@query(f"""WITH {POSTS}, legs AS (SELECT post_id // 4 AS post, min(created) FILTER (kind = 'click') AS seen, min(created) FILTER (kind IN ('view', 'purchase')) AS extracted, min(created) FILTER (kind = 'signup') AS delivered, min(created) AS posted FROM posts GROUP BY 1),
  long AS (SELECT unnest(['seen', 'extracted', 'delivered']) AS leg, unnest([date_diff('microsecond', posted, seen) / 1e6, date_diff('microsecond', posted, extracted) / 1e6, date_diff('microsecond', posted, delivered) / 1e6]) AS s FROM legs)
  SELECT leg, count(s) AS n, quantile_disc(s, 0.5) AS p50, quantile_disc(s, 0.95) AS p95, max(s) AS longest FROM long WHERE s IS NOT NULL GROUP BY leg""")
def alert_latency(spark: SparkSession, sf: str) -> DataFrame:
    """Seconds from a post to each step, the earliest of its kind, with nearest-rank percentiles."""
    first = lambda *kinds: F.min(F.when(F.col("kind").isin(*kinds), F.col("created")))
    per = events(spark, sf).groupBy(F.expr("post_id div 4").alias("post")).agg(first("click").alias("seen"), first("view", "purchase").alias("extracted"), first("signup").alias("delivered"), F.min("created").alias("posted"))
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    legs = per.select(F.explode(F.array(*[F.struct(F.lit(x).alias("leg"), ((micros(x) - micros("posted")) / 1e6).alias("s")) for x in ("seen", "extracted", "delivered")])).alias("r")).select("r.*").where("s is not null")
    pct = lambda p: F.expr(f"percentile_disc({p}) within group (order by s)")
    return legs.groupBy("leg").agg(F.count("*").alias("n"), pct(0.5).alias("p50"), pct(0.95).alias("p95"), F.max("s").alias("longest"))


@query(f"""WITH {POSTS}, w AS (SELECT post_id // 4 AS post, count(*) AS tries, bool_or(kind <> 'error') AS done, max(created) AS latest FROM posts GROUP BY 1)
  SELECT CASE WHEN done THEN 'done' WHEN tries >= 4 THEN 'failed' ELSE 'retrying' END AS status, count(*) AS n, max(latest) AS latest FROM w GROUP BY 1""")
def work_status(spark: SparkSession, sf: str) -> DataFrame:
    """Done, failed for good and retrying items, with the latest of each."""
    w = events(spark, sf).groupBy(F.expr("post_id div 4").alias("post")).agg(F.count("*").alias("tries"), F.bool_or(F.col("kind") != "error").alias("done"), F.max("created").alias("latest"))
    return w.groupBy(F.when(F.col("done"), "done").when(F.col("tries") >= 4, "failed").otherwise("retrying").alias("status")).agg(F.count("*").alias("n"), F.max("latest").alias("latest"))


ORDER = ("out", "doubt", "benched", "available", "confirmed_starter")


@query(f"""WITH {GRADED}, end_at AS (SELECT max(created) AS m FROM posts) SELECT anchor_type, player, row_number() OVER (PARTITION BY anchor_type ORDER BY anchor_at < m - INTERVAL 24 HOUR, supporting DESC, player % 5 = 0, player % 7 DESC, player) AS place,
  list_position({list(ORDER)!r}, anchor_type) AS section FROM graded, end_at""")
def alert_cards(spark: SparkSession, sf: str) -> DataFrame:
    """Cards by the type of the anchor in a fixed order of sections; inside, fresh ones first, then by accounts, known ownership, ownership and name."""
    g = _graded(spark, sf).join(F.broadcast(events(spark, sf).agg(F.max("created").alias("m"))), F.lit(True))
    w = Window.partitionBy("anchor_type").orderBy(F.col("anchor_at") < F.col("m") - F.expr("interval 24 hours"), F.desc("supporting"), F.col("player") % 5 == 0, F.desc(F.col("player") % 7), "player")
    return g.select("anchor_type", "player", F.row_number().over(w).cast("bigint").alias("place"), F.array_position(F.array(*[F.lit(x) for x in ORDER]), F.col("anchor_type")).cast("int").alias("section"))


SLOTS = f"{POSTS}, slots AS (SELECT author, CAST(date_diff('day', TIMESTAMP '2024-01-01', created) // 7 AS BIGINT) AS slot, count(*) AS posts, bool_or(kind = 'purchase') AS sent FROM posts GROUP BY 1, 2)"


def _slots(spark: SparkSession, sf: str) -> DataFrame:
    slot = F.expr("datediff(created, date'2024-01-01') div 7").alias("slot")
    return events(spark, sf).groupBy("author", slot).agg(F.count("*").alias("posts"), F.bool_or(F.col("kind") == "purchase").alias("sent"))


@query(f"""WITH {SLOTS}, any_sent AS (SELECT author, bool_or(sent) AS digest FROM slots GROUP BY 1) SELECT author, slot, sent OR (slot = 0 AND digest) AS done FROM slots JOIN any_sent USING (author)""")
def moved_deadline(spark: SparkSession, sf: str) -> DataFrame:
    """A digest that has been sent counts as the first slot, whichever slot it was sent for."""
    s = _slots(spark, sf)
    return s.join(s.groupBy("author").agg(F.bool_or("sent").alias("digest")), "author").select("author", "slot", (F.col("sent") | ((F.col("slot") == 0) & F.col("digest"))).alias("done"))


@query(f"""WITH {SLOTS}, k AS (SELECT author, slot, posts, sent, lag(posts) OVER (PARTITION BY author ORDER BY slot) AS before FROM slots) SELECT author, slot, author || ':' || slot AS key,
  CASE WHEN sent THEN 'already sent' WHEN posts <= coalesce(before, 0) THEN 'nothing new' ELSE 'send' END AS outcome FROM k""")
def slot_digest(spark: SparkSession, sf: str) -> DataFrame:
    """What becomes of a slot's digest: sent before under its key, skipped because nothing is new, or to be sent."""
    before = F.lag("posts").over(Window.partitionBy("author").orderBy("slot"))
    k = _slots(spark, sf).withColumn("before", before)
    outcome = F.when(F.col("sent"), "already sent").when(F.col("posts") <= F.coalesce("before", F.lit(0)), "nothing new").otherwise("send")
    return k.select("author", "slot", F.concat(F.col("author").cast("string"), F.lit(":"), F.col("slot").cast("string")).alias("key"), outcome.alias("outcome"))


@query(f"""WITH {POSTS}, first AS (SELECT post_id // 4 AS post, min(created) AS at FROM posts WHERE kind <> 'error' GROUP BY 1), listed AS (SELECT k FROM posts GROUP BY k HAVING count(DISTINCT author) >= 60)
  SELECT f.post, f.at, (SELECT count(DISTINCT p.k) FROM posts p JOIN listed USING (k) WHERE p.post_id // 4 = f.post) AS players FROM first f WHERE f.at >= TIMESTAMP '2024-01-20' AND EXISTS (SELECT 1 FROM posts p JOIN listed USING (k) WHERE p.post_id // 4 = f.post)""")
def breaking_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Posts first extracted since a moment that name a listed player."""
    p = events(spark, sf).withColumn("post", F.expr("post_id div 4"))
    first = p.where("kind != 'error'").groupBy("post").agg(F.min("created").alias("at")).where("at >= timestamp_ntz'2024-01-20'")
    listed = p.groupBy("k").agg(F.count_distinct("author").alias("n")).where("n >= 60").select("k")
    named = p.join(listed, "k", "left_semi").groupBy("post").agg(F.count_distinct("k").alias("players"))
    return first.join(named, "post")
