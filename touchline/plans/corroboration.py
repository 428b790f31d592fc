"""Queries on corroboration in full. A topic is a player's day. Events are posts: of each five, the first stands for an observed flag, the
second for a post that a judge has labelled, the others are claims. Every seventh post quotes an account. Every tenth player's alert has
chosen its anchor: the first claim of the day. The last look was at noon."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import corroboration as ops
from ..operators import rules
from .alerts import KINDS
from .posts import POSTS, events
from .registry import Registry

query = Registry()
QUERIES, ORACLE = query.queries, query.oracle

TOPIC = ["player", "day"]
STATUS = {"click": "a", "view": "a", "error": "i", "signup": "d", "purchase": "n"}


def _case(column: str, names: dict[str, str]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in names.items()) + " END"


def _label(a: str, b: str) -> str:
    pairs = " OR ".join(f"({a} = '{x}' AND {b} = '{y}') OR ({a} = '{y}' AND {b} = '{x}')" for x, y in rules.CONTRADICT)
    return f"CASE WHEN {a} = {b} THEN 'supports' WHEN {pairs} THEN 'contradicts' ELSE 'related' END"


CHOSEN = f"""{POSTS}, said AS (SELECT k AS player, CAST(CAST(created AS DATE) AS VARCHAR) AS day, post_id, created, author, value, {_case("kind", KINDS)} AS type, CASE WHEN post_id % 7 = 3 THEN author // 2 END AS quoted, post_id % 5 AS role FROM posts),
  claims AS (SELECT * FROM said WHERE role > 1), flags AS (SELECT k AS player, post_id AS flag_id, created AS observed_at, {_case("kind", STATUS)} AS status FROM posts WHERE post_id % 5 = 0),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY player, day ORDER BY created DESC, post_id DESC) AS down, row_number() OVER (PARTITION BY player, day ORDER BY created, post_id) AS up,
    lag(type) OVER w AS before_type, lag(post_id) OVER w AS before_id FROM claims WINDOW w AS (PARTITION BY player, day ORDER BY created, post_id)),
  candidate AS (SELECT * FROM ranked WHERE CASE WHEN player % 10 = 0 THEN up = 1 ELSE down = 1 END),
  other AS (SELECT * FROM ranked WHERE type <> 'available' QUALIFY row_number() OVER (PARTITION BY player, day ORDER BY down) = 1),
  held AS (SELECT c.player, c.day, f.flag_id, f.status FROM candidate c JOIN flags f ON f.player = c.player AND f.observed_at <= c.created QUALIFY row_number() OVER (PARTITION BY c.player, c.day ORDER BY f.observed_at DESC, f.flag_id DESC) = 1),
  ways AS (SELECT c.player, c.day, CASE WHEN c.type <> 'available' THEN 'claim' WHEN c.down = 1 AND {_label("c.type", "c.before_type")} = 'contradicts' THEN 'claim reversed' WHEN c.down = 1 AND h.status <> 'a' THEN 'flag reversed'
      WHEN o.post_id IS NOT NULL AND {_label("'available'", "o.type")} <> 'contradicts' THEN 'fallback' ELSE 'none' END AS way,
    c.post_id AS c_id, c.type AS c_type, c.created AS c_at, c.before_type AS c_bt, c.before_id AS c_bi, o.post_id AS o_id, o.type AS o_type, o.created AS o_at, o.before_type AS o_bt, o.before_id AS o_bi, h.flag_id
    FROM candidate c LEFT JOIN other o USING (player, day) LEFT JOIN held h USING (player, day)),
  chosen AS (SELECT player, day, CASE way WHEN 'none' THEN NULL WHEN 'fallback' THEN o_id ELSE c_id END AS anchor_id, CASE way WHEN 'none' THEN NULL WHEN 'fallback' THEN o_type ELSE c_type END AS anchor_type,
    CASE way WHEN 'none' THEN NULL WHEN 'fallback' THEN o_at ELSE c_at END AS anchor_at,
    CASE way WHEN 'none' THEN NULL WHEN 'fallback' THEN CASE WHEN {_label("o_type", "o_bt")} = 'contradicts' THEN o_bi END ELSE CASE WHEN {_label("c_type", "c_bt")} = 'contradicts' THEN c_bi END END AS reversed_claim,
    CASE WHEN way = 'flag reversed' THEN flag_id END AS reversed_flag, way FROM ways)"""


def _said(spark: SparkSession, sf: str) -> DataFrame:
    kinds = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])
    quoted = F.when(F.col("post_id") % 7 == 3, F.expr("author div 2"))
    return events(spark, sf).select(F.col("k").alias("player"), F.to_date("created").cast("string").alias("day"), "post_id", "created", "author", "value", kinds[F.col("kind")].alias("type"), quoted.alias("quoted"), (F.col("post_id") % 5).alias("role"))


def _flags(spark: SparkSession, sf: str) -> DataFrame:
    status = F.create_map(*[F.lit(x) for pair in STATUS.items() for x in pair])
    return events(spark, sf).where("post_id % 5 = 0").select(F.col("k").alias("player"), F.col("post_id").alias("flag_id"), F.col("created").alias("observed_at"), status[F.col("kind")].alias("status"))


def _chosen(spark: SparkSession, sf: str) -> DataFrame:
    claims = _said(spark, sf).where("role > 1")
    of_alerts = claims.where("player % 10 = 0").groupBy(*TOPIC).agg(F.min_by("post_id", F.struct("created", "post_id")).alias("chosen_id"))
    return ops.choose_anchor(claims, _flags(spark, sf), TOPIC, "player", of_alerts)


@query(f"WITH {CHOSEN} SELECT player, day, anchor_id, anchor_type, reversed_claim, reversed_flag, way FROM chosen")
def anchor_chosen(spark: SparkSession, sf: str) -> DataFrame:
    """Each topic's anchor: the alert's or the newest claim, what it reverses, or the claim that steps in."""
    return _chosen(spark, sf).drop("anchor_at")


LISTS = f"""{CHOSEN}, anchors AS (SELECT c.*, s.author AS anchor_author, s.quoted AS anchor_quoted, CASE WHEN s.value > 30 THEN 'confirmed' WHEN s.value > 10 THEN 'likely' ELSE 'rumour' END AS certainty, CAST(c.day AS TIMESTAMP) + INTERVAL 12 HOUR AS new_since
    FROM chosen c JOIN said s ON s.post_id = c.anchor_id),
  labelled AS (SELECT s.*, a.anchor_id, a.anchor_author, a.anchor_quoted, CASE WHEN role = 1 AND s.value < 5 THEN 'unrelated' ELSE {_label("a.anchor_type", "s.type")} END AS label, CASE WHEN role = 1 THEN 'judge' ELSE 'sql' END AS origin
    FROM said s JOIN anchors a USING (player, day) WHERE role > 0),
  items AS (SELECT *, CASE WHEN label <> 'contradicts' AND quoted IS NOT NULL THEN quoted ELSE author END AS account FROM labelled WHERE post_id <> anchor_id AND label <> 'unrelated'),
  one AS (SELECT * FROM items QUALIFY row_number() OVER (PARTITION BY player, day, account ORDER BY created DESC, post_id DESC) = 1),
  lists AS (SELECT player, day, CASE label WHEN 'supports' THEN 'supporting' WHEN 'contradicts' THEN 'contradicting' ELSE 'related' END AS side, account, post_id, created, origin FROM one
    WHERE label = 'related' OR (account <> anchor_author AND account <> coalesce(anchor_quoted, anchor_author)))"""


def _anchors(spark: SparkSession, sf: str) -> DataFrame:
    own = _said(spark, sf).select(F.col("post_id").alias("anchor_id"), F.col("author").alias("anchor_author"), F.col("quoted").alias("anchor_quoted"), "value")
    certainty = F.when(F.col("value") > 30, "confirmed").when(F.col("value") > 10, "likely").otherwise("rumour")
    noon = F.col("day").cast("timestamp_ntz") + F.expr("interval 12 hours")
    return _chosen(spark, sf).join(own, "anchor_id").withColumn("certainty", certainty).withColumn("new_since", noon).drop("value")


def _lists(spark: SparkSession, sf: str, anchors: DataFrame) -> DataFrame:
    s = _said(spark, sf).where("role > 0").join(anchors.select(*TOPIC, "anchor_type"), TOPIC)
    label = F.when((F.col("role") == 1) & (F.col("value") < 5), "unrelated").otherwise(rules.label(F.col("anchor_type"), F.col("type")))
    return ops.account_lists(s.withColumn("label", label).withColumn("origin", F.when(F.col("role") == 1, "judge").otherwise("sql")), anchors, TOPIC)


@query(f"WITH {LISTS} SELECT player, day, side, account, post_id FROM lists")
def corroboration_lists(spark: SparkSession, sf: str) -> DataFrame:
    """The accounts that support, contradict or go with each anchor, with the newest post of each."""
    return _lists(spark, sf, _anchors(spark, sf)).select(*TOPIC, "side", "account", "post_id")


@query(f"""WITH {LISTS}, sums AS (SELECT a.player, a.day, a.anchor_id, a.certainty, coalesce(sum(CASE WHEN l.account % 3 = 0 THEN 2 ELSE 1 END) FILTER (l.side = 'supporting'), 0) AS weight,
    coalesce(bool_or(l.side = 'contradicting' AND l.created > a.new_since), false) AS fresh, coalesce(bool_or(l.side = 'contradicting' AND l.origin = 'judge' AND l.created > a.anchor_at), false) AS newer FROM anchors a LEFT JOIN lists l USING (player, day) GROUP BY 1, 2, 3, 4),
  leveled AS (SELECT *, CASE WHEN weight >= 2 OR (certainty = 'confirmed' AND weight >= 1) THEN 2 WHEN certainty IN ('confirmed', 'likely') OR weight >= 1 THEN 1 ELSE 0 END AS lv FROM sums)
  SELECT player, day, anchor_id, CAST(weight AS BIGINT) AS weight, ['low', 'medium', 'high'][greatest(lv - CASE WHEN fresh OR newer THEN 1 ELSE 0 END, 0) + 1] AS grade,
    CASE lv WHEN 2 THEN concat_ws(',', CASE WHEN certainty = 'confirmed' AND weight >= 1 THEN 'confirmed with support' END, CASE WHEN weight >= 2 THEN 'weight' END)
      WHEN 1 THEN concat_ws(',', CASE WHEN certainty IN ('confirmed', 'likely') THEN certainty END, CASE WHEN weight >= 1 THEN 'weight' END) ELSE 'little' END
    || CASE WHEN fresh OR newer THEN ';' || concat_ws(',', CASE WHEN fresh THEN 'new contradiction' END, CASE WHEN newer THEN 'newer contradiction' END, CASE WHEN lv = 0 THEN 'already low' END) ELSE '' END AS reasons FROM leveled""")
def corroboration_graded(spark: SparkSession, sf: str) -> DataFrame:
    """The grade of every topic that has an anchor, with its reasons."""
    anchors = _anchors(spark, sf)
    g = ops.graded(_lists(spark, sf, anchors), anchors, TOPIC, F.when(F.col("account") % 3 == 0, 2).otherwise(1))
    return g.join(anchors.select(*TOPIC, "anchor_id"), TOPIC).select(*TOPIC, "anchor_id", "weight", "grade", "reasons")
