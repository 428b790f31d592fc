"""Queries on league tables, latest rows, merges and as-of joins, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import asof, latest, merge, places, ranks
from ..sources.tables import table, weekly
from .registry import Registry

WEEKLY = """weekly AS (
  SELECT *, CAST(sum(points) OVER (PARTITION BY manager ORDER BY gw) AS BIGINT) AS total FROM (
    SELECT CAST(c_nationkey AS BIGINT) AS league, c_custkey AS manager, CAST(year(o_orderdate) * 12 + month(o_orderdate) AS BIGINT) AS gw,
           CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS points
    FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3))"""

query = Registry()
QUERIES, ORACLE = query.queries, query.oracle


@query(f"""WITH {WEEKLY} SELECT league, gw, manager, total, rank() OVER w AS place, max(total) OVER (PARTITION BY league, gw) - total AS gap,
  row_number() OVER (PARTITION BY league, gw ORDER BY total DESC, manager) AS row_order FROM weekly WINDOW w AS (PARTITION BY league, gw ORDER BY total DESC)""")
def league_table(spark: SparkSession, sf: str) -> DataFrame:
    g = ["league", "gw"]
    w = places.with_extremes(weekly(spark, sf).drop("points"), g, "total", "most", "least")
    w = places.row_places(places.competition_places(w, g, "total", "place"), g, [F.desc("total"), F.col("manager")], "row_order")
    return w.select(*g, "manager", "total", "place", (F.col("most") - F.col("total")).alias("gap"), "row_order")


MOVES = f"""{WEEKLY}, moves AS (SELECT a.league, a.gw, a.manager, rank() OVER (PARTITION BY a.league, a.gw ORDER BY a.total DESC) AS rank_now,
  rank() OVER (PARTITION BY a.league, a.gw ORDER BY b.total DESC) AS rank_before FROM weekly a JOIN weekly b ON a.league = b.league AND a.manager = b.manager AND b.gw = a.gw - 1)"""


def _moves(spark: SparkSession, sf: str) -> DataFrame:
    return ranks.movement(weekly(spark, sf), ["league"], "gw", "manager", "total").select("league", "gw", "manager", "rank_now", "rank_before", "moved")


@query(f"WITH {MOVES} SELECT *, rank_before - rank_now AS moved FROM moves")
def table_movement(spark: SparkSession, sf: str) -> DataFrame:
    return _moves(spark, sf)


@query(f"""WITH {MOVES}, m AS (SELECT *, rank_before - rank_now AS moved FROM moves)
  SELECT league, gw, manager, moved FROM (SELECT *, max(moved) OVER w AS most, min(moved) OVER w AS least FROM m WINDOW w AS (PARTITION BY league, gw))
  WHERE (moved = most AND most > 0) OR (moved = least AND least < 0)""")
def biggest_movers(spark: SparkSession, sf: str) -> DataFrame:
    m = ranks.at_extremes(_moves(spark, sf), ["league", "gw"], "moved")
    return m.where("(is_win and moved > 0) or (is_flop and moved < 0)").select("league", "gw", "manager", "moved")


FLAGS = f"""{WEEKLY}, flags AS (SELECT league, gw, manager, points, points = max(points) OVER w AS is_win, points = min(points) OVER w AS is_flop
  FROM weekly WINDOW w AS (PARTITION BY league, gw))"""


def _flags(spark: SparkSession, sf: str) -> DataFrame:
    return ranks.at_extremes(weekly(spark, sf), ["league", "gw"], "points").select("league", "gw", "manager", "points", "is_win", "is_flop")


@query(f"WITH {FLAGS} SELECT *, CAST(sum(CAST(is_win AS BIGINT)) OVER (PARTITION BY manager ORDER BY gw) AS BIGINT) AS wins FROM flags")
def wins_to_date(spark: SparkSession, sf: str) -> DataFrame:
    return _flags(spark, sf).withColumn("wins", F.sum(F.col("is_win").cast("bigint")).over(Window.partitionBy("manager").orderBy("gw")))


@query(f"""WITH {FLAGS}, b AS (SELECT *, CASE WHEN NOT is_win THEN gw WHEN coalesce(lag(gw) OVER (PARTITION BY manager ORDER BY gw), gw - 2) <> gw - 1 THEN gw - 1 END AS brk FROM flags)
  SELECT league, gw, manager, is_win, gw - max(brk) OVER (PARTITION BY manager ORDER BY gw) AS streak FROM b""")
def trailing_streak(spark: SparkSession, sf: str) -> DataFrame:
    return ranks.trailing_streak(_flags(spark, sf), "manager", "gw", "is_win").select("league", "gw", "manager", "is_win", "streak")


@query(f"""WITH {WEEKLY}, r AS (SELECT league, gw, manager, rank() OVER (PARTITION BY league, gw ORDER BY points DESC) AS place FROM weekly)
  SELECT league, gw, manager, place, coalesce(n >= 3 AND place < lo, false) AS is_best, coalesce(n >= 3 AND place > hi, false) AS is_worst FROM (
    SELECT *, row_number() OVER w AS n, min(place) OVER p AS lo, max(place) OVER p AS hi FROM r
    WINDOW w AS (PARTITION BY manager ORDER BY gw), p AS (PARTITION BY manager ORDER BY gw ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))""")
def personal_bests(spark: SparkSession, sf: str) -> DataFrame:
    r = weekly(spark, sf).withColumn("place", ranks.competition_rank(["league", "gw"], "points"))
    b = ranks.personal_best(r, "manager", "gw", "place")
    return b.select("league", "gw", "manager", "place", F.coalesce("is_best", F.lit(False)).alias("is_best"), F.coalesce("is_worst", F.lit(False)).alias("is_worst"))


@query(f"""WITH {WEEKLY}, r AS (SELECT *, min(points) OVER (PARTITION BY league) AS lo, max(points) OVER (PARTITION BY league) AS hi FROM weekly)
  SELECT league, gw, manager, points, CASE WHEN points = hi THEN 'best' ELSE 'worst' END AS record FROM r WHERE points = hi OR points = lo""")
def season_records(spark: SparkSession, sf: str) -> DataFrame:
    r = ranks.at_extremes(weekly(spark, sf), ["league"], "points").where("is_win or is_flop")
    return r.select("league", "gw", "manager", "points", F.when(F.col("is_win"), "best").otherwise("worst").alias("record"))


@query(f"""WITH {WEEKLY}, t AS (SELECT a.league, a.gw, a.manager, a.total AS now, b.total AS was FROM weekly a JOIN weekly b ON a.league = b.league AND a.manager = b.manager AND b.gw = a.gw - 1)
  SELECT a.league, a.gw, a.manager AS ahead, b.manager AS behind FROM t a JOIN t b ON a.league = b.league AND a.gw = b.gw AND a.was < b.was AND a.now > b.now""")
def rivalry_swaps(spark: SparkSession, sf: str) -> DataFrame:
    return ranks.swaps(weekly(spark, sf), ["league"], "gw", "manager", "total")


@query(f"""WITH {WEEKLY}, t AS (SELECT league, gw, manager, place FROM (SELECT *, row_number() OVER (PARTITION BY league, gw ORDER BY total DESC, manager) AS place FROM weekly) WHERE place <= 3),
  wk AS (SELECT DISTINCT league, gw FROM weekly), old AS (SELECT t.league, t.gw + 1 AS gw, manager, place AS place_before FROM t JOIN wk ON wk.league = t.league AND wk.gw = t.gw + 1),
  new AS (SELECT t.* FROM t JOIN wk ON wk.league = t.league AND wk.gw = t.gw - 1)
  SELECT league, gw, manager, place, place_before, CASE WHEN place IS NULL THEN 'left' ELSE 'entered' END AS kind FROM new FULL JOIN old USING (league, gw, manager) WHERE place IS NULL OR place_before IS NULL""")
def podium_changes(spark: SparkSession, sf: str) -> DataFrame:
    return ranks.podium_changes(weekly(spark, sf), ["league"], "gw", "manager", "total").select("league", "gw", "manager", "place", "place_before", "kind")


@query(f"""WITH {WEEKLY}, r AS (SELECT *, row_number() OVER (PARTITION BY league, gw ORDER BY total DESC, manager) AS place, rank() OVER (PARTITION BY league, gw ORDER BY total DESC) AS place_rank FROM weekly),
  m AS (SELECT a.league, a.gw, a.manager, a.total, a.place, a.place_rank AS rank_now, b.place AS place_before, b.place_rank AS rank_before FROM r a LEFT JOIN r b ON a.league = b.league AND a.manager = b.manager AND b.gw = a.gw - 1
    WHERE EXISTS (SELECT 1 FROM weekly w WHERE w.league = a.league AND w.gw = a.gw - 1)),
  ins AS (SELECT *, row_number() OVER (PARTITION BY league, gw ORDER BY place) AS n FROM m WHERE place <= 3 AND coalesce(place_before, 4) > 3),
  outs AS (SELECT *, row_number() OVER (PARTITION BY league, gw ORDER BY place_before) AS n FROM m WHERE place > 3 AND place_before <= 3),
  e AS (SELECT a, b, 'new_leader' AS kind FROM m a LEFT JOIN m b ON a.league = b.league AND a.gw = b.gw AND b.place_before = 1 WHERE a.place = 1 AND coalesce(a.place_before, 0) <> 1
    UNION ALL SELECT m, o, 'entered' FROM ins JOIN m USING (league, gw, manager) LEFT JOIN outs ON outs.league = ins.league AND outs.gw = ins.gw AND outs.n = ins.n LEFT JOIN m o ON o.league = outs.league AND o.gw = outs.gw AND o.manager = outs.manager
    UNION ALL SELECT m, NULL, 'left' FROM outs JOIN m USING (league, gw, manager)
    UNION ALL SELECT a, b, 'swap' FROM m a JOIN m b ON a.league = b.league AND a.gw = b.gw AND a.place < b.place AND b.place <= 3 AND a.place_before > b.place_before AND a.place_before <= 3 WHERE NOT (a.place = 1 AND b.place_before = 1))
  SELECT a.league AS league, a.gw AS gw, a.manager AS manager, kind, a.rank_before AS rank_before, a.rank_now AS rank_now, b.manager AS other, a.total - b.total AS gap FROM e""")
def podium_events(spark: SparkSession, sf: str) -> DataFrame:
    """All four kinds of podium_changes, with the other member and the gap."""
    return ranks.podium_events(weekly(spark, sf), ["league"], "gw", "manager", "total")


@query("""SELECT o_orderkey, o_custkey, o_orderstatus, last_value(CASE WHEN o_orderstatus <> 'P' THEN o_orderkey END IGNORE NULLS) OVER
  (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS week_before FROM orders""")
def prior_unskipped(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return ranks.last_unskipped(o, "o_custkey", "o_orderkey", F.col("o_orderstatus") == "P")


@query(f"WITH {WEEKLY} SELECT league, gw, CAST(floor(CAST(sum(points) AS DOUBLE) / count(*) + 0.5) AS BIGINT) AS average FROM weekly GROUP BY 1, 2")
def average_half_up(spark: SparkSession, sf: str) -> DataFrame:
    return weekly(spark, sf).groupBy("league", "gw").agg(F.floor(F.sum("points").cast("double") / F.count("*") + 0.5).cast("bigint").alias("average"))


@query("SELECT o_custkey, o_orderkey, o_orderdate, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1")
def latest_per_key(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus")
    return latest.latest_per_key(o, ["o_custkey"], ["o_orderdate", "o_orderkey"])


@query("SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n = 1")
def conversation_last(spark: SparkSession, sf: str) -> DataFrame:
    return latest.latest_per_key(table(spark, sf, "conversations").select("conv_id", "turn", "role", "text"), ["conv_id"], ["turn"])


@query("SELECT o_custkey, count(*) AS attempts FROM orders GROUP BY 1 HAVING bool_and(o_orderstatus <> 'P') AND count(*) < 12")
def retry_history(spark: SparkSession, sf: str) -> DataFrame:
    return latest.retry_list(table(spark, sf, "orders"), "o_custkey", F.col("o_orderstatus") != "P", 12)


CHANGES = """changes AS (SELECT event_id, user_id, ts, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) WHERE b IS NULL OR b <> event_type)"""


@query(f"WITH {CHANGES} SELECT * FROM changes")
def change_log(spark: SparkSession, sf: str) -> DataFrame:
    return latest.change_log(table(spark, sf, "events").select("event_id", "user_id", "ts", "event_type"), ["user_id"], ["ts", "event_id"], ["event_type"])


AROUND = """SELECT v.event_id, v.user_id, v.ts, (SELECT max(p.ts) FROM events p WHERE p.event_type = 'purchase' AND p.user_id = v.user_id AND p.ts <= v.ts) AS prev_at,
  (SELECT min(p.ts) FROM events p WHERE p.event_type = 'purchase' AND p.user_id = v.user_id AND p.ts > v.ts) AS next_at FROM events v WHERE v.event_type = 'view'"""


@query(AROUND)
def around_events(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    views = e.where("event_type = 'view'").select("event_id", "user_id", "ts")
    return asof.around(views, e.where("event_type = 'purchase'"), "user_id", "ts", "ts", "event_id").select("event_id", "user_id", "ts", "prev_at", "next_at")


@query(f"WITH {CHANGES}, x AS (SELECT p.event_id, p.user_id, c.event_type, row_number() OVER (PARTITION BY p.event_id ORDER BY c.ts DESC, c.event_id DESC) AS n FROM events p JOIN changes c ON c.user_id = p.user_id AND c.ts <= p.ts WHERE p.event_type = 'purchase') SELECT event_id, user_id, event_type AS flag FROM x WHERE n = 1")
def flag_as_of(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("event_id", "user_id", "ts", "event_type")
    log = latest.change_log(e, ["user_id"], ["ts", "event_id"], ["event_type"])
    near = asof.around(e.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), log, "user_id", "ts", "ts", "event_id")
    return near.join(log.select(F.col("event_id").alias("prev_id"), F.col("event_type").alias("flag")), "prev_id").select("event_id", "user_id", "flag")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def never_processed(spark: SparkSession, sf: str) -> DataFrame:
    urgent = table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return latest.never_processed(table(spark, sf, "customer"), urgent, ["c_custkey"]).select("c_custkey", "c_name")


@query("SELECT c_nationkey, count(*) AS n FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000) GROUP BY 1")
def semi_members(spark: SparkSession, sf: str) -> DataFrame:
    big = table(spark, sf, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").join(big, "c_custkey", "left_semi").groupBy("c_nationkey").agg(F.count("*").alias("n"))


BASE_INCOMING = "base AS (SELECT o_custkey AS k, count(*) AS n, max(o_totalprice) AS v FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1), inc AS (SELECT o_custkey AS k, count(*) AS n, max(o_totalprice) AS v FROM orders WHERE o_orderkey % 2 = 1 GROUP BY 1)"


def _halves(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    o = table(spark, sf, "orders")
    half = lambda r: o.where(F.col("o_orderkey") % 2 == r).groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("n"), F.max("o_totalprice").alias("v"))
    return half(0), half(1)


@query(f"WITH {BASE_INCOMING} SELECT * FROM inc UNION ALL SELECT * FROM base WHERE k NOT IN (SELECT k FROM inc)")
def upsert(spark: SparkSession, sf: str) -> DataFrame:
    return merge.upsert(*_halves(spark, sf), ["k"])


@query(f"WITH {BASE_INCOMING} SELECT k, coalesce(base.n, 0) + coalesce(inc.n, 0) AS n, coalesce(inc.v, base.v) AS v FROM base FULL JOIN inc USING (k)")
def additive_upsert(spark: SparkSession, sf: str) -> DataFrame:
    return merge.additive_upsert(*_halves(spark, sf), ["k"], ["n"])


@query(f"WITH {BASE_INCOMING} SELECT k, CASE WHEN base.k IS NULL THEN inc.n WHEN inc.k IS NULL THEN base.n ELSE least(base.n, inc.n) END AS n, coalesce(base.v, inc.v) AS v FROM base FULL JOIN inc USING (k)")
def merge_upsert(spark: SparkSession, sf: str) -> DataFrame:
    return merge.merge_upsert(*_halves(spark, sf), ["k"], {"n": F.least("b.n", "i.n"), "v": F.coalesce("b.v", "i.v")})


@query(f"WITH {BASE_INCOMING} SELECT * FROM base UNION ALL SELECT * FROM inc WHERE k NOT IN (SELECT k FROM base)")
def insert_if_absent(spark: SparkSession, sf: str) -> DataFrame:
    return merge.insert_if_absent(*_halves(spark, sf), ["k"])


@query("""WITH inc AS (SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey % 3 = 0 AND o_custkey % 5 = 0)
  SELECT * FROM inc UNION ALL SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM inc)""")
def partition_replace(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return merge.replace_partitions(o, o.where("o_orderkey % 3 = 0 and o_custkey % 5 = 0"), ["o_custkey"])


@query("""SELECT l_orderkey, bool_and(l_returnflag = 'N') AS all_new, bool_or(l_linestatus = 'O') AS any_open, min_by(l_partkey, CAST(l_linenumber AS BIGINT) * 1000000000 + l_partkey) FILTER (l_quantity > 25) AS first_big FROM lineitem GROUP BY 1""")
def merge_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").select("l_orderkey", (F.col("l_returnflag") == "N").alias("all_new"), (F.col("l_linestatus") == "O").alias("any_open"), F.when(F.col("l_quantity") > 25, F.col("l_partkey")).alias("first_big"), "l_linenumber")
    return merge.merge_duplicates(li, "l_orderkey", ["all_new"], ["any_open"], {"first_big": "l_linenumber"})


@query("""WITH p AS (SELECT o_custkey, list(DISTINCT o_orderpriority) FILTER (o_orderkey % 2 = 0) AS a, list(DISTINCT o_orderpriority) FILTER (o_orderkey % 2 = 1) AS b FROM orders GROUP BY 1)
  SELECT o_custkey, CAST(len(list_filter(coalesce(a, []), lambda x: NOT list_contains(coalesce(b, []), x))) AS INTEGER) AS lost FROM p""")
def lost_members(spark: SparkSession, sf: str) -> DataFrame:
    side = lambda r: F.collect_set(F.when(F.col("o_orderkey") % 2 == r, F.col("o_orderpriority")))
    return table(spark, sf, "orders").groupBy("o_custkey").agg(side(0).alias("a"), side(1).alias("b")).select("o_custkey", merge.lost_members(F.col("a"), F.col("b")).alias("lost"))


@query("""WITH s AS (SELECT l_suppkey, l_orderkey, min(l_shipdate) AS a, max(l_shipdate) AS b FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1)
  SELECT x.l_suppkey, x.l_orderkey AS one, y.l_orderkey AS two FROM s x JOIN s y ON x.l_suppkey = y.l_suppkey AND x.a < y.b AND y.a < x.b AND x.l_orderkey < y.l_orderkey""")
def interval_overlap(spark: SparkSession, sf: str) -> DataFrame:
    return _overlapping(table(spark, sf, "lineitem"))


def _overlapping(lines: DataFrame) -> DataFrame:
    s = lines.groupBy("l_suppkey", "l_orderkey").agg(F.min("l_shipdate").alias("a"), F.max("l_shipdate").alias("b"), F.count("*").alias("n")).where("n > 1")
    return asof.overlaps(s, ["l_suppkey"], "l_orderkey", "a", "b").select("l_suppkey", F.least("one", "two").alias("one"), F.greatest("one", "two").alias("two"))
