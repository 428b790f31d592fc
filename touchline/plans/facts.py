"""Queries of the fact sheet. Orders stand for line-ups: lines are picks (line number: position), quantities are points, return flags are kinds of events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import table, weekly
from .league import WEEKLY
from .registry import Registry

query = Registry()
QUERIES, ORACLE = query.queries, query.oracle

PICKS = """picks AS (SELECT l_orderkey AS squad, CAST(l_linenumber AS BIGINT) AS place, l_partkey AS player, min(CAST(l_quantity AS BIGINT)) AS points, min(l_suppkey) AS club, min(l_returnflag) AS flag, min(l_linestatus) AS status
  FROM lineitem GROUP BY 1, 2, 3)"""


def picks(spark: SparkSession, sf: str) -> DataFrame:
    keys = [F.col("l_orderkey").alias("squad"), F.col("l_linenumber").cast("bigint").alias("place"), F.col("l_partkey").alias("player")]
    return table(spark, sf, "lineitem").groupBy(*keys).agg(F.min(F.col("l_quantity").cast("bigint")).alias("points"), F.min("l_suppkey").alias("club"), F.min("l_returnflag").alias("flag"), F.min("l_linestatus").alias("status"))


def joined(c: Column) -> Column:
    """An array as sorted text."""
    return F.array_join(F.sort_array(c), ",")


@query("""SELECT c_custkey AS member, CAST(round(sum(o_totalprice)) AS BIGINT) AS points, CAST(coalesce(count(*) FILTER (o_orderstatus = 'P'), 0) AS BIGINT) AS cost, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS rank
  FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey, c_acctbal HAVING sum(o_totalprice) IS NOT NULL""")
def member_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Members with points; a missing cost is 0, a rank of 0 or less is none. Prices are added in the order of the orders' keys (then of prices), so that a
    sum that ends in a half is rounded the same way however the table is dealt out. Equal rows of a member count as often as they are there."""
    by_key = Window.partitionBy("o_custkey").orderBy("o_orderkey", "o_totalprice").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    o = table(spark, sf, "orders").select("o_custkey", "o_orderstatus", F.sum("o_totalprice").over(by_key).alias("so_far"), F.count("*").over(by_key).alias("nth"))
    o = o.groupBy("o_custkey").agg(F.max_by("so_far", "nth").alias("total"), F.count_if(F.col("o_orderstatus") == "P").alias("cost"))
    c = table(spark, sf, "customer").groupBy("c_custkey", "c_acctbal").agg(F.count("*").alias("n"))
    c = c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left").where("total is not null")
    points, cost = F.round(F.col("total") * F.col("n")).cast("bigint"), F.coalesce(F.col("cost") * F.col("n"), F.lit(0)).cast("bigint")
    return c.select(F.col("c_custkey").alias("member"), points.alias("points"), cost.alias("cost"), F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("rank"))


@query(f"""WITH {WEEKLY}, hits AS (SELECT o_custkey AS manager, CAST(year(o_orderdate) * 12 + month(o_orderdate) AS BIGINT) AS gw, count(*) FILTER (o_orderstatus = 'P') * 400 AS cost FROM orders GROUP BY 1, 2)
  SELECT league, gw, manager, points - coalesce(cost, 0) AS net FROM weekly LEFT JOIN hits USING (manager, gw)""")
def net_points(spark: SparkSession, sf: str) -> DataFrame:
    """Points without what transfers cost."""
    gw = (F.year("o_orderdate") * 12 + F.month("o_orderdate")).cast("bigint").alias("gw")
    hits = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("manager"), gw).agg((F.count_if(F.col("o_orderstatus") == "P") * 400).alias("cost"))
    return weekly(spark, sf).join(hits, ["manager", "gw"], "left").select("league", "gw", "manager", (F.col("points") - F.coalesce("cost", F.lit(0))).alias("net"))


STREAKS = f"""{WEEKLY}, ordered AS (SELECT *, row_number() OVER (PARTITION BY league, gw ORDER BY total DESC, manager) AS place FROM weekly), near AS (SELECT a.league, a.gw, a.manager, b.manager AS other
  FROM ordered a JOIN ordered b ON a.league = b.league AND a.gw = b.gw AND b.place = a.place + 1), pairs AS (SELECT league, gw, least(manager, other) AS one, greatest(manager, other) AS two FROM near),
  runs AS (SELECT *, gw - row_number() OVER (PARTITION BY league, one, two ORDER BY gw) AS island FROM pairs)"""


@query(f"WITH {STREAKS} SELECT league, one, two, max(gw) AS last_gw, count(*) AS weeks FROM runs GROUP BY league, one, two, island HAVING count(*) >= 2")
def neighbour_streak(spark: SparkSession, sf: str) -> DataFrame:
    """Weeks in a row in which two members stand next to each other. One window gives each row its neighbour; islands are of consecutive weeks."""
    w = Window.partitionBy("league", "gw").orderBy(F.desc("total"), "manager")
    near = weekly(spark, sf).select("league", "gw", "manager", F.lead("manager").over(w).alias("other")).where("other is not null")
    pairs = near.select("league", "gw", F.least("manager", "other").alias("one"), F.greatest("manager", "other").alias("two"))
    island = F.col("gw") - F.row_number().over(Window.partitionBy("league", "one", "two").orderBy("gw"))
    return pairs.withColumn("island", island).groupBy("league", "one", "two", "island").agg(F.max("gw").alias("last_gw"), F.count("*").alias("weeks")).where("weeks >= 2").drop("island")


@query(f"""WITH {WEEKLY}, wins AS (SELECT league, gw, manager, points, row_number() OVER (PARTITION BY league, manager ORDER BY gw) AS nth, max(points) OVER (PARTITION BY league) AS league_best,
  max(points) OVER (PARTITION BY league, manager ORDER BY gw ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS own_best FROM (SELECT *, rank() OVER (PARTITION BY league, gw ORDER BY points DESC) AS place FROM weekly) WHERE place = 1)
  SELECT league, gw, manager, points, nth, CASE WHEN points = league_best THEN 'league record' WHEN points > own_best THEN 'personal best' END AS tag FROM wins""")
def winner_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Each week's winners with the number of the win in the season and a tag; a league record comes before a personal one. The league's record is an aggregate that is joined back."""
    wins = weekly(spark, sf).withColumn("place", F.rank().over(Window.partitionBy("league", "gw").orderBy(F.desc("points")))).where("place = 1")
    best = wins.groupBy("league").agg(F.max("points").alias("league_best"))
    own = Window.partitionBy("league", "manager").orderBy("gw")
    before = F.max("points").over(own.rowsBetween(Window.unboundedPreceding, -1))
    x = wins.select("league", "gw", "manager", "points", F.row_number().over(own).cast("bigint").alias("nth"), before.alias("own_best")).join(F.broadcast(best), "league")
    return x.select("league", "gw", "manager", "points", "nth", F.when(F.col("points") == F.col("league_best"), "league record").when(F.col("points") > F.col("own_best"), "personal best").alias("tag"))


@query(f"""WITH {PICKS}, games AS (SELECT squad, club AS home, max(player) AS away FROM picks GROUP BY 1, 2), sides AS (SELECT home AS club FROM games UNION ALL SELECT away % (SELECT max(s_suppkey) + 1 FROM supplier) FROM games) SELECT club, count(*) AS fixtures FROM sides GROUP BY club""")
def club_fixture_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Fixtures of each club, at home or away."""
    games = picks(spark, sf).groupBy("squad", F.col("club").alias("home")).agg(F.max("player").alias("away"))
    n = table(spark, sf, "supplier").agg((F.max("s_suppkey") + 1).alias("n"))
    sides = games.join(F.broadcast(n), F.lit(True)).select(F.explode(F.array(F.col("home"), F.col("away") % F.col("n"))).alias("club"))
    return sides.groupBy("club").agg(F.count("*").alias("fixtures"))


@query(f"""WITH {PICKS}, items AS (SELECT player, flag AS identifier, CAST(sum(points - 25) AS BIGINT) AS total FROM picks GROUP BY 1, 2 HAVING sum(points - 25) <> 0)
  SELECT player, string_agg(identifier || ':' || total, ',' ORDER BY abs(total) DESC, identifier) AS breakdown FROM items GROUP BY player""")
def stat_breakdown(spark: SparkSession, sf: str) -> DataFrame:
    """Sums by identifier over a player's fixtures, without zeros, the largest first."""
    items = picks(spark, sf).groupBy("player", F.col("flag").alias("identifier")).agg(F.sum(F.col("points") - 25).alias("total")).where("total <> 0")
    entry = F.struct(-F.abs("total"), F.col("identifier"), F.concat("identifier", F.lit(":"), F.col("total").cast("string")).alias("text"))
    return items.groupBy("player").agg(F.array_join(F.transform(F.sort_array(F.collect_list(entry)), lambda x: x["text"]), ",").alias("breakdown"))


@query("""SELECT CAST(year(o_orderdate) * 12 + month(o_orderdate) AS BIGINT) AS gw, min(o_orderdate) - INTERVAL 90 MINUTE AS deadline, count(*) AS n FROM orders GROUP BY 1""")
def derived_deadlines(spark: SparkSession, sf: str) -> DataFrame:
    """The first start of each week without ninety minutes."""
    gw = (F.year("o_orderdate") * 12 + F.month("o_orderdate")).cast("bigint").alias("gw")
    return table(spark, sf, "orders").groupBy(gw).agg((F.min("o_orderdate") - F.expr("interval 90 minutes")).alias("deadline"), F.count("*").alias("n"))


@query(f"""WITH {PICKS}, one AS (SELECT squad, player, points, place, row_number() OVER (PARTITION BY squad, player ORDER BY points DESC, place) AS n FROM picks) SELECT squad, player, points, place FROM one WHERE n = 1""")
def first_of_each(spark: SparkSession, sf: str) -> DataFrame:
    """Of a squad's rows on one player the first in the sorted order stays."""
    p = picks(spark, sf)
    return p.groupBy("squad", "player").agg(F.min_by(F.struct("points", "place"), F.struct(-F.col("points"), F.col("place"))).alias("r")).select("squad", "player", "r.points", "r.place")


COUNTED = f"""{PICKS}, counted AS (SELECT *, CASE WHEN status = 'F' OR place > 5 THEN (place > 5 AND status = 'F') OR (place <= 5 AND flag <> 'R') ELSE place <= 5 AND flag <> 'R' END AS is_counted,
  CASE WHEN place = 1 AND flag <> 'R' THEN 2 ELSE 1 END AS multiplier FROM picks)"""


def _counted(spark: SparkSession, sf: str) -> DataFrame:
    p = picks(spark, sf)
    starts, out, comes_in = F.col("place") <= 5, F.col("flag") == "R", (F.col("place") > 5) & (F.col("status") == "F")
    return p.withColumn("is_counted", (starts & ~out) | comes_in).withColumn("multiplier", F.when((F.col("place") == 1) & ~out, 2).otherwise(1))


@query(f"WITH {COUNTED} SELECT squad, count(*) FILTER (is_counted) AS counted, CAST(coalesce(sum(points * multiplier) FILTER (is_counted), 0) AS BIGINT) AS points FROM counted GROUP BY squad")
def actual_counted(spark: SparkSession, sf: str) -> DataFrame:
    """Starters without those taken out, with those brought in; the captain counts twice where counted."""
    c = _counted(spark, sf)
    return c.groupBy("squad").agg(F.count_if("is_counted").alias("counted"), F.sum(F.when(F.col("is_counted"), F.col("points") * F.col("multiplier")).otherwise(0)).alias("points"))


FACTS = f"""{COUNTED}, conceded AS (SELECT squad, club, min(points) AS least, max(points) AS most FROM picks GROUP BY 1, 2), facts AS (
  SELECT squad, player, 'red card' AS fact FROM counted WHERE flag = 'R' AND points >= 45 UNION ALL SELECT squad, player, 'own goal' FROM counted WHERE flag = 'A' AND points = 1
  UNION ALL SELECT squad, player, 'hat-trick' FROM counted WHERE points >= 48 AND flag = 'N' UNION ALL SELECT squad, player, 'keeper wall' FROM counted WHERE place = 7 AND points >= 40
  UNION ALL SELECT c.squad, player, CASE WHEN is_counted AND most - least = 0 THEN 'clean sheet' WHEN NOT is_counted THEN 'lost clean sheet' ELSE 'unlucky clean sheet' END FROM counted c JOIN conceded k ON c.squad = k.squad AND c.club = k.club WHERE place BETWEEN 2 AND 3 AND most - least <= 1)"""


def _facts(spark: SparkSession, sf: str) -> DataFrame:
    c, p = _counted(spark, sf), F.col("points")
    k = picks(spark, sf).groupBy("squad", "club").agg(F.min("points").alias("least"), F.max("points").alias("most")).where("most - least <= 1")
    single = F.array(F.when((F.col("flag") == "R") & (p >= 45), "red card"), F.when((F.col("flag") == "A") & (p == 1), "own goal"), F.when((p >= 48) & (F.col("flag") == "N"), "hat-trick"), F.when((F.col("place") == 7) & (p >= 40), "keeper wall"))
    one = c.select("squad", "player", F.explode(F.array_compact(single)).alias("fact"))
    sheet = F.when(F.col("is_counted") & (F.col("most") == F.col("least")), "clean sheet").when(~F.col("is_counted"), "lost clean sheet").otherwise("unlucky clean sheet")
    return one.union(c.where("place between 2 and 3").join(k, ["squad", "club"]).select("squad", "player", sheet.alias("fact")))


@query(f"WITH {FACTS} SELECT squad, player, fact, count(*) AS n FROM facts GROUP BY squad, player, fact")
def fixture_facts(spark: SparkSession, sf: str) -> DataFrame:
    """Cards, own goals, hat-tricks, saves and clean sheets; the single-row facts come from one pass."""
    return _facts(spark, sf).groupBy("squad", "player", "fact").agg(F.count("*").alias("n"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_discount AS DECIMAL(4,2)) >= 0.09 AND l_quantity <= 2 AS big_miss, CAST(l_discount AS DECIMAL(4,2)) <= 0.01 AND l_quantity >= 48 AS from_nothing, count(*) AS n FROM lineitem GROUP BY ALL""")
def player_flags(spark: SparkSession, sf: str) -> DataFrame:
    """A chance missed, a goal from nothing: exact decimals against bounds."""
    d = F.col("l_discount").cast("decimal(4,2)")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", ((d >= F.lit("0.09").cast("decimal(4,2)")) & (F.col("l_quantity") <= 2)).alias("big_miss"), ((d <= F.lit("0.01").cast("decimal(4,2)")) & (F.col("l_quantity") >= 48)).alias("from_nothing")).groupBy("l_orderkey", "l_linenumber", "l_partkey", "big_miss", "from_nothing").agg(F.count("*").alias("n"))


@query(f"""WITH {WEEKLY}, r AS (SELECT *, dense_rank() OVER (PARTITION BY league, gw ORDER BY points DESC) AS week_place, row_number() OVER (PARTITION BY league, gw ORDER BY total DESC, manager) AS place FROM weekly)
  SELECT league, gw, 'winner' AS kind, a.manager AS one, b.manager AS two FROM r a JOIN r b USING (league, gw) WHERE a.week_place = 1 AND b.week_place = 2
  UNION ALL SELECT league, gw, 'podium', a.manager, b.manager FROM r a JOIN r b USING (league, gw) WHERE a.place <= 2 AND b.place = a.place + 1 AND a.total > b.total""")
def key_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs worth a moment: each winner with each runner-up (ties are few), and neighbours on the podium with a gap."""
    g = ["league", "gw"]
    w = weekly(spark, sf)
    r = w.withColumn("week_place", F.dense_rank().over(Window.partitionBy(*g).orderBy(F.desc("points"))))
    top, second = r.where("week_place = 1").select(*g, F.col("manager").alias("one")), r.where("week_place = 2").select(*g, F.col("manager").alias("two"))
    order = Window.partitionBy(*g).orderBy(F.desc("total"), "manager")
    podium = w.withColumn("place", F.row_number().over(order)).withColumn("two", F.lead("manager").over(order)).withColumn("below", F.lead("total").over(order)).where("place <= 2 and total > below")
    return top.join(second, g).select(*g, F.lit("winner").alias("kind"), "one", "two").union(podium.select(*g, F.lit("podium"), F.col("manager"), F.col("two")))


SHEET = f"""{WEEKLY}, lead AS (SELECT league, gw, max(total) AS top_total, max(points) AS top_points, count(*) AS members, CAST(sum(points) AS BIGINT) AS all_points FROM weekly GROUP BY 1, 2)"""


@query(f"""WITH {SHEET} SELECT league, gw, members, top_total, top_points, CAST(floor(all_points / members + 0.5) AS BIGINT) AS average, CASE WHEN members < 3 THEN 'podium' ELSE '' END AS empty_sections,
  (SELECT string_agg(CAST(manager AS VARCHAR), ',' ORDER BY CAST(manager AS VARCHAR)) FROM weekly w WHERE w.league = lead.league AND w.gw = lead.gw AND w.points = lead.top_points) AS winners FROM lead""")
def fact_sheet(spark: SparkSession, sf: str) -> DataFrame:
    """One row for each league and week: counts, leader, winners, average and the sections that stay empty."""
    g, w = ["league", "gw"], weekly(spark, sf)
    per = w.groupBy(*g).agg(F.max("total").alias("top_total"), F.max("points").alias("top_points"), F.count("*").alias("members"), F.sum("points").alias("all_points"), F.collect_list(F.struct("points", "manager")).alias("rows"))
    winners = joined(F.transform(F.filter("rows", lambda x: x["points"] == F.col("top_points")), lambda x: x["manager"].cast("string")))
    return per.select(*g, "members", "top_total", "top_points", F.floor(F.col("all_points") / F.col("members") + 0.5).cast("bigint").alias("average"), F.when(F.col("members") < 3, "podium").otherwise("").alias("empty_sections"), winners.alias("winners"))


@query(f"""WITH {SHEET}, checked AS (SELECT w.*, lag(w.total) OVER (PARTITION BY manager ORDER BY gw) AS before FROM weekly w)
  SELECT 'totals add up' AS rule, count(*) FILTER (total <> coalesce(before, 0) + points) AS violations, count(*) AS checked FROM checked UNION ALL SELECT 'points are positive', count(*) FILTER (points <= 0), count(*) FROM weekly
  UNION ALL SELECT 'the top is the best of its week', count(*) FILTER (points > top_points), count(*) FROM weekly JOIN lead USING (league, gw) UNION ALL SELECT 'the average is not above the best', count(*) FILTER (all_points / members > top_points), count(*) FROM lead
  UNION ALL SELECT 'three members for a podium', count(*) FILTER (members < 3), count(*) FROM lead""")
def sheet_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Violations of each rule across sections; a caller refuses a sheet where a count isn't zero."""
    g, w = ["league", "gw"], weekly(spark, sf)
    lead = w.groupBy(*g).agg(F.max("points").alias("top_points"), F.count("*").alias("members"), F.sum("points").alias("all_points"))
    w = w.withColumn("before", F.lag("total").over(Window.partitionBy("manager").orderBy("gw")))
    of_rows = w.join(lead, g).agg(F.count_if(F.col("total") != F.coalesce("before", F.lit(0)) + F.col("points")).alias("a"), F.count_if(F.col("points") <= 0).alias("b"), F.count_if(F.col("points") > F.col("top_points")).alias("c"), F.count("*").alias("n"))
    of_weeks = lead.agg(F.count_if(F.col("all_points") / F.col("members") > F.col("top_points")).alias("d"), F.count_if(F.col("members") < 3).alias("e"), F.count("*").alias("n"))
    rules = lambda df, names: df.select(F.explode(F.array(*[F.struct(F.lit(text).alias("rule"), F.col(c).alias("violations"), F.col("n").alias("checked")) for c, text in names])).alias("r")).select("r.*")
    return rules(of_rows, [("a", "totals add up"), ("b", "points are positive"), ("c", "the top is the best of its week")]).union(rules(of_weeks, [("d", "the average is not above the best"), ("e", "three members for a podium")]))


@query("""WITH x AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(value AS DECIMAL(10,2)) AS value FROM events)
  SELECT event_id, 'goals=' || (k % 3) || ',minutes=' || k AS stats, k % 3 + k AS explained, CASE WHEN (k % 3 + k) % 5 = 0 THEN NULL ELSE value END AS live FROM x""")
def explained_stats(spark: SparkSession, sf: str) -> DataFrame:
    """A list of (identifier, value) as JSON becomes a map and its sum; where the sum doesn't fit, the live figure is dropped."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    made = F.to_json(F.array(F.struct(F.lit("goals").alias("identifier"), (k % 3).alias("value")), F.struct(F.lit("minutes").alias("identifier"), k.alias("value"))))
    x = table(spark, sf, "events").select("event_id", F.from_json(made, "array<struct<identifier: string, value: bigint>>").alias("explain"), F.col("value").cast("decimal(10,2)").alias("value"))
    x = x.withColumn("explained", F.aggregate("explain", F.lit(0).cast("bigint"), lambda acc, e: acc + e["value"]))
    return x.select("event_id", F.array_join(F.transform("explain", lambda e: F.concat(e["identifier"], F.lit("="), e["value"].cast("string"))), ",").alias("stats"), "explained", F.when(F.col("explained") % 5 != 0, F.col("value")).alias("live"))


@query("""WITH c AS (SELECT c_custkey, sum(o_totalprice) FILTER (year(o_orderdate) = 1996) AS a, sum(o_totalprice) FILTER (year(o_orderdate) = 1997) AS b FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1),
  n AS (SELECT count(*) FILTER (a IS NULL) AS no_a, count(*) AS n FROM c) SELECT c_custkey, b > a AS moved_up, b >= 2 * a OR 2 * b <= a AS notable FROM c WHERE a IS NOT NULL AND b IS NOT NULL""")
def notable_moves(spark: SparkSession, sf: str) -> DataFrame:
    """Members whose sum has doubled or halved within a year; compared without a division."""
    year = F.year("o_orderdate")
    sums = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum(F.when(year == 1996, F.col("o_totalprice"))).alias("a"), F.sum(F.when(year == 1997, F.col("o_totalprice"))).alias("b"))
    c = table(spark, sf, "customer").select("c_custkey").join(sums, "c_custkey").where("a is not null and b is not null")
    return c.select("c_custkey", (F.col("b") > F.col("a")).alias("moved_up"), ((F.col("b") >= 2 * F.col("a")) | (2 * F.col("b") <= F.col("a"))).alias("notable"))
