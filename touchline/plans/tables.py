"""Queries whose output and work stay linear: rivalries by neighbour streaks, movers, containment of token sets, mentions of a post."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import containment, places
from ..sources.store import written
from ..sources.tables import table
from .registry import Registry
from .squads import known_brands, mentions, part_keys

query = Registry()
QUERIES, ORACLE = query.queries, query.oracle

#: Days in a row that two members must have stood next to each other before one overtakes the other.
NEIGHBOUR_DAYS = 3
DAILY = """daily AS (SELECT user_id // 10 AS league, user_id AS manager, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS BIGINT) AS gw, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS points FROM events GROUP BY 1, 2, 3),
  standing AS (SELECT *, CAST(sum(points) OVER (PARTITION BY manager ORDER BY gw) AS BIGINT) AS total FROM daily),
  ranked AS (SELECT *, rank() OVER (PARTITION BY league, gw ORDER BY total DESC) AS place, row_number() OVER (PARTITION BY league, gw ORDER BY total DESC, manager) AS line FROM standing)"""


def standing(spark: SparkSession, sf: str) -> DataFrame:
    """league, gw, manager, total, place, line: ten users are a league, a day is a week, cents of value are points."""
    gw = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).cast("bigint")
    daily = table(spark, sf, "events").groupBy(F.expr("user_id div 10").alias("league"), F.col("user_id").alias("manager"), gw.alias("gw")).agg(F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("points"))
    total = daily.withColumn("total", F.sum("points").over(Window.partitionBy("manager").orderBy("gw"))).drop("points")
    g = ["league", "gw"]
    return written(places.row_places(places.competition_places(total, g, "total", "place"), g, [F.desc("total"), F.col("manager")], "line"))


def neighbour_runs(s: DataFrame) -> DataFrame:
    """league, one, two, gw, days: pairs that stand next to each other, and for how many days in a row until then."""
    keys = ["league", "gw", "line"]
    below = s.select("league", "gw", (F.col("line") - 1).alias("line"), F.col("manager").alias("other"))
    near = s.select(*keys, "manager").join(below, keys).select("league", "gw", F.least("manager", "other").alias("one"), F.greatest("manager", "other").alias("two"))
    pair = Window.partitionBy("league", "one", "two")
    islands = near.withColumn("island", F.col("gw") - F.row_number().over(pair.orderBy("gw")))
    return islands.withColumn("days", F.row_number().over(Window.partitionBy("league", "one", "two", "island").orderBy("gw")).cast("bigint")).drop("island")


@query(f"""WITH {DAILY}, near AS (SELECT a.league, a.gw, least(a.manager, b.manager) AS one, greatest(a.manager, b.manager) AS two FROM ranked a JOIN ranked b ON a.league = b.league AND a.gw = b.gw AND b.line = a.line + 1),
  islands AS (SELECT *, gw - row_number() OVER (PARTITION BY league, one, two ORDER BY gw) AS island FROM near), runs AS (SELECT *, row_number() OVER (PARTITION BY league, one, two, island ORDER BY gw) AS days FROM islands),
  pairs AS (SELECT a.league, a.gw, a.manager AS ahead, b.manager AS behind, x.place AS ahead_before, a.place AS ahead_place, y.place AS behind_before, b.place AS behind_place, a.total - b.total AS gap
    FROM ranked a JOIN ranked b ON a.league = b.league AND a.gw = b.gw JOIN ranked x ON x.manager = a.manager AND x.gw = a.gw - 1 JOIN ranked y ON y.manager = b.manager AND y.gw = b.gw - 1 WHERE y.total > x.total AND a.total > b.total)
  SELECT p.*, r.days FROM pairs p JOIN runs r ON r.league = p.league AND r.gw = p.gw - 1 AND r.one = least(p.ahead, p.behind) AND r.two = greatest(p.ahead, p.behind) WHERE r.days >= {NEIGHBOUR_DAYS}""")
def rivalry_by_streak(spark: SparkSession, sf: str) -> DataFrame:
    """Who overtook whom after standing next to each other for days in a row. Pairs come from the streaks, so a league's pairs are never formed."""
    s = standing(spark, sf)
    runs = neighbour_runs(s).where(F.col("days") >= NEIGHBOUR_DAYS).withColumn("gw", F.col("gw") + 1)
    at = lambda member, back, name: s.select("league", (F.col("gw") + back).alias("gw"), F.col("manager").alias(member), F.struct("total", "place").alias(name))
    x = runs
    for member in ("one", "two"):
        x = x.join(at(member, 0, f"{member}_now"), ["league", "gw", member]).join(at(member, 1, f"{member}_was"), ["league", "gw", member])
    gap, was = F.col("one_now.total") - F.col("two_now.total"), F.col("one_was.total") - F.col("two_was.total")
    x = x.where(gap * was < 0)
    one = gap > 0
    pick = lambda a, b: F.when(one, F.col(a)).otherwise(F.col(b))
    return x.select(
        "league", "gw", pick("one", "two").alias("ahead"), pick("two", "one").alias("behind"), pick("one_was.place", "two_was.place").alias("ahead_before"), pick("one_now.place", "two_now.place").alias("ahead_place"),
        pick("two_was.place", "one_was.place").alias("behind_before"), pick("two_now.place", "one_now.place").alias("behind_place"), F.abs(gap).alias("gap"), "days",
    )


@query("""WITH s AS (SELECT o_custkey, year(o_orderdate) AS y, sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS s FROM orders GROUP BY 1, 2), r AS (SELECT o_custkey, y, rank() OVER (PARTITION BY y ORDER BY s DESC) AS place FROM s),
  m AS (SELECT a.y, a.o_custkey, b.place AS before, a.place AS now, b.place - a.place AS moved FROM r a JOIN r b ON a.o_custkey = b.o_custkey AND b.y = a.y - 1)
  SELECT CAST(y AS INTEGER) AS y, o_custkey, before, now, moved, CASE WHEN moved = max(moved) OVER (PARTITION BY y) THEN 'up' ELSE 'down' END AS kind FROM m
  QUALIFY (moved = max(moved) OVER (PARTITION BY y) AND moved > 0) OR (moved = min(moved) OVER (PARTITION BY y) AND moved < 0)""")
def overall_movers(spark: SparkSession, sf: str) -> DataFrame:
    """The largest gains and losses of places of each year over the year before; ties all have them."""
    per = table(spark, sf, "orders").groupBy("o_custkey", F.year("o_orderdate").alias("y")).agg(F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint")).alias("s"))
    r = written(places.competition_places(per, ["y"], "s", "now").drop("s"))
    m = r.join(r.select("o_custkey", (F.col("y") + 1).alias("y"), F.col("now").alias("before")), ["o_custkey", "y"]).withColumn("moved", F.col("before") - F.col("now"))
    x = places.with_extremes(m, ["y"], "moved", "most", "least").where("(moved = most and moved > 0) or (moved = least and moved < 0)")
    return x.select("y", "o_custkey", "before", "now", "moved", F.when(F.col("moved") == F.col("most"), "up").otherwise("down").alias("kind"))


_SETS = "s AS (SELECT p_brand, list_sort(list_distinct(string_split(lower(p_name) || ' size ' || p_size || CASE WHEN p_partkey % 3 = 0 THEN ' ' || lower(p_type) ELSE '' END, ' '))) AS w, count(*) AS n, min(p_partkey) AS least FROM part GROUP BY 1, 2)"


@query(f"""WITH {_SETS} SELECT a.p_brand AS p_brand, array_to_string(a.w, ' ') AS part, array_to_string(b.w, ' ') AS whole, a.n AS n_part, b.n AS n_whole, a.least AS part_least, b.least AS whole_least
  FROM s a JOIN s b ON a.p_brand = b.p_brand AND len(a.w) < len(b.w) AND list_has_all(b.w, a.w)""")
def subset_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct token sets of a brand's parts of which one lies within another, with the parts of each: every third part's set names its type too."""
    more = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit(" "), F.lower("p_type"))).otherwise("")
    words = F.split(F.concat(F.lower("p_name"), F.lit(" size "), F.col("p_size").cast("string"), more), " ")
    c = written(containment.classes(table(spark, sf, "part").select("p_partkey", "p_brand", words.alias("w")), ["p_brand"], "w", "p_partkey"))
    return containment.within(c, ["p_brand"]).withColumn("part", F.array_join("part", " ")).withColumn("whole", F.array_join("whole", " "))


@query("""WITH k AS (SELECT p_partkey, p_brand, string_split(p_name, ' ')[-1] || p_size AS key FROM part), m AS (SELECT DISTINCT l_orderkey, key FROM lineitem JOIN k ON l_partkey = p_partkey),
  c AS (SELECT l_orderkey, key, k.p_partkey, k.p_brand, count(*) OVER (PARTITION BY l_orderkey, key) AS n FROM m JOIN k USING (key)), u AS (SELECT DISTINCT l_orderkey, p_brand FROM c WHERE n = 1),
  f AS (SELECT c.*, u.p_brand IS NOT NULL AS inside FROM c LEFT JOIN u USING (l_orderkey, p_brand)), q AS (SELECT * FROM f QUALIFY inside OR NOT bool_or(inside) OVER (PARTITION BY l_orderkey, key))
  SELECT l_orderkey, key, any_value(n) AS n_candidates, count(*) AS n_kept, CASE WHEN count(*) = 1 THEN min(p_partkey) END AS resolved FROM q GROUP BY 1, 2""")
def post_mentions(spark: SparkSession, sf: str) -> DataFrame:
    """What post_disambiguation keeps of each mention, counted: a mention meets the brands that its order is known to have, and no parts."""
    k = part_keys(spark, sf)
    m, n = mentions(spark, sf, k)
    total = k.groupBy("key").agg(F.count("*").alias("n_candidates"), F.min("p_partkey").alias("least"))
    brands = k.groupBy("key", "p_brand").agg(F.count("*").alias("of_brand"), F.min("p_partkey").alias("least_inside"))
    near = known_brands(m, k, n).join(brands, ["key", "p_brand"])
    sums = near.repartition(n, "l_orderkey", "key").groupBy("l_orderkey", "key").agg(F.sum("of_brand").alias("n_inside"), F.min("least_inside").alias("least_inside"))
    c = m.join(sums, ["l_orderkey", "key"], "left").join(total, "key")
    kept = F.coalesce("n_inside", "n_candidates")
    return c.select("l_orderkey", "key", "n_candidates", kept.alias("n_kept"), F.when(kept == 1, F.coalesce("least_inside", "least")).alias("resolved"))
