"""Queries on archived payloads and keyed tables. Orders stand for fixtures, their lines for players' statistics; each fixture was fetched once or
twice, some payloads are broken, and some name another week. Events stand for raw posts in three shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import archive, keyed, store
from ..sources.tables import table
from .registry import Registry

query = Registry()
QUERIES, ORACLE = query.queries, query.oracle


def fetched(spark: SparkSession, sf: str) -> DataFrame:
    """season, gw, fixture_key, fetch, payload: the log of fetches. The first lacks the away side; every fifth priority has no second."""
    li = table(spark, sf, "lineitem")
    entry = F.struct(F.col("l_partkey").alias("element"), F.col("l_quantity").cast("bigint").alias("value"))
    side = lambda s: F.collect_list(F.when(F.col("l_linestatus") == s, entry))
    stats = li.groupBy("l_orderkey", F.col("l_returnflag").alias("identifier")).agg(side("O").alias("h"), side("F").alias("a"))
    rows = stats.groupBy("l_orderkey").agg(F.collect_list(F.struct("identifier", "h", "a")).alias("whole"), F.collect_list(F.struct("identifier", "h")).alias("home"))  # the lines of an order
    o = table(spark, sf, "orders").select("o_orderkey", F.year("o_orderdate").alias("season"), F.month("o_orderdate").alias("gw"), "o_orderpriority")
    x = rows.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    event = F.when(F.col("o_orderkey") % 20 == 0, F.col("gw") + 1).otherwise(F.col("gw"))
    body = lambda c: F.to_json(F.struct(F.col("o_orderkey").alias("id"), event.alias("event"), F.col(c).alias("stats")))
    second = F.when(F.col("o_orderkey") % 50 == 1, F.left(body("whole"), F.lit(25))).otherwise(body("whole"))
    tries = F.array(F.struct(F.lit(1).alias("fetch"), body("home").alias("payload")), F.struct(F.lit(2).alias("fetch"), second.alias("payload")))
    return x.select("season", "gw", F.col("o_orderkey").alias("fixture_key"), F.explode(tries).alias("t"), "o_orderpriority").select("season", "gw", "fixture_key", "t.*", "o_orderpriority").where("fetch = 1 or o_orderpriority <> '5-LOW'").drop("o_orderpriority")


_STATS = """stats AS (SELECT year(o_orderdate) AS season, month(o_orderdate) AS gw, o_orderkey AS fixture, l_partkey AS player, l_returnflag AS identifier, CASE l_linestatus WHEN 'O' THEN 'h' ELSE 'a' END AS side, CAST(l_quantity AS BIGINT) AS value
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderkey % 20 <> 0 AND CASE WHEN o_orderpriority = '5-LOW' THEN l_linestatus = 'O' ELSE o_orderkey % 50 <> 1 END),
  kept AS (SELECT * FROM stats QUALIFY row_number() OVER (PARTITION BY fixture, player, identifier ORDER BY side, value) = 1)"""


def _stats(spark: SparkSession, sf: str) -> DataFrame:
    keys = ["season", "gw", "fixture_key"]
    return archive.fixture_stats(archive.opened(fetched(spark, sf), keys, ["fetch"], "payload"), keys, "gw").drop("fixture_key")


@query(f"WITH {_STATS} SELECT CAST(season AS INTEGER) AS season, CAST(gw AS INTEGER) AS gw, fixture, player, identifier, side, value FROM kept")
def archived_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Statistics of each fixture from its latest payload, home and away as rows."""
    return _stats(spark, sf)


@query(f"""WITH {_STATS}, best AS (SELECT fixture, player, sum(value) AS points FROM kept GROUP BY 1, 2)
  SELECT l_orderkey AS fixture, l_partkey AS player, CAST(coalesce(any_value(points), sum(CAST(trunc(l_extendedprice) AS BIGINT))) AS BIGINT) AS points FROM lineitem LEFT JOIN best ON fixture = l_orderkey AND player = l_partkey GROUP BY 1, 2""")
def back_fill(spark: SparkSession, sf: str) -> DataFrame:
    """Results whose points are taken from the archive where it has them."""
    own = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("fixture"), F.col("l_partkey").alias("player")).agg(F.sum(F.col("l_extendedprice").cast("bigint")).alias("points"))
    return archive.back_filled(own, _stats(spark, sf).groupBy("fixture", "player").agg(F.sum("value").alias("points")), ["fixture", "player"], "points")


@query("""WITH e AS (SELECT event_id AS post, user_id AS a, event_id // 2 AS b, event_id % 4 AS shape, event_id % 11 = 0 AS bad FROM events)
  SELECT post, 'repost' AS kind, a AS origin FROM e WHERE shape IN (0, 1) AND NOT (bad AND shape = 1) UNION SELECT post, 'quote', b FROM e WHERE shape IN (0, 2) AND NOT (bad AND shape = 0)""")
def post_origins(spark: SparkSession, sf: str) -> DataFrame:
    """The posts that each raw post names: a list of references, an embedded post, an id beside the text, or text that is no JSON."""
    a, b, bad = F.col("user_id"), F.expr("event_id div 2"), F.col("event_id") % 11 == 0
    reference = lambda kind, c: F.struct(F.lit(kind).alias("type"), c.cast("string").alias("id"))
    listed = F.to_json(F.struct(F.array(reference("retweeted", a), reference("quoted", F.when(bad, F.lit("x1")).otherwise(b.cast("string"))), reference("replied_to", b), reference("retweeted", a)).alias("referenced_tweets")))
    embedded = F.to_json(F.struct(F.struct(F.when(bad, F.lit("none")).otherwise(a.cast("string")).alias("id_str")).alias("retweeted_status")))
    beside = F.to_json(F.struct(F.lit("text").alias("text"), b.alias("quoted_status_id")))
    shape = F.col("event_id") % 4
    raw = F.when(shape == 0, listed).when(shape == 1, embedded).when(shape == 2, beside).otherwise(F.lit("{not json"))
    return archive.origins(table(spark, sf, "events").select("event_id", raw.alias("raw")), "event_id", "raw")


@query("""SELECT user_id, event_type, max(ts) AS last_at, CAST(arg_max(event_id, (ts, event_id)) AS BIGINT) AS last_event, bool_and(value > 1) AS all_large, bool_or(value > 100) AS any_large, count(*) AS n FROM events GROUP BY 1, 2""")
def keyed_events(spark: SparkSession, sf: str) -> DataFrame:
    """The newest event of each user and kind with its flags and count, as a keyed table into which the events came in three batches."""
    e = table(spark, sf, "events")
    rows = e.select("user_id", "event_type", F.col("ts").alias("last_at"), F.col("event_id").alias("last_event"), (F.col("value") > 1).alias("all_large"), (F.col("value") > 100).alias("any_large"), F.lit(1).cast("bigint").alias("n"), F.pmod(F.xxhash64("event_id"), F.lit(3)).alias("batch"))
    path, rules = store.new_path(spark, "keyed"), {"last_event": "last", "all_large": "and", "any_large": "or", "n": "sum"}
    for k in (2, 0, 1):  # in whichever order they come
        keyed.merge(rows.where(F.col("batch") == k), path, ["user_id", "event_type"], ["last_at"], rules, f"batch-{k}", 16)
    return keyed.read(spark, path, "user_id bigint, event_type string, last_at timestamp_ntz, last_event bigint, all_large boolean, any_large boolean, n bigint")
