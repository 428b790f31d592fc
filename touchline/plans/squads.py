"""Queries on line-ups, transfers, alerts, linking and set evaluation, each with its SQL where SQL expresses it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import search, squads, vectors
from ..sources.store import written
from ..sources.tables import table, tasks_for
from .analysis import CLAIM, COS, FULLTEXT, _claims, QS
from .registry import Registry

query = Registry()
QUERIES, ORACLE = query.queries, query.oracle
#: Least and most of a role in the squads of squad_whatif.
WHATIF_LIMITS = {"K": (1, 1), "D": (1, 2), "M": (0, 2), "F": (0, 1)}


# line-ups and transfers


@query("""WITH a AS (SELECT l_orderkey, max(l_quantity) FILTER (l_linenumber = 1) AS q1, max(l_quantity) FILTER (l_linenumber = 2) AS q2 FROM lineitem GROUP BY 1)
  SELECT CASE WHEN q1 > 10 THEN 'captain' WHEN q2 > 10 THEN 'vice' ELSE 'nobody' END AS credited, CASE WHEN q1 > 10 THEN 2 * q1 WHEN q2 > 10 THEN 2 * q2 ELSE 0.0 END AS points, count(*) AS n FROM a GROUP BY 1, 2""")
def captain_groups(spark: SparkSession, sf: str) -> DataFrame:
    from .analysis import captain_credit

    return captain_credit(spark, sf).groupBy("credited", "points").agg(F.count("*").alias("n"))


@query("""WITH g AS (SELECT l_orderkey, l_linenumber, l_quantity - lag(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity) AS gain FROM lineitem)
  SELECT l_orderkey, count(*) AS n, sum(gain) AS gain, count(*) FILTER (gain < 0) AS misses, count(*) FILTER (gain >= 6) AS wins, sum(gain) > 4 * (count(*) - 1) AS paid_off FROM g WHERE gain IS NOT NULL GROUP BY 1""")
def transfers_gain(spark: SparkSession, sf: str) -> DataFrame:
    x = squads.exchanges(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), ["l_orderkey"], ["l_linenumber", "l_quantity"], "l_quantity", 6)
    out = x.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum("gain").alias("gain"), F.count_if("missed").alias("misses"), F.count_if("won").alias("wins"))
    return out.withColumn("paid_off", F.expr("gain > 4 * (n - 1)"))


@query("""SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'bench' WHEN 'O' THEN 'captain' ELSE 'squad' END AS chip,
  CASE o_orderstatus WHEN 'F' THEN coalesce(sum(l_quantity) FILTER (l_linenumber > 4), 0) WHEN 'O' THEN coalesce(max(l_quantity) FILTER (l_linenumber = 1), 0)
  ELSE sum(l_quantity) - coalesce(sum(l_quantity) FILTER (l_linenumber <= 4), 0) END::DOUBLE AS effect FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey, o_orderstatus""")
def chip_effect_case(spark: SparkSession, sf: str) -> DataFrame:
    q, line = F.col("l_quantity"), F.col("l_linenumber")
    sums = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.sum(q).alias("total"), F.coalesce(F.sum(F.when(line > 4, q)), F.lit(0.0)).alias("bench"), F.coalesce(F.sum(F.when(line <= 4, q)), F.lit(0.0)).alias("eleven"), F.coalesce(F.max(F.when(line == 1, q)), F.lit(0.0)).alias("captain"))
    j = table(spark, sf, "orders").join(sums, F.col("o_orderkey") == F.col("l_orderkey"))
    pick = lambda f, o, p: F.when(F.col("o_orderstatus") == "F", f).when(F.col("o_orderstatus") == "O", o).otherwise(p)
    return j.select("o_orderkey", pick(F.lit("bench"), F.lit("captain"), F.lit("squad")).alias("chip"), pick(F.col("bench"), F.col("captain"), F.col("total") - F.col("eleven")).alias("effect"))


@query("""WITH RECURSIVE m AS (SELECT l_orderkey, l_linenumber AS line, CASE WHEN l_linenumber IN (1, 5) THEN 'K' WHEN l_suppkey % 3 = 0 THEN 'D' WHEN l_suppkey % 3 = 1 THEN 'M' ELSE 'F' END AS role,
    l_quantity > 10 AS played, l_quantity AS points, CASE l_linenumber WHEN 2 THEN 1 WHEN 3 THEN 2 ELSE 0 END AS armband FROM lineitem),
  p AS (SELECT l_orderkey, list(m ORDER BY line, role, played, points) AS squad FROM m GROUP BY 1),
  s AS (SELECT l_orderkey, squad, 1 AS i, list_filter(squad, lambda x: x.line <= 4) AS xi, list_filter(squad, lambda x: x.line > 4) AS bench FROM p UNION ALL
    SELECT l_orderkey, squad, i + 1, CASE WHEN pick > 0 THEN xi[:i - 1] || [bench[pick]] || xi[i + 1:] ELSE xi END, CASE WHEN pick > 0 THEN bench[:pick - 1] || bench[pick + 1:] ELSE bench END
    FROM (SELECT *, CASE WHEN xi[i].played THEN 0 ELSE coalesce(list_position(list_transform(bench, lambda b: b.played AND (b.role = xi[i].role OR (b.role <> 'K' AND xi[i].role <> 'K'
      AND (xi[i].role <> 'D' OR len(list_filter(xi, lambda z: z.role = 'D')) > 1)
      AND len(list_filter(xi, lambda z: z.role = b.role)) < CASE b.role WHEN 'F' THEN 1 ELSE 2 END))), true), 0) END AS pick FROM s WHERE i <= len(xi))),
  f AS (SELECT l_orderkey, xi, list_filter(list_filter(squad, lambda x: x.armband = 1) || list_filter(squad, lambda x: x.armband = 2), lambda x: x.played)[1] AS worn FROM s WHERE i = len(xi) + 1)
  SELECT l_orderkey, len(xi) AS n_starters, coalesce(list_sum(list_transform(list_filter(xi, lambda x: x.played), lambda x: x.points)), 0)
    + CASE WHEN list_contains(xi, worn) THEN worn.points ELSE 0 END AS points FROM f""")
def squad_whatif(spark: SparkSession, sf: str) -> DataFrame:
    """Points of each order's squad after substitutions: lines 1-4 start, lines 1 and 5 are keepers, a squad has one or two defenders,
    up to two midfielders and up to one forward by substitution; line 2 is the captain, line 3 the vice."""
    li = table(spark, sf, "lineitem")
    line = F.col("l_linenumber")
    role = F.when(line.isin(1, 5), "K").otherwise(F.element_at(F.array(F.lit("D"), F.lit("M"), F.lit("F")), (F.col("l_suppkey") % 3 + 1).cast("int")))
    band = F.when(line == 2, 1).when(line == 3, 2).otherwise(0)
    p = li.select("l_orderkey", "l_linenumber", role.alias("role"), (F.col("l_quantity") > 10).alias("played"), F.col("l_quantity").alias("points"), band.alias("armband"))
    both = squads.lineups(p, ["l_orderkey"], "l_linenumber", 4, ["role", "played", "points", "armband"])
    final = both.withColumn("final", squads.counted("starters", "bench", WHATIF_LIMITS))
    points = F.aggregate(F.filter("final", lambda x: x["played"]), F.lit(0.0), lambda s, x: s + x["points"]) + squads.armband("starters", "bench", "final")
    return final.select("l_orderkey", F.size("starters").cast("bigint").alias("n_starters"), points.alias("points"))


@query("""WITH t AS (SELECT c_nationkey, c_custkey, CAST(sum(l_quantity) AS BIGINT) AS q FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
  r AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY q DESC, c_custkey) AS place FROM t QUALIFY place <= 2),
  h AS (SELECT r.c_nationkey, r.place, l_partkey, CAST(sum(l_quantity) AS BIGINT) AS q FROM r JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL),
  s AS (SELECT c_nationkey, l_partkey, CAST(sum(CASE place WHEN 1 THEN q ELSE -q END) AS BIGINT) AS swing FROM h GROUP BY 1, 2),
  k AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY abs(swing) >= 20 DESC, abs(swing) DESC, l_partkey) AS cause FROM s WHERE swing <> 0)
  SELECT c_nationkey, cause, l_partkey, swing FROM k WHERE cause <= 3""")
def decisive_cause(spark: SparkSession, sf: str) -> DataFrame:
    """The three parts that decide most between the first and second customer of each nation."""
    li, o, c = table(spark, sf, "lineitem"), table(spark, sf, "orders"), table(spark, sf, "customer")
    lines = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey", "l_partkey").agg(F.sum("l_quantity").cast("bigint").alias("q"))
    totals = lines.groupBy("o_custkey").agg(F.sum("q").alias("total")).join(c, F.col("o_custkey") == F.col("c_custkey"))
    w = Window.partitionBy("c_nationkey").orderBy(F.desc("total"), "c_custkey")
    two = totals.withColumn("place", F.row_number().over(w)).where("place <= 2").select("c_nationkey", "o_custkey", "place")
    s = lines.join(two, "o_custkey").groupBy("c_nationkey", "l_partkey").agg(F.sum(F.when(F.col("place") == 1, F.col("q")).otherwise(-F.col("q"))).alias("swing")).where("swing <> 0")
    order = Window.partitionBy("c_nationkey").orderBy(F.desc(F.abs("swing") >= 20), F.desc(F.abs("swing")), "l_partkey")
    return s.withColumn("cause", F.row_number().over(order).cast("bigint")).where("cause <= 3").select("c_nationkey", "cause", "l_partkey", "swing")


# joins


@query("""SELECT a.l_orderkey, a.l_linenumber, min(b.l_linenumber) AS quoted FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey = b.l_suppkey AND b.l_linenumber < a.l_linenumber GROUP BY 1, 2""")
def self_quote(spark: SparkSession, sf: str) -> DataFrame:
    """Lines that name the supplier of an earlier line of their order; a window instead of a self join."""
    w = Window.partitionBy("l_orderkey", "l_suppkey")
    later = table(spark, sf, "lineitem").withColumn("quoted", F.min("l_linenumber").over(w)).where("l_linenumber > quoted")
    return later.groupBy("l_orderkey", "l_linenumber").agg(F.min("quoted").alias("quoted"))


def _later(li: DataFrame, key: str, name: str) -> DataFrame:
    """Per key and date, the next date of that key."""
    days = li.select(key, "l_shipdate").distinct()
    return days.withColumn(name, F.lead("l_shipdate").over(Window.partitionBy(key).orderBy("l_shipdate")))


@query("""WITH p AS (SELECT l_partkey, l_shipdate, lead(l_shipdate) OVER (PARTITION BY l_partkey ORDER BY l_shipdate) AS n FROM (SELECT DISTINCT l_partkey, l_shipdate FROM lineitem)),
  s AS (SELECT l_suppkey, l_shipdate, lead(l_shipdate) OVER (PARTITION BY l_suppkey ORDER BY l_shipdate) AS n FROM (SELECT DISTINCT l_suppkey, l_shipdate FROM lineitem))
  SELECT l_orderkey, l_linenumber, least(p.n, s.n) AS next_at FROM lineitem l LEFT JOIN p USING (l_partkey, l_shipdate) LEFT JOIN s USING (l_suppkey, l_shipdate)""")
def asof_or_key(spark: SparkSession, sf: str) -> DataFrame:
    """The next shipment strictly after each line that shares its part or its supplier: one as-of lookup per key, then the earlier."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    j = li.join(_later(li, "l_partkey", "by_part"), ["l_partkey", "l_shipdate"], "left").join(_later(li, "l_suppkey", "by_supplier"), ["l_suppkey", "l_shipdate"], "left")
    return j.select("l_orderkey", "l_linenumber", F.least("by_part", "by_supplier").alias("next_at"))


# linking

NAME_KEYS = """SELECT DISTINCT key, c_custkey FROM (SELECT lower(c_name) AS key, c_custkey FROM customer UNION ALL SELECT unnest(string_split(lower(c_name), '#')), c_custkey FROM customer
  UNION ALL SELECT left(lower(c_name), 1) || string_split(lower(c_name), '#')[-1], c_custkey FROM customer) WHERE key <> ''"""


@query(NAME_KEYS)
def name_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Keys of a name: whole, each of its tokens, and initial with last token."""
    low = F.lower("c_name")
    parts = F.split(low, "#")
    keys = F.array_distinct(F.concat(F.array(low), parts, F.array(F.concat(F.left(low, F.lit(1)), F.element_at(parts, -1)))))
    return table(spark, sf, "customer").select(F.explode(keys).alias("key"), "c_custkey").where("key <> ''")


def part_keys(spark: SparkSession, sf: str) -> DataFrame:
    """p_partkey, p_brand, key: the last word of a part's name with its size."""
    key = F.concat(F.element_at(F.split("p_name", " "), -1), F.col("p_size").cast("string")).alias("key")
    return table(spark, sf, "part").select("p_partkey", "p_brand", key).where("key is not null")


def mentions(spark: SparkSession, sf: str, k: DataFrame) -> tuple[DataFrame, int]:
    """(l_orderkey, key), written once, and the number of tasks for its rows."""
    li = table(spark, sf, "lineitem").select("l_orderkey", F.col("l_partkey").alias("p_partkey"))
    n = tasks_for(li)
    m = li.repartition(n, "p_partkey").join(k.select("p_partkey", "key"), "p_partkey").select("l_orderkey", "key").repartition(n, "l_orderkey")
    return written(m.dropDuplicates(["l_orderkey", "key"])), n


def known_brands(m: DataFrame, k: DataFrame, n: int) -> DataFrame:
    """(l_orderkey, key, p_brand): each mention with the brands that its order is known to have, those of mentions with one candidate alone."""
    only = k.groupBy("key").agg(F.count("*").alias("n"), F.first("p_brand").alias("p_brand")).where("n = 1 and p_brand is not null").drop("n")
    known = m.join(only, "key").select("l_orderkey", "p_brand").distinct()
    return m.join(known, "l_orderkey").select("l_orderkey", "key", "p_brand")


@query("""WITH k AS (SELECT p_partkey, p_brand, string_split(p_name, ' ')[-1] || p_size AS key FROM part),
  m AS (SELECT DISTINCT l_orderkey, key FROM lineitem JOIN k ON l_partkey = p_partkey),
  c AS (SELECT l_orderkey, key, k.p_partkey, k.p_brand, count(*) OVER (PARTITION BY l_orderkey, key) AS n FROM m JOIN k USING (key)),
  u AS (SELECT DISTINCT l_orderkey, p_brand FROM c WHERE n = 1),
  f AS (SELECT c.*, u.p_brand IS NOT NULL AS inside FROM c LEFT JOIN u USING (l_orderkey, p_brand))
  SELECT l_orderkey, key, p_partkey, inside FROM f QUALIFY inside OR NOT bool_or(inside) OVER (PARTITION BY l_orderkey, key)""")
def post_disambiguation(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates of each mention of an order; unique mentions give its brands, and others narrow to those brands where some are left.

    Which brands a mention narrows to is settled by brands. Parts come last, in blocks of a key's (and of a key's and brand's), from where
    they go straight into the result: candidates are never shuffled, sorted or counted one by one.
    """
    k = part_keys(spark, sf)
    m, n = mentions(spark, sf, k)
    near = known_brands(m, k, n).join(k.select("key", "p_brand").distinct(), ["key", "p_brand"]).select("l_orderkey", "key", F.lit(True).alias("inside"), "p_brand")
    narrowed = near.select("l_orderkey", "key").distinct()
    whole = m.join(narrowed, ["l_orderkey", "key"], "left_anti").select("l_orderkey", "key", F.lit(False).alias("inside"), F.lit("").alias("p_brand"))
    asked = written(near.union(whole))
    either = k.where("p_brand is not null").select("key", F.lit(True).alias("inside"), "p_brand", "p_partkey").union(k.select("key", F.lit(False).alias("inside"), F.lit("").alias("p_brand"), "p_partkey"))
    block = F.pmod(F.xxhash64("p_partkey"), F.lit(tasks_for(k, rows=1 << 18)))
    slots = ["key", "inside", "p_brand"]
    blocks = written(either.groupBy(*slots, block.alias("block")).agg(F.collect_list(F.struct("p_partkey")).alias("parts")).drop("block"))
    sizes = blocks.groupBy(*slots).agg(F.sum(F.size("parts")).alias("n"))
    made = asked.groupBy(*slots).count().join(sizes, slots).agg(F.sum(F.col("count") * F.col("n"))).first()[0] or 0
    tasks = max(n, int(min(10_000, made // (16 << 20))))
    salts = max(1, min(64, tasks // 256))  # few keys: each is dealt to several tasks
    dealt = asked.withColumn("salt", F.pmod(F.xxhash64("l_orderkey"), F.lit(salts))).repartition(tasks, *slots, "salt")
    copies = blocks.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint")))).repartition(tasks, *slots, "salt")
    return dealt.join(copies, [*slots, "salt"]).select("l_orderkey", "key", F.inline("parts"), "inside")


# alerts


@query(f"""WITH e AS (SELECT event_id, user_id, ts, {CLAIM} AS claim FROM events),
  w AS (SELECT *, lag(claim) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM e),
  q AS (SELECT * FROM w WHERE claim <> 'available' OR (n = 1 AND before IS NOT NULL AND before <> 'available'))
  SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(claim, (ts, event_id)) AS claim FROM q GROUP BY 1""")
def anchor_choice(spark: SparkSession, sf: str) -> DataFrame:
    """The newest claim of each user; 'available' counts only as the newest of all and only where it reverses another claim."""
    up, down = Window.partitionBy("user_id").orderBy("ts", "event_id"), Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    w = _claims(spark, sf).withColumn("before", F.lag("claim").over(up)).withColumn("n", F.row_number().over(down))
    q = w.where("claim <> 'available' or (n = 1 and before <> 'available')")
    newest = F.max_by(F.struct("event_id", "claim"), F.struct("ts", "event_id")).alias("r")
    return q.groupBy("user_id").agg(newest).select("user_id", "r.event_id", "r.claim")


@query("""WITH e AS (SELECT date_trunc('month', ts) + INTERVAL 1 month AS deadline, max(ts) AS last_at FROM events GROUP BY 1), p AS (SELECT *, lag(last_at) OVER (ORDER BY deadline) AS before FROM e)
  SELECT strftime(deadline, '%Y-%m-%d') AS deadline, strftime(greatest(before + INTERVAL 2 hour, deadline - INTERVAL 7 day), '%Y-%m-%d %H:%M:%S') AS floor_at FROM p""")
def window_floor(spark: SparkSession, sf: str) -> DataFrame:
    """Where the window of each month's deadline begins: two hours after the month before ended, a week before it at the earliest."""
    e = table(spark, sf, "events").groupBy((F.date_trunc("month", "ts") + F.expr("interval 1 month")).alias("deadline")).agg(F.max("ts").alias("last_at"))
    before = F.lag("last_at").over(Window.orderBy("deadline"))  # a row a month
    floor_at = F.greatest(before + F.expr("interval 2 hours"), F.col("deadline") - F.expr("interval 7 days"))
    return e.select(F.date_format("deadline", "yyyy-MM-dd").alias("deadline"), F.date_format(floor_at, "yyyy-MM-dd HH:mm:ss").alias("floor_at"))


@query("""WITH p AS (SELECT l_partkey, count(*) FILTER (l_returnflag = 'N') AS owned, count(DISTINCT l_suppkey) AS suppliers, count(*) FILTER (l_returnflag = 'R') AS claims FROM lineitem GROUP BY 1)
  SELECT l_partkey, array_to_string(list_filter([CASE WHEN owned >= 15 THEN 'owned' END, CASE WHEN p_retailprice >= 1500 THEN 'wide' END, CASE WHEN suppliers >= 30 THEN 'trending' END], lambda x: x IS NOT NULL), ',') AS flags
  FROM p JOIN part ON l_partkey = p_partkey WHERE claims > 0 AND (owned >= 15 OR p_retailprice >= 1500 OR suppliers >= 30)""")
def listed_flags(spark: SparkSession, sf: str) -> DataFrame:
    """Claimed parts that are owned, widely held or trending, with the reasons in that order."""
    flag = F.col("l_returnflag")
    p = table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.count_if(flag == "N").alias("owned"), F.count_distinct("l_suppkey").alias("suppliers"), F.count_if(flag == "R").alias("claims")).where("claims > 0")
    j = p.join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    flags = F.array_compact(F.array(F.when(F.col("owned") >= 15, "owned"), F.when(F.col("p_retailprice") >= 1500, "wide"), F.when(F.col("suppliers") >= 30, "trending")))
    return j.where(F.size(flags) > 0).select("l_partkey", F.array_join(flags, ",").alias("flags"))


@query("""WITH f AS (SELECT user_id, event_type, min(ts) AS first_at FROM events GROUP BY 1, 2), d AS (SELECT DISTINCT user_id, event_type FROM events WHERE ts < (SELECT min(ts) + INTERVAL 7 day FROM events))
  SELECT user_id, event_type, first_at FROM f ANTI JOIN d USING (user_id, event_type)""")
def newness(spark: SparkSession, sf: str) -> DataFrame:
    """Kinds of event of a user that the first week's digest did not include."""
    e = table(spark, sf, "events")
    since = e.agg((F.min("ts") + F.expr("interval 7 days")).alias("since"))
    included = e.join(F.broadcast(since), F.col("ts") < F.col("since")).select("user_id", "event_type").distinct()  # one row is broadcast
    return e.groupBy("user_id", "event_type").agg(F.min("ts").alias("first_at")).join(included, ["user_id", "event_type"], "left_anti")


# evaluation


@query("""WITH c AS (SELECT quality AS truth, CAST(n_chars > 800 AS INTEGER) AS found FROM labels JOIN documents USING (doc_id)), l AS (SELECT DISTINCT truth AS label FROM c)
  SELECT CAST(label AS INTEGER) AS label, count(*) FILTER (truth = label AND found = label)::DOUBLE / nullif(count(*) FILTER (found = label), 0) AS precision,
  count(*) FILTER (truth = label AND found = label)::DOUBLE / nullif(count(*) FILTER (truth = label), 0) AS recall, count(*) FILTER (truth = found)::DOUBLE / count(*) AS accuracy FROM c, l GROUP BY 1""")
def label_prf(spark: SparkSession, sf: str) -> DataFrame:
    """Precision and recall of each label (null without a denominator) and the accuracy over all, from one confusion count."""
    j = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id")
    cells = j.groupBy(F.col("quality").cast("int").alias("truth"), (F.col("n_chars") > 800).cast("int").alias("found")).agg(F.count("*").alias("n"))
    sides = cells.select(F.col("truth").alias("label"), F.col("n").alias("t"), F.lit(0).alias("f"), F.when(F.col("truth") == F.col("found"), F.col("n")).otherwise(0).alias("hit")).union(
        cells.select("found", F.lit(0), F.col("n"), F.lit(0)))
    per = sides.groupBy("label").agg(F.sum("t").alias("t"), F.sum("f").alias("f"), F.sum("hit").alias("hit"))
    every = Window.partitionBy(F.lit(1))  # a row a label
    rate = lambda a, b: F.try_divide(a.cast("double"), b.cast("double"))
    out = per.withColumn("accuracy", rate(F.sum("hit").over(every), F.sum("t").over(every))).where("t > 0")
    return out.select("label", rate(F.col("hit"), F.col("f")).alias("precision"), rate(F.col("hit"), F.col("t")).alias("recall"), "accuracy")


@query("""WITH b AS (SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE o_custkey % 3 <> 0), n AS (SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'P' ELSE o_orderstatus END AS o_orderstatus, o_orderpriority FROM orders WHERE o_custkey % 3 <> 1)
  SELECT o_orderkey, CASE WHEN b.o_orderkey IS NULL THEN 'added' WHEN n.o_orderkey IS NULL THEN 'removed' ELSE 'relabelled' END AS change, b.o_orderstatus AS was, n.o_orderstatus AS now
  FROM b FULL JOIN n USING (o_orderkey) WHERE b.o_orderkey IS NULL OR n.o_orderkey IS NULL OR b.o_orderstatus <> n.o_orderstatus""")
def set_diff(spark: SparkSession, sf: str) -> DataFrame:
    """Rows added, removed and relabelled between two versions of a set of cases."""
    o = table(spark, sf, "orders")
    b = o.where("o_custkey % 3 <> 0").select("o_orderkey", F.col("o_orderstatus").alias("was"))
    n = o.where("o_custkey % 3 <> 1").select("o_orderkey", F.when(F.col("o_totalprice") > 200000, "P").otherwise(F.col("o_orderstatus")).alias("now"))
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").otherwise("relabelled")
    return b.join(n, "o_orderkey", "full_outer").where("not (was <=> now)").select("o_orderkey", change.alias("change"), "was", "now")


@query("""WITH s AS (SELECT s_nationkey, l_suppkey, count(*) FILTER (l_returnflag <> 'R')::DOUBLE / count(*) AS quality, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS cost FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2)
  SELECT s_nationkey, l_suppkey, quality, cost, quality >= 0.5 AS passed FROM s QUALIFY row_number() OVER (PARTITION BY s_nationkey ORDER BY quality >= 0.5 DESC, CASE WHEN quality >= 0.5 THEN cost END, quality DESC, cost, l_suppkey) = 1""")
def model_select(spark: SparkSession, sf: str) -> DataFrame:
    """Of each nation's suppliers the cheapest that passes, without one the best by quality, then cost."""
    cost = F.sum(F.round(F.col("l_extendedprice") * 100).cast("bigint"))
    s = table(spark, sf, "lineitem").groupBy("l_suppkey").agg((F.count_if(F.col("l_returnflag") != "R") / F.count("*")).alias("quality"), cost.alias("cost"))
    s = s.join(table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).withColumn("passed", F.col("quality") >= 0.5)
    order = F.struct(~F.col("passed"), F.when(F.col("passed"), F.col("cost")), -F.col("quality"), "cost", "l_suppkey")
    return s.groupBy("s_nationkey").agg(F.min_by(F.struct("l_suppkey", "quality", "cost", "passed"), order).alias("r")).select("s_nationkey", "r.*")


@query(f"""WITH f AS (SELECT q, id, place FROM ({FULLTEXT}), ({QS}) WHERE place <= 20), v AS (SELECT q, id, place FROM ({COS}) WHERE place <= 20)
  SELECT coalesce(f.q, v.q) AS q, coalesce(f.id, v.id) AS id, f.place AS text_place, v.place AS vector_place FROM f FULL JOIN v ON f.q = v.q AND f.id = v.id""")
def pooled_union(spark: SparkSession, sf: str) -> DataFrame:
    """The pool of each query to be judged: the first twenty of each ranking, each row once, with its places."""
    from .analysis import _cosine, _full_text, each_query

    f = each_query(spark, sf, _full_text(spark, sf).where("place <= 20")).select("q", "id", F.col("place").alias("text_place"))
    v = _cosine(spark, sf).where("place <= 20").select("q", "id", F.col("place").alias("vector_place"))
    return f.join(v, ["q", "id"], "full_outer").select("q", "id", "text_place", "vector_place")


@query(f"""WITH r AS (SELECT q, id, row_number() OVER (PARTITION BY q ORDER BY place) AS place FROM ({COS}) c WHERE id <> q AND place <= 40), w AS (SELECT vec_id AS q, label FROM embeddings WHERE vec_id % 100 = 0),
  t AS (SELECT w.q, count(*) AS total FROM w JOIN embeddings e ON e.label = w.label AND e.vec_id <> w.q GROUP BY 1)
  SELECT r.q, count(*) AS shown, count(*) FILTER (e.label = w.label) AS relevant, min(t.total) AS total FROM r JOIN embeddings e ON id = vec_id JOIN w ON w.q = r.q JOIN t ON t.q = r.q WHERE place <= 10 GROUP BY r.q""")
def judge_cut(spark: SparkSession, sf: str) -> DataFrame:
    """What a judge sees of each query's ranking: the query's own row is left out, the rest ranked anew, ten are shown."""
    from .analysis import _cosine, asked

    e = table(spark, sf, "embeddings").select("vec_id", "label")
    w = asked(e).select(F.col("vec_id").alias("q"), F.col("label").alias("wanted"))
    of_label = e.groupBy(F.col("label").alias("wanted")).agg((F.count("*") - 1).alias("total"))
    near = _cosine(spark, sf).where("place <= 40 and id <> q").withColumn("seen", F.row_number().over(Window.partitionBy("q").orderBy("place"))).where("seen <= 10")
    return near.join(e, F.col("id") == F.col("vec_id")).join(w, "q").join(of_label, "wanted").groupBy("q").agg(F.count("*").alias("shown"), F.count_if(F.col("label") == F.col("wanted")).alias("relevant"), F.min("total").alias("total"))


# search and pages

FILTERED = FULLTEXT.replace("FROM documents", "FROM documents WHERE n_chars >= 400")
FILTERED_COS = COS.replace("FROM embeddings e,", "FROM (SELECT * FROM embeddings WHERE label <> 0) e,")


@query(f"""WITH f AS ({FILTERED}), v AS ({FILTERED_COS}), s AS (SELECT q, id, round(sum(1.0 / (60 + place)), 9) AS score, min(place) AS best FROM (SELECT q, place, id FROM f, ({QS}) UNION ALL SELECT q, place, id FROM v) GROUP BY 1, 2)
  SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY q ORDER BY score DESC, best, id DESC) <= 20""")
def hybrid_filtered(spark: SparkSession, sf: str) -> DataFrame:
    """Both legs filtered inside, to depth 50, fused; the first twenty of each query."""
    from .analysis import TERMS, asked, each_query

    docs, e = table(spark, sf, "documents").where("n_chars >= 400"), table(spark, sf, "embeddings")
    legs = [each_query(spark, sf, search.full_text(docs, "doc_id", "text", TERMS, 50)), vectors.nearest_each(e.where("label <> 0"), asked(e), "vec_id", "embedding", 50)]
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "best", F.desc("id")))
    return search.fuse(legs, ["q"]).withColumn("score", F.round("score", 9)).withColumn("n", place).where("n <= 20").drop("n")


@query("""SELECT page_id, regexp_extract(html, '<title>([^<]*)', 1) AS title, CAST(len(regexp_extract_all(html, '<a ')) AS BIGINT) AS links, md5(trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[ \\t\\n\\r]+', ' ', 'g'))) AS text_md5 FROM pages""")
def page_text_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Title, number of links and digest of the text of each page."""
    words = F.trim(F.regexp_replace(F.regexp_replace("html", "<[^>]*>", " "), r"[ \t\n\r]+", " "))
    return table(spark, sf, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)", 1).alias("title"), F.regexp_count("html", F.lit("<a ")).cast("bigint").alias("links"), F.md5(words).alias("text_md5"))


@query("SELECT doc_id, CASE WHEN doc_id % 10 < 3 THEN 'dev' ELSE 'test' END AS split FROM labels")
def id_split(spark: SparkSession, sf: str) -> DataFrame:
    """The split of evaluation cases by the last digit of the id, as the cases' format fixes it."""
    return table(spark, sf, "labels").select("doc_id", F.when(F.pmod("doc_id", F.lit(10)) < 3, "dev").otherwise("test").alias("split"))
