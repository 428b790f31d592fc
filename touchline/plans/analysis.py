"""Queries on aggregates, text, search, rules, facts and evaluation, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import containment, evaluation, places, rules, search, vectors
from ..sources.store import written
from ..sources.tables import table, tasks_for
from .registry import Registry

query = Registry()
QUERIES, ORACLE = query.queries, query.oracle


# aggregates


@query("""SELECT l_returnflag, count(*) AS n, count(*) FILTER (l_linestatus = 'O') AS n_open, quantile_disc(date_diff('day', o_orderdate, l_shipdate), 0.5)::DOUBLE AS p50,
  quantile_disc(date_diff('day', o_orderdate, l_shipdate), 0.95)::DOUBLE AS p95, CAST(max(date_diff('day', o_orderdate, l_shipdate)) AS BIGINT) AS longest FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1""")
def latency_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    j = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    lag = F.datediff("l_shipdate", "o_orderdate").cast("bigint")
    return j.withColumn("lag", lag).groupBy("l_returnflag").agg(
        F.count("*").alias("n"), F.count_if(F.col("l_linestatus") == "O").alias("n_open"), F.expr("percentile_disc(0.5) within group (order by lag)").alias("p50"),
        F.expr("percentile_disc(0.95) within group (order by lag)").alias("p95"), F.max("lag").alias("longest"))


@query("""SELECT l_orderkey, count(*) FILTER (l_returnflag = 'A') AS a, count(*) FILTER (l_returnflag = 'N') AS n, count(*) FILTER (l_returnflag = 'R') AS r FROM lineitem GROUP BY 1""")
def eav_pivot(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "lineitem").groupBy("l_orderkey").pivot("l_returnflag", ["A", "N", "R"]).count().na.fill(0)
    return p.select("l_orderkey", F.col("A").alias("a"), F.col("N").alias("n"), F.col("R").alias("r"))


@query("""SELECT o_custkey, max(o_orderkey) FILTER (o_orderstatus = 'F') AS last_done, max(o_orderkey) FILTER (o_orderstatus = 'O') AS last_open FROM orders GROUP BY 1 HAVING max(o_orderkey) FILTER (o_orderstatus = 'F') IS NOT NULL""")
def conditional_pair(spark: SparkSession, sf: str) -> DataFrame:
    last = lambda s: F.max(F.when(F.col("o_orderstatus") == s, F.col("o_orderkey")))
    return table(spark, sf, "orders").groupBy("o_custkey").agg(last("F").alias("last_done"), last("O").alias("last_open")).where("last_done is not null")


@query("""SELECT o_custkey, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderdate, o_orderkey) AS orders FROM orders GROUP BY 1""")
def ordered_collect(spark: SparkSession, sf: str) -> DataFrame:
    rows = F.sort_array(F.collect_list(F.struct("o_orderdate", "o_orderkey")))
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.concat_ws(",", F.transform(rows, lambda x: x["o_orderkey"].cast("string"))).alias("orders"))


@query("""SELECT user_id, count(DISTINCT event_type) AS kinds FROM events GROUP BY 1 HAVING count(DISTINCT event_type) >= 4""")
def distinct_threshold(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy("user_id").agg(F.count_distinct("event_type").alias("kinds")).where("kinds >= 4")


@query("""SELECT n_name, c_mktsegment, grouping(n_name) AS all_nations, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ROLLUP (n_name, c_mktsegment)""")
def slices_and_all(spark: SparkSession, sf: str) -> DataFrame:
    j = table(spark, sf, "customer").join(F.broadcast(table(spark, sf, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return j.rollup("n_name", "c_mktsegment").agg(F.grouping("n_name").cast("bigint").alias("all_nations"), F.count("*").alias("n"))


@query("""SELECT CAST(event_id AS BIGINT) AS event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events""")
def json_path(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", F.expr("try_cast(get_json_object(props, '$.k') as bigint)").alias("k"))


# text and scalar functions

NORM = "trim(regexp_replace(regexp_replace(translate(replace(replace(replace(replace(lower({0}), 'æ', 'ae'), 'œ', 'oe'), 'ß', 'ss'), 'þ', 'th'), '" + text.MARKED + "', '" + text.PLAIN + "'), '[.''’\\-]', ' ', 'g'), '[ \\t\\n\\r\\f\\v]+', ' ', 'g'))"


@query(f"SELECT doc_id, md5({NORM.format('text')}) AS digest FROM documents")
def normalise_text(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.md5(text.normalise(F.col("text"))).alias("digest"))


@query("""WITH t AS (SELECT p_partkey, p_brand, list_distinct(string_split(lower(p_name), ' ')) AS w FROM part)
  SELECT a.p_partkey AS one, b.p_partkey AS two FROM t a JOIN t b ON a.p_brand = b.p_brand AND a.p_partkey < b.p_partkey
  WHERE len(list_filter(a.w, lambda x: NOT list_contains(b.w, x))) = 0 OR len(list_filter(b.w, lambda x: NOT list_contains(a.w, x))) = 0""")
def token_subset(spark: SparkSession, sf: str) -> DataFrame:
    """Parts of a brand of which one's words all stand in the other's name. Sets of words are compared, and parts paired by them."""
    t = table(spark, sf, "part").select("p_partkey", "p_brand", F.split(F.lower("p_name"), " ").alias("w"))
    return containment.pairs(t, ["p_brand"], "w", "p_partkey")


@query("SELECT o_orderkey, printf('%d/%02d', year(o_orderdate), (year(o_orderdate) + 1) % 100) AS season FROM orders")
def season_labels(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderkey", text.season_label(F.year("o_orderdate")).alias("season"))


@query("""SELECT event_id, CASE WHEN event_type <> 'view' AND value IS NOT NULL THEN value / 1e6 * 2.5 + coalesce(CAST(user_id AS DOUBLE) / 1e6 * 10.0, 0) END AS cost FROM events""")
def token_cost(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select("event_id", text.token_cost(F.col("value"), F.col("user_id").cast("double"), F.when(F.col("event_type") != "view", F.lit(2.5)), F.lit(10.0)).alias("cost"))


@query("""WITH r AS (SELECT o_custkey, year(o_orderdate) AS y, rank() OVER (PARTITION BY year(o_orderdate) ORDER BY sum(CAST(round(o_totalprice * 100) AS BIGINT)) DESC) AS place FROM orders GROUP BY 1, 2)
  SELECT a.o_custkey, CAST(a.y AS INTEGER) AS y, b.place AS before, a.place AS now, array_to_string(list_filter([10, 50, 100, 500], lambda x: a.place <= x AND b.place > x), ',') AS entered,
    a.place * 2 <= b.place OR a.place >= b.place * 2 OR a.place <= 10 AS notable FROM r a JOIN r b ON a.o_custkey = b.o_custkey AND b.y = a.y - 1""")
def thresholds_notable(spark: SparkSession, sf: str) -> DataFrame:
    per = table(spark, sf, "orders").groupBy("o_custkey", F.year("o_orderdate").alias("y")).agg(F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint")).alias("s"))
    r = written(places.competition_places(per, ["y"], "s", "now").drop("s"))
    j = r.join(r.select("o_custkey", (F.col("y") + 1).alias("y"), F.col("now").alias("before")), ["o_custkey", "y"])
    entered = F.array_join(F.transform(text.thresholds_entered(F.col("before"), F.col("now"), [10, 50, 100, 500]), lambda x: x.cast("string")), ",")
    return j.select("o_custkey", "y", "before", "now", entered.alias("entered"), F.expr("now * 2 <= before or now >= before * 2 or now <= 10").alias("notable"))


# search and linking

TERMS = ["than", "ering", "of"]
TOKENS = "SELECT doc_id AS id, unnest(list_filter(regexp_split_to_array(" + NORM.format("text") + ", '[^a-z0-9]+'), lambda x: x <> '')) AS term FROM documents"
HIT = "CASE WHEN starts_with(term, 'than') THEN 'than' WHEN starts_with(term, 'ering') THEN 'ering' WHEN term = 'of' THEN 'of' END"
FULLTEXT = f"SELECT row_number() OVER (ORDER BY matched DESC, tf DESC, id DESC) AS place, * FROM (SELECT id, count(DISTINCT q) AS matched, count(*) AS tf FROM (SELECT id, {HIT} AS q FROM ({TOKENS})) WHERE q IS NOT NULL GROUP BY 1) QUALIFY place <= 50"


def _full_text(spark: SparkSession, sf: str) -> DataFrame:
    return search.full_text(table(spark, sf, "documents"), "doc_id", "text", TERMS, 50)


@query(FULLTEXT)
def fulltext_or_prefix(spark: SparkSession, sf: str) -> DataFrame:
    return _full_text(spark, sf)


COS = """SELECT q.vec_id AS q, e.vec_id AS id, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY score DESC, e.vec_id DESC) AS place
  FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id % 100 = 0) q QUALIFY place <= 50"""


def asked(e: DataFrame) -> DataFrame:
    """The queries of a search: every row whose id is divisible by 100."""
    return e.where("vec_id % 100 = 0")


def _cosine(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    return vectors.nearest_each(e, asked(e), "vec_id", "embedding", 50)


@query(COS)
def cosine_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _cosine(spark, sf)


def each_query(spark: SparkSession, sf: str, leg: DataFrame) -> DataFrame:
    """A short leg (its depth bounds it) for every query."""
    return asked(table(spark, sf, "embeddings")).select(F.col("vec_id").alias("q")).crossJoin(F.broadcast(leg))


QS = "SELECT vec_id AS q FROM embeddings WHERE vec_id % 100 = 0"


@query(f"WITH f AS ({FULLTEXT}), v AS ({COS}) SELECT q, id, round(sum(1.0 / (60 + place)), 9) AS score, min(place) AS best FROM (SELECT q, place, id FROM f, ({QS}) UNION ALL SELECT q, place, id FROM v) GROUP BY 1, 2")
def rrf_fuse(spark: SparkSession, sf: str) -> DataFrame:
    return search.fuse([each_query(spark, sf, _full_text(spark, sf)), _cosine(spark, sf)], ["q"]).select("q", "id", F.round("score", 9).alias("score"), "best")


@query("""WITH k AS (SELECT lower(c_name) AS key, c_custkey AS target, 0 AS tier FROM customer UNION ALL SELECT string_split(lower(c_name), '#')[2], c_custkey, 1 FROM customer UNION ALL SELECT right(c_name, 3), c_custkey, 2 FROM customer),
  m AS (SELECT DISTINCT right(s_name, 3) AS mention FROM supplier), h AS (SELECT DISTINCT mention, target, tier FROM m JOIN k ON mention = key)
  SELECT mention, target, tier FROM (SELECT *, min(tier) OVER (PARTITION BY mention) AS low FROM h) WHERE tier = low""")
def tier_resolve(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    keyed = lambda key, tier: c.select(key.alias("key"), F.col("c_custkey").alias("target"), F.lit(tier).alias("tier"))
    keys = keyed(F.lower("c_name"), 0).union(keyed(F.get(F.split(F.lower("c_name"), "#"), 1), 1)).union(keyed(F.substring("c_name", -3, 3), 2))
    return search.resolve(table(spark, sf, "supplier").select(F.substring("s_name", -3, 3).alias("mention")).distinct(), keys)


# rules

CLAIM = "CASE event_type WHEN 'error' THEN 'out' WHEN 'signup' THEN 'doubt' WHEN 'purchase' THEN 'available' WHEN 'click' THEN 'benched' ELSE 'confirmed_starter' END"
LABEL = "CASE WHEN {0} = {1} THEN 'supports' WHEN " + " OR ".join(f"({{0}} = '{a}' AND {{1}} = '{b}') OR ({{0}} = '{b}' AND {{1}} = '{a}')" for a, b in rules.CONTRADICT) + " THEN 'contradicts' ELSE 'related' END"


def _claims(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("event_type")
    claim = F.when(t == "error", "out").when(t == "signup", "doubt").when(t == "purchase", "available").when(t == "click", "benched").otherwise("confirmed_starter")
    return table(spark, sf, "events").select("event_id", "user_id", "ts", F.to_date("ts").alias("day"), claim.alias("claim"), "value")


@query(f"WITH t AS (SELECT DISTINCT {CLAIM} AS c FROM events) SELECT a.c AS anchor, b.c AS other, {LABEL.format('a.c', 'b.c')} AS label FROM t a, t b")
def label_matrix(spark: SparkSession, sf: str) -> DataFrame:
    t = _claims(spark, sf).select("claim").distinct()
    return t.select(F.col("claim").alias("anchor")).crossJoin(F.broadcast(t.select(F.col("claim").alias("other")))).withColumn("label", rules.label(F.col("anchor"), F.col("other")))


@query(f"SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, user_id, event_id, {CLAIM} AS claim FROM events QUALIFY row_number() OVER (PARTITION BY CAST(ts AS DATE), user_id ORDER BY ts DESC, event_id DESC) = 1")
def account_newest(spark: SparkSession, sf: str) -> DataFrame:
    n = rules.newest_per_account(_claims(spark, sf), ["day"], "user_id", ["ts", "event_id"])
    return n.select(F.col("day").cast("string").alias("day"), "user_id", "event_id", "claim")


GRADED = f"""WITH n AS (SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, user_id, event_id, ts, {CLAIM} AS claim FROM events QUALIFY row_number() OVER (PARTITION BY CAST(ts AS DATE), user_id ORDER BY ts DESC, event_id DESC) = 1),
  a AS (SELECT day, claim AS anchor FROM n QUALIFY row_number() OVER (PARTITION BY day ORDER BY ts DESC, event_id DESC) = 1),
  s AS (SELECT day, anchor, count(*) FILTER ({LABEL.format('anchor', 'claim')} = 'supports') - 1 AS weight, count(*) FILTER ({LABEL.format('anchor', 'claim')} = 'contradicts') AS against FROM n JOIN a USING (day) GROUP BY 1, 2),
  l AS (SELECT *, CASE WHEN weight >= 2 OR (anchor = 'confirmed_starter' AND weight >= 1) THEN 2 WHEN weight >= 1 OR anchor = 'confirmed_starter' THEN 1 ELSE 0 END - CASE WHEN against > 3 THEN 1 ELSE 0 END AS lv FROM s)
  SELECT day, anchor, weight, against, CASE greatest(lv, 0) WHEN 2 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS grade FROM l"""


@query(GRADED)
def corroboration_grade(spark: SparkSession, sf: str) -> DataFrame:
    n = rules.newest_per_account(_claims(spark, sf), ["day"], "user_id", ["ts", "event_id"])
    anchor = n.groupBy("day").agg(F.max_by("claim", F.struct("ts", "event_id")).alias("anchor"))
    lab = rules.label(F.col("anchor"), F.col("claim"))
    s = n.join(anchor, "day").groupBy("day", "anchor").agg((F.count_if(lab == "supports") - 1).alias("weight"), F.count_if(lab == "contradicts").alias("against"))
    certainty = F.when(F.col("anchor") == "confirmed_starter", "confirmed").otherwise("rumour")
    return s.select(F.col("day").cast("string").alias("day"), "anchor", "weight", "against", rules.grade(F.col("weight"), certainty, F.col("against") > 3).alias("grade"))


# facts


@query("""WITH a AS (SELECT l_orderkey, max(l_quantity) FILTER (l_linenumber = 1) AS q1, max(l_quantity) FILTER (l_linenumber = 2) AS q2 FROM lineitem GROUP BY 1)
  SELECT l_orderkey, CASE WHEN q1 > 10 THEN 'captain' WHEN q2 > 10 THEN 'vice' ELSE 'nobody' END AS credited, CASE WHEN q1 > 10 THEN 2 * q1 WHEN q2 > 10 THEN 2 * q2 ELSE 0.0 END AS points FROM a""")
def captain_credit(spark: SparkSession, sf: str) -> DataFrame:
    q = lambda n: F.max(F.when(F.col("l_linenumber") == n, F.col("l_quantity")))
    a = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(q(1).alias("q1"), q(2).alias("q2"))
    pick = lambda x, y, z: F.when(F.col("q1") > 10, x).when(F.col("q2") > 10, y).otherwise(z)
    return a.select("l_orderkey", pick(F.lit("captain"), F.lit("vice"), F.lit("nobody")).alias("credited"), pick(2 * F.col("q1"), 2 * F.col("q2"), F.lit(0.0)).alias("points"))


@query("""WITH g AS (SELECT c_nationkey, l_partkey, count(DISTINCT o_custkey) AS holders FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
  n AS (SELECT c_nationkey, count(*) AS members FROM customer GROUP BY 1)
  SELECT c_nationkey, l_partkey, holders, holders * 20 >= members AS template, holders <= 2 AS differential FROM g JOIN n USING (c_nationkey) WHERE holders * 20 >= members OR holders <= 1""")
def template_differential(spark: SparkSession, sf: str) -> DataFrame:
    j = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    g = j.groupBy("c_nationkey", "l_partkey").agg(F.count_distinct("o_custkey").alias("holders"))
    n = table(spark, sf, "customer").groupBy("c_nationkey").agg(F.count("*").alias("members"))
    return g.join(n, "c_nationkey").where("holders * 20 >= members or holders <= 1").selectExpr("c_nationkey", "l_partkey", "holders", "holders * 20 >= members as template", "holders <= 2 as differential")


@query("""WITH m AS (SELECT l_orderkey, min(l_quantity) AS low FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
  SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, low FROM lineitem JOIN m USING (l_orderkey) WHERE l_returnflag <> 'R' AND l_quantity = low - 1""")
def near_misses(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    low = li.where("l_returnflag = 'R'").groupBy("l_orderkey").agg(F.min("l_quantity").alias("low"))
    return li.where("l_returnflag <> 'R'").join(low, "l_orderkey").where("l_quantity = low - 1").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "low")


@query("""WITH c AS (SELECT c_custkey AS one, lead(c_custkey) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS two FROM customer),
  h AS (SELECT o_custkey, l_partkey, CAST(sum(l_quantity) AS BIGINT) AS q FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2),
  s AS (SELECT one, two, l_partkey, q FROM c JOIN h ON o_custkey = one WHERE two IS NOT NULL UNION ALL SELECT one, two, l_partkey, -q FROM c JOIN h ON o_custkey = two)
  SELECT one, two, l_partkey, CAST(sum(q) AS BIGINT) AS swing FROM s GROUP BY 1, 2, 3 HAVING sum(q) <> 0""")
def pair_swings(spark: SparkSession, sf: str) -> DataFrame:
    """What next members of a nation bought more or less of each part. Each shuffle deals rows to as many tasks as their number asks for."""
    li, o = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    n = tasks_for(li, o)
    lines = li.select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey", "l_quantity").repartition(n, "o_orderkey")
    bought = lines.join(o.select("o_orderkey", "o_custkey").repartition(n, "o_orderkey"), "o_orderkey").drop("o_orderkey").repartition(n, "o_custkey")
    h = bought.groupBy("o_custkey", "l_partkey").agg(F.sum("l_quantity").cast("bigint").alias("q"))
    two = F.lead("c_custkey").over(Window.partitionBy("c_nationkey").orderBy("c_custkey"))
    pairs = table(spark, sf, "customer").select(F.col("c_custkey").alias("one"), two.alias("two")).where("two is not null")
    sides = F.explode(F.array(F.struct(F.col("one").alias("o_custkey"), F.lit(1).alias("sign")), F.struct(F.col("two").alias("o_custkey"), F.lit(-1).alias("sign"))))
    each = pairs.withColumn("side", sides).select("one", "two", "side.*").repartition(n, "o_custkey").join(h, "o_custkey").repartition(2 * n, "one", "two")
    return each.groupBy("one", "two", "l_partkey").agg(F.sum(F.col("q") * F.col("sign")).cast("bigint").alias("swing")).where("swing <> 0")


# evaluation


@query("""WITH c AS (SELECT count(*) FILTER (quality = 1 AND n_chars > 800) AS tp, count(*) FILTER (quality = 0 AND n_chars > 800) AS fp, count(*) FILTER (quality = 1 AND n_chars <= 800) AS fn FROM labels JOIN documents USING (doc_id))
  SELECT *, tp::DOUBLE / (tp + fp) AS precision, tp::DOUBLE / (tp + fn) AS recall, 2.0::DOUBLE * tp / (2 * tp + fp + fn) AS f1 FROM c""")
def prf(spark: SparkSession, sf: str) -> DataFrame:
    j = table(spark, sf, "labels").join(table(spark, sf, "documents"), "doc_id")
    return evaluation.precision_recall(j, F.col("quality") == 1, F.col("n_chars") > 800)


@query("""WITH s AS (SELECT count(*) AS n, count(*) FILTER (quality = toxic) AS agree, avg(quality::DOUBLE) AS pa, avg(toxic::DOUBLE) AS pb FROM labels)
  SELECT n, agree, (agree::DOUBLE / n - (pa * pb + (1 - pa) * (1 - pb))) / (1 - (pa * pb + (1 - pa) * (1 - pb))) AS kappa FROM s""")
def kappa(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.cohen_kappa(table(spark, sf, "labels"), "quality", "toxic")


@query("""WITH r AS (SELECT q.vec_id AS q, e.vec_id AS item, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) DESC, e.vec_id DESC) AS place
    FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id % 100 = 0) q WHERE e.vec_id <> q.vec_id),
  rel AS (SELECT q.vec_id AS q, e.vec_id AS item FROM embeddings e JOIN embeddings q ON q.label = e.label AND q.vec_id % 100 = 0 AND e.vec_id <> q.vec_id)
  SELECT q, count(*) AS n_relevant, count(*) FILTER (place <= 20)::DOUBLE / count(*) AS recall, 1.0::DOUBLE / min(place) AS reciprocal_rank FROM rel JOIN r USING (q, item) GROUP BY 1""")
def recall_mrr(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    return vectors.recall(e, asked(e), "vec_id", "embedding", "label", 20)


@query("""WITH a AS (SELECT l_suppkey, l_returnflag, l_linestatus, count(*) AS na FROM lineitem WHERE l_linenumber % 2 = 0 GROUP BY ALL), b AS (SELECT l_suppkey, l_returnflag, l_linestatus, count(*) AS nb FROM lineitem WHERE l_linenumber % 2 = 1 GROUP BY ALL)
  SELECT l_suppkey, l_returnflag, l_linestatus, least(coalesce(na, 0), coalesce(nb, 0)) AS matched, greatest(coalesce(na, 0) - coalesce(nb, 0), 0) AS only_a, greatest(coalesce(nb, 0) - coalesce(na, 0), 0) AS only_b FROM a FULL JOIN b USING (l_suppkey, l_returnflag, l_linestatus)""")
def event_match(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    return evaluation.match_multisets(li.where("l_linenumber % 2 = 0"), li.where("l_linenumber % 2 = 1"), ["l_suppkey", "l_returnflag", "l_linestatus"])


@query("""WITH s AS (SELECT lang, count(*) AS size, count(*) FILTER (doc_id % 3 = 0) AS seen, count(*) FILTER (doc_id % 3 = 0 AND n_chars > 1500) AS hits FROM documents GROUP BY 1)
  SELECT CAST(sum(size) AS BIGINT) AS size, sum(size * hits::DOUBLE / seen) / sum(size) AS share FROM s WHERE seen > 0""")
def strata_weighted(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.weighted_estimate(table(spark, sf, "documents"), "lang", F.col("doc_id") % 3 == 0, F.col("n_chars") > 1500)


@query("SELECT doc_id, lang FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY md5(concat('seed', CAST(doc_id AS VARCHAR))), doc_id) <= 20")
def stratified_sample(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.stratified_sample(table(spark, sf, "documents").select("doc_id", "lang"), "lang", "doc_id", 20, "seed")


@query("SELECT event_id, user_id, strftime(time_bucket(INTERVAL 1 hour, ts), '%Y-%m-%d %H:%M:%S') AS hour FROM events WHERE event_type = 'error' AND ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2030-01-01'")
def half_open_window(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").where("event_type = 'error' and ts >= timestamp_ntz '2024-01-01' and ts < timestamp_ntz '2030-01-01'")
    return e.select("event_id", "user_id", F.date_format(F.date_trunc("hour", "ts"), "yyyy-MM-dd HH:mm:ss").alias("hour"))
