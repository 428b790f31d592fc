"""Queries of the evaluation reports. Labels stand for two judges, documents and events for cases, suppliers and parts for runs and items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import has_word
from ..sources.tables import table
from .posts import POSTS, events
from .registry import Registry

query = Registry()
QUERIES, ORACLE = query.queries, query.oracle

SIDES = f"{POSTS}, gold AS (SELECT author, k AS player, value FROM posts WHERE post_id % 2 = 0), found AS (SELECT author, k AS player, value FROM posts WHERE post_id % 2 = 1)"


@query(f"""WITH {SIDES}, g AS (SELECT author, player, count(*) AS n FROM gold GROUP BY 1, 2), f AS (SELECT author, player, count(*) AS m FROM found GROUP BY 1, 2),
  one AS (SELECT coalesce(g.author, f.author) AS author, coalesce(g.player, f.player) AS player, coalesce(n, 0) AS n, coalesce(m, 0) AS m FROM g FULL JOIN f ON g.author = f.author AND g.player = f.player),
  rest AS (SELECT author, player % 10 AS family, sum(greatest(n - m, 0)) AS n, sum(greatest(m - n, 0)) AS m, sum(least(n, m)) AS exact FROM one GROUP BY 1, 2)
  SELECT author, CAST(sum(exact) AS BIGINT) AS exact, CAST(sum(least(n, m)) AS BIGINT) AS similar, CAST(sum(greatest(n - m, 0)) AS BIGINT) AS missed, CAST(sum(greatest(m - n, 0)) AS BIGINT) AS extra FROM rest GROUP BY author""")
def link_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """One-to-one pairs in two rounds: equal players first, then players of one family; keys are classes, so counts say what a greedy choice finds."""
    e = events(spark, sf)
    one = e.groupBy("author", F.col("k").alias("player")).agg(F.count_if(F.col("post_id") % 2 == 0).alias("n"), F.count_if(F.col("post_id") % 2 == 1).alias("m"))
    more = lambda a, b: F.sum(F.greatest(F.col(a) - F.col(b), F.lit(0)))
    rest = one.groupBy("author", F.col("player") % 10).agg(F.sum(F.least("n", "m")).alias("exact"), more("n", "m").alias("n"), more("m", "n").alias("m"))
    return rest.groupBy("author").agg(F.sum("exact").alias("exact"), F.sum(F.least("n", "m")).alias("similar"), more("n", "m").alias("missed"), more("m", "n").alias("extra"))


@query("""WITH entries AS (SELECT doc_id, doc_id % 3 AS ordinal, quality AS label, doc_id % 5 = 0 AS reviewed FROM labels UNION ALL SELECT doc_id, 3, toxic, doc_id % 7 = 0 FROM labels),
  last AS (SELECT doc_id, max_by(label, ordinal) FILTER (reviewed) AS owner, max_by(label, ordinal) FILTER (NOT reviewed) AS judge FROM entries GROUP BY 1)
  SELECT doc_id, coalesce(owner, judge) AS label, CASE WHEN owner IS NOT NULL THEN 'owner' ELSE 'judge' END AS origin FROM last""")
def reference_labels(spark: SparkSession, sf: str) -> DataFrame:
    """A reviewed label wins over the judge's; of several the last entry."""
    lab = table(spark, sf, "labels")
    e = lab.select("doc_id", (F.col("doc_id") % 3).alias("ordinal"), F.col("quality").alias("label"), (F.col("doc_id") % 5 == 0).alias("reviewed")).union(lab.select("doc_id", F.lit(3).cast("bigint"), "toxic", F.col("doc_id") % 7 == 0))
    last = e.groupBy("doc_id").agg(F.max_by("label", F.when(F.col("reviewed"), F.col("ordinal"))).alias("owner"), F.max_by("label", F.when(~F.col("reviewed"), F.col("ordinal"))).alias("judge"), F.bool_or("reviewed").alias("any_owner"))
    return last.select("doc_id", F.when(F.col("any_owner"), F.col("owner")).otherwise(F.col("judge")).alias("label"), F.when(F.col("any_owner"), "owner").otherwise("judge").alias("origin"))


@query("""WITH item AS (SELECT l_suppkey AS run, l_orderkey AS item, avg(CASE WHEN l_returnflag <> 'R' THEN 1.0 ELSE 0.0 END) AS faithful, avg(l_quantity) AS style, count(*) AS claims FROM lineitem GROUP BY 1, 2),
  total AS (SELECT run, count(*) AS items, CAST(sum(claims) AS BIGINT) AS claims, round(avg(faithful), 6) AS faithfulness, round(avg(style), 6) AS style FROM item GROUP BY 1)
  SELECT *, faithfulness >= 0.66 - 1e-9 AS passes FROM total""")
def faithfulness(spark: SparkSession, sf: str) -> DataFrame:
    """Means of the items' means for each run, and whether the run passes."""
    li = table(spark, sf, "lineitem")
    item = li.groupBy(F.col("l_suppkey").alias("run"), "l_orderkey").agg(F.avg(F.when(F.col("l_returnflag") != "R", 1.0).otherwise(0.0)).alias("faithful"), F.avg("l_quantity").alias("style"), F.count("*").alias("claims"))
    total = item.groupBy("run").agg(F.count("*").alias("items"), F.sum("claims").alias("claims"), F.round(F.avg("faithful"), 6).alias("faithfulness"), F.round(F.avg("style"), 6).alias("style"))
    return total.withColumn("passes", F.col("faithfulness") >= 0.66 - 1e-9)


@query("""WITH c AS (SELECT lang, count(*) AS n, count(*) FILTER (n_chars < 100) AS short, count(DISTINCT source) AS sources FROM documents WHERE lang IS NOT NULL GROUP BY 1), bounds AS (SELECT 'enough cases' AS rule, 100 AS least UNION ALL SELECT 'some short ones', 1 UNION ALL SELECT 'many sources', 15)
  SELECT lang, rule, CASE rule WHEN 'enough cases' THEN n WHEN 'some short ones' THEN short ELSE sources END AS found, CAST(least AS BIGINT) AS least FROM c, bounds WHERE CASE rule WHEN 'enough cases' THEN n WHEN 'some short ones' THEN short ELSE sources END < least""")
def composition_problems(spark: SparkSession, sf: str) -> DataFrame:
    """Rules on what a set must hold, and where it falls short."""
    c = table(spark, sf, "documents").where("lang is not null").groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("n_chars") < 100).alias("short"), F.count_distinct("source").alias("sources"))
    rule = lambda name, column, least: F.struct(F.lit(name).alias("rule"), F.col(column).alias("found"), F.lit(least).cast("bigint").alias("least"))
    return c.select("lang", F.explode(F.array(rule("enough cases", "n", 100), rule("some short ones", "short", 1), rule("many sources", "sources", 15))).alias("r")).select("lang", "r.*").where("found < least")


@query("""SELECT l.quality, l.toxic, count(*) AS n, count(*) FILTER (l.quality = l.toxic) AS agreed, string_agg(CASE WHEN l.quality <> l.toxic AND d.n_chars > 6000 THEN CAST(l.doc_id AS VARCHAR) END, ',' ORDER BY CAST(l.doc_id AS VARCHAR)) AS disputed
  FROM labels l JOIN documents d USING (doc_id) GROUP BY 1, 2""")
def judge_agreement(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of verdicts, how many agree, and the long texts that two judges dispute."""
    j = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id")
    disputed = F.collect_list(F.when((F.col("quality") != F.col("toxic")) & (F.col("n_chars") > 6000), F.col("doc_id").cast("string")))
    text = F.array_join(F.sort_array(disputed), ",")
    return j.groupBy("quality", "toxic").agg(F.count("*").alias("n"), F.count_if(F.col("quality") == F.col("toxic")).alias("agreed"), F.when(F.size(disputed) > 0, text).alias("disputed"))


@query(f"""WITH {POSTS}, pairs AS (SELECT k AS player, kind AS type, min(post_id) AS first FROM posts GROUP BY 1, 2) SELECT player, type, first, 'is player ' || player || ' ' || type || '?' AS text FROM pairs""")
def query_templates(spark: SparkSession, sf: str) -> DataFrame:
    """A question for the first event of each player and type."""
    p = events(spark, sf).groupBy(F.col("k").alias("player"), F.col("kind").alias("type")).agg(F.min("post_id").alias("first"))
    return p.withColumn("text", F.format_string("is player %d %s?", "player", "type"))


VERDICTS = f"{POSTS}, old AS (SELECT author % 10 AS input, k AS item, max(kind) AS verdict FROM posts WHERE post_id % 3 = 0 GROUP BY 1, 2), new AS (SELECT author % 10 AS input, k AS item, max(kind) AS verdict FROM posts WHERE post_id % 3 = 1 GROUP BY 1, 2)"


@query(f"""WITH {VERDICTS}, merged AS (SELECT coalesce(o.input, n.input) AS input, coalesce(o.item, n.item) AS item, CASE WHEN n.item IS NULL THEN 'missing' WHEN o.item IS NULL THEN 'added' WHEN o.verdict = n.verdict THEN 'unchanged' WHEN n.item % 4 = 0 THEN 'replaced' ELSE 'conflict' END AS state
  FROM old o FULL JOIN new n ON o.input = n.input AND o.item = n.item) SELECT input, count(*) FILTER (state = 'unchanged') AS unchanged, count(*) FILTER (state = 'added') AS added, count(*) FILTER (state = 'replaced') AS replaced, count(*) FILTER (state = 'conflict') AS conflicts,
  bool_and(state NOT IN ('conflict', 'missing')) AS accepted FROM merged GROUP BY input""")
def verdict_import(spark: SparkSession, sf: str) -> DataFrame:
    """New verdicts against those there: a conflict or a missing item rejects the whole input."""
    e = events(spark, sf).where("post_id % 3 < 2").groupBy((F.col("author") % 10).alias("input"), F.col("k").alias("item"))
    side = lambda r: F.max(F.when(F.col("post_id") % 3 == r, F.col("kind")))
    b = e.agg(side(0).alias("old"), side(1).alias("new"))
    state = F.when(F.col("new").isNull(), "missing").when(F.col("old").isNull(), "added").when(F.col("old") == F.col("new"), "unchanged").when(F.col("item") % 4 == 0, "replaced").otherwise("conflict")
    n = lambda s: F.count_if(F.col("state") == s)
    return b.withColumn("state", state).groupBy("input").agg(n("unchanged").alias("unchanged"), n("added").alias("added"), n("replaced").alias("replaced"), n("conflict").alias("conflicts"), F.bool_and(~F.col("state").isin("conflict", "missing")).alias("accepted"))


@query("""SELECT doc_id, source, regexp_matches(text, '(?i)\\b(with|that)\\b') AS keyword FROM documents d WHERE source NOT IN ('src1', 'src2') AND (EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND quality = 1) OR regexp_matches(text, '(?i)\\b(with|that)\\b') OR substr(md5('seed' || doc_id), 1, 1) IN ('0', '1'))""")
def corpus_prefilter(spark: SparkSession, sf: str) -> DataFrame:
    """A corpus without excluded sources: required ids, keyword matches, and of the rest a share by a seeded digest."""
    d = table(spark, sf, "documents").where("source not in ('src1', 'src2')").withColumn("keyword", has_word(F.col("text"), "with|that"))
    need = table(spark, sf, "labels").where("quality = 1").select("doc_id").distinct().withColumn("required", F.lit(True))
    digest = F.substring(F.md5(F.concat(F.lit("seed"), F.col("doc_id").cast("string"))), 1, 1)
    return d.join(need, "doc_id", "left").where(F.coalesce("required", F.lit(False)) | F.coalesce("keyword", F.lit(False)) | digest.isin("0", "1")).select("doc_id", "source", "keyword")


POOL = f"""{POSTS}, modes AS (SELECT author, k, 1 AS mode, row_number() OVER (PARTITION BY author ORDER BY count(*) DESC, k) AS place FROM posts GROUP BY 1, 2 UNION ALL SELECT author, k, 2, row_number() OVER (PARTITION BY author ORDER BY max(value) DESC, k) FROM posts GROUP BY 1, 2
  UNION ALL SELECT author, k, 3, row_number() OVER (PARTITION BY author ORDER BY max(created) DESC, k) FROM posts GROUP BY 1, 2), pooled AS (SELECT author, k, min(mode * 1000 + place) AS first FROM modes WHERE place <= 10 GROUP BY 1, 2)"""


def _modes(spark: SparkSession, sf: str) -> DataFrame:
    per = events(spark, sf).groupBy("author", "k").agg(F.count("*").alias("n"), F.max("value").alias("value"), F.max("created").alias("created"))
    place = lambda c: F.row_number().over(Window.partitionBy("author").orderBy(F.desc(c), "k"))
    legs = per.select("author", "k", F.array(*[F.struct(F.lit(m).alias("mode"), place(c).alias("place")) for m, c in ((1, "n"), (2, "value"), (3, "created"))]).alias("legs"))
    return legs.select("author", "k", F.inline("legs"))


@query(f"WITH {POOL} SELECT author, k, row_number() OVER (PARTITION BY author ORDER BY first) AS place FROM pooled")
def simple_pool(spark: SparkSession, sf: str) -> DataFrame:
    """The ten best of three modes in order, each item where it comes first."""
    pooled = _modes(spark, sf).where("place <= 10").groupBy("author", "k").agg(F.min(F.col("mode") * 1000 + F.col("place")).alias("first"))
    return pooled.select("author", "k", F.row_number().over(Window.partitionBy("author").orderBy("first")).cast("bigint").alias("place"))


@query(f"""WITH {POOL}, depths AS (SELECT unnest([5, 10, 20]) AS depth), relevant AS (SELECT DISTINCT author, k FROM posts WHERE kind = 'purchase'), all_of AS (SELECT author, count(*) AS n FROM relevant GROUP BY 1),
  hits AS (SELECT m.author, mode, depth, count(*) FILTER (r.k IS NOT NULL) AS hits FROM modes m JOIN depths ON m.place <= depth LEFT JOIN relevant r ON r.author = m.author AND r.k = m.k GROUP BY 1, 2, 3)
  SELECT CAST(mode AS BIGINT) AS mode, CAST(depth AS BIGINT) AS depth, count(*) AS queries, round(avg(hits / n), 6) AS recall FROM hits JOIN all_of USING (author) GROUP BY 1, 2""")
def configuration_sweep(spark: SparkSession, sf: str) -> DataFrame:
    """Recall of every mode at every depth. Items are ranked once for the largest depth; a depth is a filter on places."""
    purchases = events(spark, sf).where("kind = 'purchase'").select("author", "k").distinct().withColumn("hit", F.lit(1))
    n = purchases.groupBy("author").agg(F.count("*").alias("n"))
    ranked = _modes(spark, sf).where("place <= 20").join(purchases, ["author", "k"], "left")
    per = ranked.select("author", "mode", "place", "hit", F.explode(F.array(F.lit(5), F.lit(10), F.lit(20))).alias("depth")).where("place <= depth").groupBy("author", "mode", "depth").agg(F.count("hit").alias("hits"))
    return per.join(n, "author").groupBy(F.col("mode").cast("bigint").alias("mode"), F.col("depth").cast("bigint").alias("depth")).agg(F.count("*").alias("queries"), F.round(F.avg(F.col("hits") / F.col("n")), 6).alias("recall"))


@query("""WITH x AS (SELECT doc_id, quality <> toxic AS disputed, doc_id % 6 = 0 AS reviewed, row_number() OVER (PARTITION BY quality, toxic ORDER BY md5('seed' || doc_id), doc_id) AS n FROM labels)
  SELECT doc_id, CASE WHEN disputed THEN 'disputed' ELSE 'sample' END AS reason FROM x WHERE NOT reviewed AND (disputed OR n <= 20)""")
def review_queue(spark: SparkSession, sf: str) -> DataFrame:
    """What is to be reviewed: disputed items, and a sample that is drawn before the reviewed ones go."""
    n = F.row_number().over(Window.partitionBy("quality", "toxic").orderBy(F.md5(F.concat(F.lit("seed"), F.col("doc_id").cast("string"))), "doc_id"))
    x = table(spark, sf, "labels").withColumn("n", n).withColumn("disputed", F.col("quality") != F.col("toxic"))
    return x.where((F.col("doc_id") % 6 != 0) & (F.col("disputed") | (F.col("n") <= 20))).select("doc_id", F.when(F.col("disputed"), "disputed").otherwise("sample").alias("reason"))


@query("""SELECT d.doc_id, coalesce(l.toxic, 0) = 1 AND NOT EXISTS (SELECT 1 FROM embeddings e WHERE e.vec_id = d.doc_id AND e.label = 0) AS known_miss FROM documents d LEFT JOIN labels l USING (doc_id)""")
def known_miss(spark: SparkSession, sf: str) -> DataFrame:
    """Cases with a label that nothing was extracted for."""
    e = table(spark, sf, "embeddings").where("label = 0").select(F.col("vec_id").alias("doc_id"), F.lit(True).alias("extracted"))
    d = table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left").join(e, "doc_id", "left")
    return d.select("doc_id", ((F.coalesce("toxic", F.lit(0)) == 1) & F.col("extracted").isNull()).alias("known_miss"))


@query("""WITH r AS (SELECT l_suppkey AS run, l_returnflag AS split, l_linestatus AS header, count(*) AS n FROM lineitem GROUP BY 1, 2, 3) SELECT run, CAST(sum(n) FILTER (split = 'A') AS BIGINT) AS test_cases, count(DISTINCT header) FILTER (split = 'A') AS headers FROM r GROUP BY run""")
def result_files(spark: SparkSession, sf: str) -> DataFrame:
    """The test split of each run, and whether all its rows have one header."""
    test = F.col("l_returnflag") == "A"
    return table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("run")).agg(F.sum(F.when(test, 1)).alias("test_cases"), F.count_distinct(F.when(test, F.col("l_linestatus"))).alias("headers"))
