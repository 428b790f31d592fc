"""Queries on posts, extractions and retrieval. Events stand for posts: users are authors, the number in props names players, four events in a row are runs on one post."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import has_word
from ..operators import latest, places
from ..operators import posts as ops
from ..sources.tables import table
from .registry import Registry

query = Registry()
QUERIES, ORACLE = query.queries, query.oracle

POSTS = "posts AS (SELECT event_id AS post_id, user_id AS author, ts AS created, event_type AS kind, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, value FROM events)"
RUNS = f"{POSTS}, runs AS (SELECT post_id // 4 AS post, post_id AS run, created, kind <> 'error' AS ok, author, k FROM posts), said AS (SELECT post, run, CAST(p AS BIGINT) AS player FROM (SELECT post, run, unnest([k % 20, (k + 7) % 20]) AS p FROM runs))"


def events(spark: SparkSession, sf: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("bigint")
    return table(spark, sf, "events").select(F.col("event_id").alias("post_id"), F.col("user_id").alias("author"), F.col("ts").alias("created"), F.col("event_type").alias("kind"), k.alias("k"), "value")


def runs(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf).select(F.expr("post_id div 4").alias("post"), F.col("post_id").alias("run"), "created", (F.col("kind") != "error").alias("ok"), "author", "k")


def said(r: DataFrame) -> DataFrame:
    return r.select("post", "run", F.explode(F.array(F.col("k") % 20, (F.col("k") + 7) % 20)).alias("player"))


def _current(spark: SparkSession, sf: str) -> DataFrame:
    day = lambda d: F.lit(d).cast("timestamp_ntz")
    return ops.current(runs(spark, sf), "post", ["created", "run"], "ok", day("2024-01-05"), day("2024-01-25"), "created")


CURRENT = f"{RUNS}, newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY post ORDER BY created DESC, run DESC) AS n FROM runs WHERE ok AND created >= TIMESTAMP '2024-01-05' AND created < TIMESTAMP '2024-01-25') WHERE n = 1)"


@query(f"""WITH {CURRENT} SELECT c.post, c.run, c.author, coalesce((SELECT string_agg(DISTINCT CAST(s.player AS VARCHAR), ',' ORDER BY CAST(s.player AS VARCHAR)) FROM said s WHERE s.run = c.run AND s.player <> 10), '') AS items
  FROM newest c WHERE c.author % 3 <> 0 AND EXISTS (SELECT 1 FROM said s WHERE s.run = c.run AND s.player IN (3, 10))""")
def current_extraction(spark: SparkSession, sf: str) -> DataFrame:
    """The newest successful run of each post in a window, then the filters by author and player; of its events those that survive, in a list that may be empty."""
    c = _current(spark, sf)
    own = said(c)
    named = c.where("author % 3 <> 0").join(own.where("player in (3, 10)").select("run"), "run", "left_semi")
    return ops.with_survivors(named, own.where("player <> 10").select("run", F.col("player").cast("string").alias("player")), "run", "player").select("post", "run", "author", "items")


@query(f"""WITH {RUNS} SELECT post, min(created) FILTER (ok) AS first_success, count(*) FILTER (NOT ok) AS failures FROM runs GROUP BY post HAVING count(*) FILTER (ok) > 0""")
def first_extractions(spark: SparkSession, sf: str) -> DataFrame:
    return runs(spark, sf).groupBy("post").agg(F.min(F.when(F.col("ok"), F.col("created"))).alias("first_success"), F.count_if(~F.col("ok")).alias("failures")).where("first_success is not null")


@query(f"""WITH {RUNS}, first AS (SELECT post, min(created) AS first_success FROM runs WHERE ok GROUP BY post) SELECT r.run, r.post, f.first_success,
  date_diff('microsecond', r.created, f.first_success) / 1e6 AS seconds FROM runs r LEFT JOIN first f ON r.post = f.post""")
def first_success_of(spark: SparkSession, sf: str) -> DataFrame:
    """For each run the first success of its post (a correlated minimum), and the seconds to it."""
    r = runs(spark, sf)
    first = r.where("ok").groupBy("post").agg(F.min("created").alias("first_success"))
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return r.join(first, "post", "left").select("run", "post", "first_success", ((micros("first_success") - micros("created")) / 1e6).alias("seconds"))


@query(f"""WITH {POSTS}, list AS (SELECT CASE WHEN count(*) = 0 THEN NULL ELSE list(DISTINCT author) END AS members FROM posts WHERE created >= (SELECT max(date_trunc('day', created)) FROM posts))
  SELECT post_id, author FROM posts, list WHERE members IS NULL OR list_contains(members, author)""")
def member_posts(spark: SparkSession, sf: str) -> DataFrame:
    """Posts by authors of the newest membership list; without a list, all posts."""
    p = events(spark, sf)
    day = p.agg(F.max(F.date_trunc("day", "created")).alias("day"))
    members = p.join(F.broadcast(day), F.col("created") >= F.col("day")).select("author").distinct()
    return p.join(members, "author", "left_semi").select("post_id", "author")


@query(f"""WITH {POSTS}, listed AS (SELECT *, author % 7 < 3 AS on_list FROM posts) SELECT p.post_id, p.on_list OR EXISTS (SELECT 1 FROM listed q WHERE q.on_list AND q.k * 10 + q.author % 10 = p.post_id) AS is_source FROM listed p""")
def source_posts(spark: SparkSession, sf: str) -> DataFrame:
    """Whether a post is on the list or quoted by one that is (the quoted id is made of the post's number and author)."""
    p = events(spark, sf).withColumn("on_list", F.col("author") % 7 < 3)
    quoted = p.where("on_list").select((F.col("k") * 10 + F.col("author") % 10).alias("post_id")).distinct().withColumn("quoted", F.lit(True))
    return p.join(quoted, "post_id", "left").select("post_id", (F.col("on_list") | F.coalesce("quoted", F.lit(False))).alias("is_source"))


KEPT = f"""{POSTS}, next AS (SELECT *, (SELECT min(q.created) FROM posts q WHERE q.author = p.author AND q.kind = 'purchase' AND q.created > p.created) AS next_start FROM posts p),
  flagged AS (SELECT *, kind = 'view' AS is_lineup, CASE k % 3 WHEN 0 THEN NULL WHEN 1 THEN true ELSE false END AS answer, kind = 'view' AND coalesce(next_start - created > INTERVAL 60 HOUR, false) AS is_stale FROM next),
  kept AS (SELECT *, CASE WHEN NOT is_lineup THEN true WHEN answer = false THEN false ELSE NOT is_stale END AS kept FROM flagged)"""


def _kept(spark: SparkSession, sf: str) -> DataFrame:
    p = events(spark, sf)
    p = p.withColumn("next_start", ops.next_of(["author"], "created", F.col("kind") == "purchase"))
    p = p.withColumn("is_lineup", F.col("kind") == "view").withColumn("answer", F.when(F.col("k") % 3 == 1, True).when(F.col("k") % 3 == 2, False))
    p = p.withColumn("is_stale", ops.stale(F.col("is_lineup"), F.col("created"), F.col("next_start")))
    return p.withColumn("kept", ops.kept_at_read(F.col("is_lineup"), F.col("answer"), F.col("is_stale")))


@query(f"WITH {KEPT} SELECT post_id, next_start, is_stale, kept FROM kept")
def kept_at_read(spark: SparkSession, sf: str) -> DataFrame:
    """Line-ups long before the next start are stale; what stays at read."""
    return _kept(spark, sf).select("post_id", "next_start", "is_stale", "kept")


@query(f"WITH {KEPT} SELECT kind, count(*) AS n, count(*) FILTER (kept) AS n_kept, count(*) FILTER (NOT is_stale) AS n_without_answer FROM kept GROUP BY kind")
def raw_and_kept(spark: SparkSession, sf: str) -> DataFrame:
    """Predictions raw, kept, and kept without the match answer."""
    return _kept(spark, sf).groupBy("kind").agg(F.count("*").alias("n"), F.count_if("kept").alias("n_kept"), F.count_if(~F.col("is_stale")).alias("n_without_answer"))


@query(f"""WITH {POSTS} SELECT post_id, CASE WHEN created > TIMESTAMP '2024-01-15' THEN 'new' ELSE 'context' END AS freshness FROM posts""")
def freshness(spark: SparkSession, sf: str) -> DataFrame:
    """Strictly after the moment is new, at it is context."""
    return events(spark, sf).select("post_id", F.when(F.col("created") > F.lit("2024-01-15").cast("timestamp_ntz"), "new").otherwise("context").alias("freshness"))


@query(f"""WITH {POSTS} SELECT EXISTS (SELECT 1 FROM posts WHERE created >= m) AS since, EXISTS (SELECT 1 FROM posts WHERE created > m) AS strictly_after, EXISTS (SELECT 1 FROM posts WHERE kind = 'refund') AS has_kind
  FROM (SELECT max(created) AS m FROM posts)""")
def fetch_gates(spark: SparkSession, sf: str) -> DataFrame:
    """Cheap gates before a scan: is there anything since the newest moment, strictly after it, of a kind."""
    p = events(spark, sf)
    newest = p.agg(F.max("created").alias("m"))
    return p.join(F.broadcast(newest), F.lit(True)).agg(F.coalesce(F.bool_or(F.col("created") >= F.col("m")), F.lit(False)).alias("since"), F.coalesce(F.bool_or(F.col("created") > F.col("m")), F.lit(False)).alias("strictly_after"), F.coalesce(F.bool_or(F.col("kind") == "refund"), F.lit(False)).alias("has_kind"))


@query("""SELECT conv_id, turn, regexp_matches(text, '(?i)\\b(with|for|that)\\b') AS lineup, regexp_matches(text, '(?i)\\b(de|la|les)\\b') AS availability, starts_with(lower(text), 'is ') AS prefixed FROM conversations""")
def keyword_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Word classes by case-insensitive expressions, and a prefix. Letters, edges of words and case are those of the SQL: edges know ASCII alone, a long s is an s, a dotted capital I is an i."""
    text = F.col("text")
    return table(spark, sf, "conversations").select("conv_id", "turn", has_word(text, "with|for|that").alias("lineup"), has_word(text, "de|la|les").alias("availability"), text.rlike("^[iI\u0130][sS] ").alias("prefixed"))


@query(f"""WITH {POSTS}, deadlines AS (SELECT DISTINCT date_trunc('week', created) + INTERVAL 90 HOUR AS d FROM posts) SELECT post_id, (SELECT min(d) FROM deadlines WHERE d > created) AS next_deadline, (SELECT max(d) FROM deadlines WHERE d <= created) AS last_deadline FROM posts""")
def deadline_as_of(spark: SparkSession, sf: str) -> DataFrame:
    """The next deadline strictly after each post, and the latest at or before it. Deadlines are weeks: one short sorted array."""
    p = events(spark, sf)
    weeks = p.select((F.date_trunc("week", "created").cast("timestamp_ntz") + F.expr("interval 90 hours")).alias("d")).distinct().agg(F.sort_array(F.collect_list("d")).alias("deadlines"))
    return p.join(F.broadcast(weeks), F.lit(True)).select("post_id", F.array_min(F.filter("deadlines", lambda d: d > F.col("created"))).alias("next_deadline"), F.array_max(F.filter("deadlines", lambda d: d <= F.col("created"))).alias("last_deadline"))


@query("""SELECT (SELECT count(*) FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)) AS only_first, (SELECT count(*) FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents)) AS only_second,
  (SELECT count(*) FROM (SELECT doc_id FROM labels INTERSECT SELECT doc_id FROM documents)) AS both""")
def set_equality(spark: SparkSession, sf: str) -> DataFrame:
    """Symmetric difference of two id sets, by one aggregation."""
    a = table(spark, sf, "documents").select("doc_id", F.lit(1).alias("side"))
    b = table(spark, sf, "labels").select("doc_id", F.lit(2).alias("side"))
    per = a.union(b).groupBy("doc_id").agg(F.bit_or("side").alias("sides"))
    return per.agg(*[F.count_if(F.col("sides") == k).alias(n) for k, n in ((1, "only_first"), (2, "only_second"), (3, "both"))])


@query(f"""WITH {POSTS}, sets AS (SELECT author, CAST(date_trunc('day', created) AS TIMESTAMP) AS day, list(DISTINCT k) AS ks FROM posts GROUP BY 1, 2), pairs AS (SELECT *, lag(ks) OVER (PARTITION BY author ORDER BY day) AS before FROM sets)
  SELECT author, day, coalesce(list_has_any(ks, before), false) AS overlaps FROM pairs""")
def origins_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """Whether an author's day shares an origin with the author's day before."""
    sets = events(spark, sf).groupBy("author", F.date_trunc("day", "created").cast("timestamp_ntz").alias("day")).agg(F.collect_set("k").alias("ks"))
    before = F.lag("ks").over(Window.partitionBy("author").orderBy("day"))
    return sets.withColumn("before", before).select("author", "day", F.coalesce(F.arrays_overlap("ks", "before"), F.lit(False)).alias("overlaps"))


@query(f"""WITH {POSTS}, tries AS (SELECT post_id // 4 AS post, count(*) AS attempts, bool_and(kind = 'error') AS failed, max(created) AS last_at FROM posts GROUP BY 1)
  SELECT post, attempts, last_at FROM tries WHERE failed AND attempts < 5 AND last_at <= TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 10 MINUTE""")
def retry_queue(spark: SparkSession, sf: str) -> DataFrame:
    """Posts whose tries all failed, fewer than five, the last one ten minutes ago or more."""
    t = events(spark, sf).groupBy(F.expr("post_id div 4").alias("post")).agg(F.count("*").alias("attempts"), F.bool_and(F.col("kind") == "error").alias("failed"), F.max("created").alias("last_at"))
    return t.where("failed and attempts < 5 and last_at <= timestamp_ntz'2024-01-30 12:00:00' - interval 10 minutes").select("post", "attempts", "last_at")


INDEX = "tried AS (SELECT vec_id, CASE label % 4 WHEN 0 THEN NULL WHEN 1 THEN 'failed' ELSE 'embedded' END AS status FROM embeddings)"


def _tried(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", F.when(F.col("label") % 4 == 1, "failed").when(F.col("label") % 4 > 1, "embedded").alias("status"))


@query(f"""WITH {INDEX} SELECT doc_id, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) AS BIGINT) AS place FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM tried WHERE status = 'embedded')""")
def index_missing(spark: SparkSession, sf: str) -> DataFrame:
    """Documents never embedded or not with success, numbered in the order of their source's queue."""
    todo = table(spark, sf, "documents").select("doc_id", "source").join(_tried(spark, sf).where("status = 'embedded'").select(F.col("vec_id").alias("doc_id")), "doc_id", "left_anti")
    return places.row_places(todo, ["source"], [F.col("doc_id")], "place").select("doc_id", "place")


@query(f"""WITH {INDEX} SELECT count(*) FILTER (status = 'embedded') AS embedded, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status IS NULL) AS missing, CAST(sum(ceil(n_chars / 4.0)) AS BIGINT) AS tokens,
  CAST(sum(ceil(n_chars / 4.0)) AS BIGINT) / 1e6 * 0.13 AS cost, max(doc_id) AS latest FROM documents LEFT JOIN tried ON doc_id = vec_id""")
def embedding_status(spark: SparkSession, sf: str) -> DataFrame:
    """Embedded, failed and missing documents, and an estimate of tokens (four characters each) and of their price."""
    d = table(spark, sf, "documents").join(_tried(spark, sf), F.col("doc_id") == F.col("vec_id"), "left")
    tokens = F.sum(F.ceil(F.col("n_chars") / 4.0)).cast("bigint")
    return d.agg(F.count_if(F.col("status") == "embedded").alias("embedded"), F.count_if(F.col("status") == "failed").alias("failed"), F.count_if(F.col("status").isNull()).alias("missing"), tokens.alias("tokens"), F.max("doc_id").alias("latest")).withColumn("cost", F.col("tokens") / 1e6 * F.lit(0.13))


LOOKUP = "keys AS (SELECT p_partkey, 0 AS tier, p_name AS key FROM part UNION ALL SELECT p_partkey, 1, split_part(p_name, ' ', 2) FROM part UNION ALL SELECT p_partkey, 2, split_part(p_name, ' ', 1) FROM part)"


@query(f"""WITH {LOOKUP}, asked AS (SELECT DISTINCT CASE WHEN turn % 2 = 0 THEN CAST(conv_id AS VARCHAR) ELSE split_part(lower(text), ' ', 1) END AS said FROM conversations UNION SELECT DISTINCT split_part(p_name, ' ', 2) FROM part)
  SELECT said, count(DISTINCT id) AS n, min(id) AS first_id FROM (SELECT said, p_partkey AS id FROM asked JOIN part ON regexp_full_match(said, '[0-9]+') AND TRY_CAST(said AS BIGINT) = p_partkey UNION ALL
  SELECT said, p_partkey FROM asked JOIN keys ON NOT regexp_full_match(said, '[0-9]+') AND said = key) GROUP BY said""")
def player_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Digits are an id; anything else is looked up as a name in every tier of keys."""
    part = table(spark, sf, "part").select("p_partkey", "p_name")
    words = F.split("p_name", " ")
    keys = part.select("p_partkey", F.explode(F.array(F.col("p_name"), F.coalesce(F.try_element_at(words, F.lit(2)), F.lit("")), words[0])).alias("key"))
    c = table(spark, sf, "conversations")
    asked = c.select(F.when(F.col("turn") % 2 == 0, F.col("conv_id").cast("string")).otherwise(F.split(F.lower("text"), " ")[0]).alias("said")).union(part.select(F.coalesce(F.try_element_at(words, F.lit(2)), F.lit("")))).distinct()
    digits = F.col("said").rlike("^[0-9]+$")
    by_id = asked.where(digits).join(part, F.col("said").try_cast("bigint") == F.col("p_partkey")).select("said", F.col("p_partkey").alias("id"))
    by_name = asked.where(~digits).join(keys, F.col("said") == F.col("key")).select("said", F.col("p_partkey").alias("id"))
    return by_id.union(by_name).groupBy("said").agg(F.count_distinct("id").alias("n"), F.min("id").alias("first_id"))


@query(f"""WITH {POSTS}, claimed AS (SELECT DISTINCT author, k FROM posts WHERE kind = 'purchase'), found AS (SELECT author, k, count(*) AS hits, min(post_id) AS first FROM posts WHERE kind = 'view' GROUP BY 1, 2),
  left_over AS (SELECT f.*, row_number() OVER (PARTITION BY author ORDER BY hits DESC, first) AS place FROM found f WHERE NOT EXISTS (SELECT 1 FROM claimed c WHERE c.author = f.author AND c.k = f.k))
  SELECT author, k, hits, CAST(place AS BIGINT) AS place FROM left_over WHERE place <= 10""")
def retrieval_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """What search finds without what is claimed already, the ten best of each author."""
    p = events(spark, sf)
    found = p.where("kind = 'view'").groupBy("author", "k").agg(F.count("*").alias("hits"), F.min("post_id").alias("first"))
    rest = found.join(p.where("kind = 'purchase'").select("author", "k"), ["author", "k"], "left_anti")
    place = F.row_number().over(Window.partitionBy("author").orderBy(F.desc("hits"), "first"))
    return rest.withColumn("place", place.cast("bigint")).where("place <= 10").select("author", "k", "hits", "place")


@query("""WITH t AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) SELECT conv_id, max(text) FILTER (n = 2) AS previous, max(text) FILTER (n = 3) AS before_that FROM t GROUP BY conv_id""")
def previous_texts(spark: SparkSession, sf: str) -> DataFrame:
    """The last two texts before the newest of each conversation."""
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    t = table(spark, sf, "conversations").withColumn("n", n).where("n <= 3")
    return t.groupBy("conv_id").agg(F.max(F.when(F.col("n") == 2, F.col("text"))).alias("previous"), F.max(F.when(F.col("n") == 3, F.col("text"))).alias("before_that"))


@query("""SELECT p_partkey, p_name, regexp_replace(p_name, '^[a-z]', upper(p_name[1])) AS capital, p_name[1] || '. ' || split_part(p_name, ' ', 2) AS initialled, split_part(p_name, ' ', 2) AS surname FROM part""")
def name_variants(spark: SparkSession, sf: str) -> DataFrame:
    """A name as written, with an initial, and the surname."""
    second = F.coalesce(F.try_element_at(F.split("p_name", " "), F.lit(2)), F.lit(""))
    first = F.substring("p_name", 1, 1)
    return table(spark, sf, "part").select("p_partkey", "p_name", F.regexp_replace("p_name", "^[a-z]", F.upper(first)).alias("capital"), F.concat(first, F.lit(". "), second).alias("initialled"), second.alias("surname"))


@query("""WITH a AS (SELECT c_custkey, c_mktsegment, c_nationkey, count(*) OVER (PARTITION BY c_nationkey, c_mktsegment) AS same, row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey) AS n FROM customer)
  SELECT c_custkey, CASE WHEN same = 1 THEN lower(c_mktsegment) WHEN n = 1 THEN lower(c_mktsegment) || ' ' || c_mktsegment[1] ELSE lower(c_mktsegment) || ' ' || c_mktsegment[1] || n END AS display FROM a""")
def display_names(spark: SparkSession, sf: str) -> DataFrame:
    """Names inside a group: alone if unique, else with an initial, the later ones with a number."""
    g = ["c_nationkey", "c_mktsegment"]
    low, initial = F.lower("c_mktsegment"), F.substring("c_mktsegment", 1, 1)
    c = table(spark, sf, "customer").select("c_custkey", *g)
    c = places.matched(places.row_places(c, g, [F.col("c_custkey")], "n"), c.groupBy(*g).agg(F.count("*").alias("same")), g)
    return c.select("c_custkey", F.when(F.col("same") == 1, low).when(F.col("n") == 1, F.concat(low, F.lit(" "), initial)).otherwise(F.concat(low, F.lit(" "), initial, F.col("n").cast("string"))).alias("display"))



@query("""WITH names AS (SELECT DISTINCT lower(text[1:4]) AS stem FROM benchmark WHERE regexp_matches(lower(text[1:4]), '^[a-z]{4}$')), words AS (SELECT DISTINCT lower(w) AS w FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS w FROM conversations))
  SELECT stem, count(*) AS n_forms FROM names JOIN words ON w LIKE stem || '%' AND length(w) <= 7 GROUP BY stem""")
def inflected_mentions(spark: SparkSession, sf: str) -> DataFrame:
    """Forms of each name with up to three letters more. Words meet names by their first letters, so no word is held against every name."""
    stems = table(spark, sf, "benchmark").select(F.lower(F.substring("text", 1, 4)).alias("stem")).where("stem rlike '^[a-z]{4}$'").distinct()
    words = table(spark, sf, "conversations").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), 0)).alias("w")).select(F.lower("w").alias("w")).distinct()
    return words.where("length(w) between 4 and 7").withColumn("stem", F.substring("w", 1, 4)).join(stems, "stem").groupBy("stem").agg(F.count("*").alias("n_forms"))


@query(f"""WITH {POSTS} SELECT post_id, coalesce(CASE WHEN kind = 'view' THEN 'User' || k END, 'User' || author) AS account, lower(coalesce(CASE WHEN kind = 'view' THEN 'User' || k END, 'User' || author)) AS counted,
  'https://example.com/' || author || '/status/' || post_id AS url, printf('%d-%02d:%s', author, k % 38 + 1, kind) AS key FROM posts""")
def account_keys(spark: SparkSession, sf: str) -> DataFrame:
    """The original author of a repost else the author, in lower case for counting; address and key of a post."""
    s = lambda c: F.col(c).cast("string")
    account = F.coalesce(F.when(F.col("kind") == "view", F.concat(F.lit("User"), s("k"))), F.concat(F.lit("User"), s("author")))
    return events(spark, sf).select("post_id", account.alias("account"), F.lower(account).alias("counted"), F.concat(F.lit("https://example.com/"), s("author"), F.lit("/status/"), s("post_id")).alias("url"), F.format_string("%d-%02d:%s", "author", F.col("k") % 38 + 1, "kind").alias("key"))


@query(f"""WITH {POSTS}, slots AS (SELECT author, k % 5 AS slot, post_id, created, kind, row_number() OVER (PARTITION BY author, k % 5 ORDER BY created DESC, post_id DESC) AS n FROM posts) SELECT author, slot, post_id, kind FROM slots WHERE n = 1""")
def slot_map(spark: SparkSession, sf: str) -> DataFrame:
    """The last row of each slot in the order of time and id."""
    p = events(spark, sf).withColumn("slot", F.col("k") % 5).select("author", "slot", "post_id", "created", "kind")
    return latest.latest_per_key(p, ["author", "slot"], ["created", "post_id"]).select("author", "slot", "post_id", "kind")


@query(f"""WITH {POSTS}, counts AS (SELECT author, kind, count(*) AS n FROM posts GROUP BY 1, 2), best AS (SELECT author, kind, n, row_number() OVER (PARTITION BY author ORDER BY n DESC, kind) AS place FROM counts)
  SELECT author, max(kind) FILTER (place = 1) AS mode, string_agg(kind || '=' || n, ',' ORDER BY kind) AS counter FROM best GROUP BY author""")
def kind_counter(spark: SparkSession, sf: str) -> DataFrame:
    """How often each kind occurs by author, as text, and the most frequent one (of ties the first by name)."""
    counts = events(spark, sf).groupBy("author", "kind").agg(F.count("*").alias("n"))
    return counts.groupBy("author").agg(F.min_by("kind", F.struct(-F.col("n"), F.col("kind"))).alias("mode"), F.array_join(F.sort_array(F.collect_list(F.concat("kind", F.lit("="), F.col("n").cast("string")))), ",").alias("counter"))


@query(f"""WITH {POSTS} SELECT post_id, CASE WHEN k % 4 = 0 THEN NULL ELSE k END AS tokens_in, CASE WHEN k % 4 = 0 THEN CASE WHEN k % 8 = 0 THEN NULL ELSE author END WHEN k % 8 = 0 THEN k ELSE k + CASE WHEN k % 6 = 0 THEN 0 ELSE author END END AS usage FROM posts""")
def known_sum(spark: SparkSession, sf: str) -> DataFrame:
    """Sum in which a null is absent; null only where both are."""
    from ..functions import text

    p = events(spark, sf)
    a = F.when(F.col("k") % 4 != 0, F.col("k"))
    b = F.when(F.col("k") % 4 == 0, F.when(F.col("k") % 8 != 0, F.col("author"))).otherwise(F.when(F.col("k") % 6 != 0, F.col("author")))
    return p.select("post_id", a.alias("tokens_in"), text.add_known(a, b).alias("usage"))


@query(f"""WITH {POSTS}, s AS (SELECT post_id, CASE WHEN k % 3 = 0 THEN CAST(k AS VARCHAR) WHEN k % 3 = 1 THEN 'D-' || (k % 4) || '@' || printf('%02d:30', k % 24) ELSE 'soon' END AS slot FROM posts)
  SELECT post_id, slot, CASE WHEN regexp_full_match(slot, '[0-9]+') THEN CAST(slot AS BIGINT) WHEN regexp_full_match(slot, 'D-[0-9]+@[0-9]{{2}}:[0-9]{{2}}')
  THEN CAST(date_diff('minute', TIMESTAMP '2024-01-20 00:00:00' - to_days(CAST(regexp_extract(slot, 'D-([0-9]+)', 1) AS INTEGER)) + to_hours(CAST(regexp_extract(slot, '@([0-9]+)', 1) AS INTEGER)) + to_minutes(CAST(regexp_extract(slot, ':([0-9]+)', 1) AS INTEGER)), TIMESTAMP '2024-01-20 18:30:00') AS BIGINT) END AS minutes FROM s""")
def slot_minutes(spark: SparkSession, sf: str) -> DataFrame:
    """Minutes before a deadline of slots: a number, or days before at a clock time; null for anything else."""
    k = F.col("k")
    slot = F.when(k % 3 == 0, k.cast("string")).when(k % 3 == 1, F.concat(F.lit("D-"), (k % 4).cast("string"), F.lit("@"), F.format_string("%02d:30", k % 24))).otherwise("soon")
    part = lambda p: F.regexp_extract("slot", p, 1).try_cast("bigint")
    clock = 18 * 60 + 30 + part(r"^D-(\d+)@") * 1440 - part(r"@(\d\d):") * 60 - part(r":(\d\d)$")
    return events(spark, sf).select("post_id", slot.alias("slot")).withColumn("minutes", F.when(F.col("slot").rlike("^[0-9]+$"), F.col("slot").try_cast("bigint")).when(F.col("slot").rlike(r"^D-\d+@\d\d:\d\d$"), clock))


@query(f"""WITH {POSTS}, m AS (SELECT post_id, author + 1 AS was, k + 1 AS now FROM posts) SELECT post_id, was, now, was * 2 >= 3 * now AS moved_up, now * 2 >= 3 * was AS moved_down FROM m""")
def move_ratio(spark: SparkSession, sf: str) -> DataFrame:
    """Ratios of ranks compared exactly, by multiplication."""
    m = events(spark, sf).select("post_id", (F.col("author") + 1).alias("was"), (F.col("k") + 1).alias("now"))
    return m.select("*", (F.col("was") * 2 >= F.col("now") * 3).alias("moved_up"), (F.col("now") * 2 >= F.col("was") * 3).alias("moved_down"))


@query("""WITH n AS (SELECT DISTINCT lower(regexp_extract(text, '^[A-Za-z]+')) AS name FROM benchmark), w AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents) SELECT doc_id, count(DISTINCT name) AS leaked FROM w JOIN n ON word = name GROUP BY doc_id""")
def pseudonym_leaks(spark: SparkSession, sf: str) -> DataFrame:
    """Names that stand as whole words in a text."""
    names = table(spark, sf, "benchmark").select(F.lower(F.regexp_extract("text", "^[A-Za-z]+", 0)).alias("word")).distinct()
    words = table(spark, sf, "documents").select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0))).alias("word"))
    return words.join(names, "word").groupBy("doc_id").agg(F.count("*").alias("leaked"))


@query(f"""WITH {POSTS}, pages_of AS (SELECT author, post_id % 3 AS page, k AS entry, value FROM posts), last AS (SELECT *, row_number() OVER (PARTITION BY author, entry ORDER BY page DESC, value DESC) AS n FROM pages_of) SELECT author, entry, page, value FROM last WHERE n = 1""")
def paged_standings(spark: SparkSession, sf: str) -> DataFrame:
    """Of an entry that several pages hold, the last page's row stays."""
    p = events(spark, sf).select("author", (F.col("post_id") % 3).alias("page"), F.col("k").alias("entry"), "value")
    return latest.latest_per_key(p, ["author", "entry"], ["page", "value"])


@query(f"""WITH {POSTS}, pages_of AS (SELECT *, post_id // 50 AS page FROM posts), open AS (SELECT page, max(created) < TIMESTAMP '2024-01-10' AS old FROM pages_of GROUP BY page)
  SELECT post_id, page FROM pages_of JOIN open USING (page) WHERE NOT old AND post_id > 100""")
def incremental_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Posts after the last known id, from pages that aren't older than the floor as a whole; late posts inside a page are kept."""
    p = events(spark, sf).withColumn("page", F.expr("post_id div 50"))
    fresh = p.groupBy("page").agg(F.max("created").alias("newest")).where("newest >= timestamp_ntz'2024-01-10'")
    return p.where("post_id > 100").join(fresh, "page", "left_semi").select("post_id", "page")


@query("""SELECT d.doc_id, d.source, n_chars, (SELECT max(source) FROM documents) AS latest_list FROM documents d WHERE source NOT IN ('src3', 'src5') AND doc_id >= 10 AND doc_id < 900""")
def corpus_export(spark: SparkSession, sf: str) -> DataFrame:
    """A corpus without excluded sources, in a half-open window, with the newest list beside it."""
    d = table(spark, sf, "documents")
    newest = d.agg(F.max("source").alias("latest_list"))
    return d.where("source not in ('src3', 'src5') and doc_id >= 10 and doc_id < 900").join(F.broadcast(newest), F.lit(True)).select("doc_id", "source", "n_chars", "latest_list")
