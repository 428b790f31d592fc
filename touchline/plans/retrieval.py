"""Queries on stored search: the index of documents, ranked full text, and hybrid search with a text of its own for each query.

Documents stand for posts; the event of the same number gives the time. A query is the first sentence of a document whose id is
divisible by 100; its vector is the embedding of that number, where there is one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import search, textindex, vectors
from ..sources import store
from ..sources.store import written
from ..sources.tables import table
from .analysis import COS, NORM, asked
from .registry import Registry

query = Registry()
QUERIES, ORACLE = query.queries, query.oracle

_STEM = "w"
for _pattern, _stays in textindex.ENDINGS:
    _STEM = f"regexp_replace({_STEM}, '{_pattern}', '{_stays}')"
_STOP = ", ".join(f"'{w}'" for w in textindex.STOP_WORDS)


def _stems(source: str, key: str, text: str) -> str:
    """SQL of (key, term), a row for each word that is indexed."""
    words = f"SELECT {key}, unnest(list_filter(regexp_split_to_array({NORM.format(text)}, '[^a-z0-9]+'), lambda x: x <> '')) AS w FROM {source}"
    return f"SELECT {key}, CASE WHEN len(w) > 3 AND regexp_matches(w, '(s|y|ing|ed)$') THEN {_STEM} ELSE w END AS term FROM ({words}) WHERE w NOT IN ({_STOP})"


_WANTED = "SELECT doc_id AS q, regexp_extract(text, '^[^.\\n]*') AS text FROM documents WHERE doc_id % 100 = 0"
_RANKED = f"""words AS (SELECT doc_id AS id, term, count(*) AS n FROM ({_stems("documents", "doc_id", "text")}) GROUP BY ALL), wants AS (SELECT DISTINCT q, term AS want FROM ({_stems(f"({_WANTED})", "q", "text")})),
  met AS (SELECT DISTINCT q, term FROM (SELECT DISTINCT term FROM words) JOIN wants ON CASE WHEN len(want) >= {textindex.PREFIX} THEN starts_with(term, want) ELSE term = want END),
  covered AS (SELECT q, id, CAST(sum(n) AS BIGINT) AS covers, any_value(ts) AS made FROM met JOIN words USING (term) LEFT JOIN events ON event_id = id GROUP BY 1, 2),
  ranked AS (SELECT q, row_number() OVER (PARTITION BY q ORDER BY covers DESC, made DESC NULLS LAST, id DESC) AS place, id, covers FROM covered QUALIFY place <= {textindex.DEPTH})"""


def indexed(spark: SparkSession, sf: str) -> str:
    """The path of the index of all documents, written once in a session."""
    docs = table(spark, sf, "documents")
    times = table(spark, sf, "events").select(F.col("event_id").alias("doc"), F.col("ts").alias("at"))
    return store.kept(docs, "textindex", lambda path: textindex.add(docs, path, "doc_id", "text", times=times))


def texts_asked(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").where("doc_id % 100 = 0").select(F.col("doc_id").alias("q"), F.regexp_extract("text", r"^[^.\n]*", 0).alias("text"))


def _ranked(spark: SparkSession, sf: str) -> DataFrame:
    return textindex.search(indexed(spark, sf), texts_asked(spark, sf))


@query(f"""WITH t AS (SELECT term, count(DISTINCT doc_id) AS n_docs, count(*) AS n_places FROM ({_stems("documents", "doc_id", "text")}) GROUP BY 1) SELECT * FROM t""")
def index_terms(spark: SparkSession, sf: str) -> DataFrame:
    """Documents and places of each stem, from the stored postings."""
    return textindex.term_counts(spark, indexed(spark, sf))


@query(f"WITH {_RANKED} SELECT * FROM ranked")
def fulltext_ranked(spark: SparkSession, sf: str) -> DataFrame:
    """Each query's fifty documents by covers, newer first; from the buckets of its stems."""
    return _ranked(spark, sf).select("q", "place", "id", "covers")


def hybrid(text_leg: DataFrame | None, vector_leg: DataFrame | None, queries: DataFrame, limit: int) -> DataFrame:
    """q, place, id, score, legs: the legs that are given, fused. A query whose vector leg is empty degrades to full text, and the other
    way round; legs names those that answered. One leg alone is the mode fulltext or vector."""
    given = [(name, written(leg)) for name, leg in (("fulltext", text_leg), ("vector", vector_leg)) if leg is not None]  # searched once, read twice
    both, answered = [leg for _, leg in given], None
    for name, leg in given:
        own = leg.select("q").distinct().withColumn("leg", F.lit(name))
        answered = own if answered is None else answered.union(own)
    legs = answered.groupBy("q").agg(F.array_join(F.sort_array(F.collect_set("leg")), ",").alias("legs"))
    fused = search.fuse(both, ["q"]).withColumn("score", F.round("score", 9))
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "best", F.desc("id"))).cast("bigint")
    return fused.withColumn("place", place).where(F.col("place") <= limit).join(legs, "q").join(queries.select("q"), "q", "left_semi").select("q", "place", "id", "score", "legs")


_FUSED = "SELECT q, row_number() OVER (PARTITION BY q ORDER BY score DESC, best, id DESC) AS place, id, score, legs FROM s JOIN g USING (q) QUALIFY place <= 20"


@query(f"""WITH {_RANKED}, v AS ({COS}), g AS (SELECT q, string_agg(leg, ',' ORDER BY leg) AS legs FROM (SELECT DISTINCT q, 'fulltext' AS leg FROM ranked UNION SELECT DISTINCT q, 'vector' FROM v) GROUP BY 1),
  s AS (SELECT q, id, round(sum(1.0 / (60 + place)), 9) AS score, min(place) AS best FROM (SELECT q, place, id FROM ranked UNION ALL SELECT q, place, id FROM v WHERE q IN (SELECT doc_id FROM documents)) GROUP BY 1, 2) {_FUSED}""")
def hybrid_search(spark: SparkSession, sf: str) -> DataFrame:
    """Full text and vector legs of each query, fused; queries without a vector degrade to full text."""
    e = table(spark, sf, "embeddings")
    return hybrid(_ranked(spark, sf), vectors.nearest_each(e, asked(e), "vec_id", "embedding", textindex.DEPTH), texts_asked(spark, sf), 20)


@query(f"""WITH {_RANKED}, g AS (SELECT DISTINCT q, 'fulltext' AS legs FROM ranked), s AS (SELECT q, id, round(1.0 / (60 + place), 9) AS score, place AS best FROM ranked) {_FUSED}""")
def fulltext_mode(spark: SparkSession, sf: str) -> DataFrame:
    """The same search in the mode that uses no vectors."""
    return hybrid(_ranked(spark, sf), None, texts_asked(spark, sf), 20)
