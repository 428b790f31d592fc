"""The registered queries of the operators: whole tables, production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import alignment, centroids, decontaminate, exact_dedup, langid, lm_scoring, near_dedup, quality_rules, secrets, sentencepiece_codec, suffix_dedup, token_counts, toxicity
from .shared import documents


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode_documents(documents(spark, sf_dir))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(documents(spark, sf_dir))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(documents(spark, sf_dir))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(documents(spark, sf_dir))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(documents(spark, sf_dir))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(documents(spark, sf_dir))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.drop_repeats(documents(spark, sf_dir))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(documents(spark, sf_dir))


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge_quality(documents(spark, sf_dir))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_tokens(documents(spark, sf_dir))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {f.__name__: f for f in (op1_sentencepiece, op2_language_id, op3_near_dedup, op4_toxicity, op5_lm_scoring, op6_token_counts, op7_secret_scan, op8_suffix_dedup, op9_decontamination, op10_exact_dedup, op11_quality_rules, op12_alignment, op13_centroids)}



def _centroids_sql(rounds: int = 5) -> str:
    """Lloyd's rounds as a chain of table expressions; doubles hold these integers exactly."""
    nearest = """a{r} AS MATERIALIZED (SELECT vec_id, q, m % 64 AS cluster, m // 64 AS distance FROM (
            SELECT k.vec_id, k.q, min(CAST(list_dot_product(k.q, k.q) - 2 * list_dot_product(k.q, c.q) + list_dot_product(c.q, c.q) AS BIGINT) * 64 + c.j) AS m
            FROM k, c{r} c GROUP BY ALL))"""
    moved = """c{n} AS MATERIALIZED (SELECT c.j, coalesce(s.q, c.q) AS q FROM c{r} c LEFT JOIN (
            SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS DOUBLE) ORDER BY pos) AS q FROM (
                SELECT cluster, pos, sum(x) AS s, count(*) AS n FROM (SELECT cluster, unnest(range(1, 65)) AS pos, CAST(unnest(q) AS BIGINT) AS x FROM a{r}) GROUP BY ALL) GROUP BY cluster) s ON s.cluster = c.j)"""
    steps = ", ".join(f"{nearest.format(r=r)}, {moved.format(r=r, n=r + 1)}" for r in range(rounds))
    return f"""
        WITH k AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
                WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
            c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS j, q FROM (SELECT sha256('2:' || vec_id) AS h, q FROM k ORDER BY h LIMIT 40)),
            {steps}, {nearest.format(r=rounds)}
        SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,
            sha256(array_to_string(list_transform(c.q, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ',')) AS centroid_sha256
        FROM a{rounds} a JOIN c{rounds} c ON c.j = a.cluster"""


ORACLE = {
    "op13_centroids": _centroids_sql(),
    "op10_exact_dedup": r"""
        WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
        FROM d WINDOW w AS (PARTITION BY norm)""",
}
