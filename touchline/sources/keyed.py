"""A keyed table in hash buckets: a batch reads and rewrites only the buckets of its keys, and takes effect as a whole or not at all.

Under the path, ``data/v=N/bucket=K`` holds what commit N wrote for bucket K, and ``commits`` one row per bucket and commit, all of a
commit in one file that Spark's writer puts in place at its end. A bucket's newest committed version is read; what a lost job left
behind is not. Versions that a commit replaced are removed when the next one is through, so that readers of the last state finish.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

BUCKETS = 64
COMMITS = "v bigint, bucket int, batch string, inserted bigint, updated bigint"
#: How the rows of a key become one value of a column. Each gives the same for any order and grouping of the rows.
RULES = {"last": F.max_by, "and": lambda c, at: F.bool_and(c), "or": lambda c, at: F.bool_or(c), "sum": lambda c, at: F.sum(c), "max": lambda c, at: F.max(c), "min": lambda c, at: F.min(c)}


def _commits(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(COMMITS).parquet(f"{path}/commits")
    except AnalysisException:  # nothing committed yet
        return spark.createDataFrame([], COMMITS)


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _versions(spark: SparkSession, path: str) -> dict[int, int]:
    """The newest version of each bucket (of which there are a fixed number)."""
    return {r[0]: r[1] for r in _commits(spark, path).where("bucket >= 0").groupBy("bucket").agg(F.max("v")).collect()}


def _read(spark: SparkSession, path: str, versions: dict[int, int], schema: str) -> DataFrame:
    paths = [f"{path}/data/v={v}/bucket={b}" for b, v in sorted(versions.items())]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table as it was last committed."""
    return _read(spark, path, _versions(spark, path), schema)


def bucket_of(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def merge(batch: DataFrame, path: str, keys: list[str], order: list[str], rules: dict[str, str], batch_id: str | None = None, buckets: int = BUCKETS) -> dict[str, int]:
    """A batch enters the table; gives the numbers of inserted and updated keys and of buckets that were written.

    rules names a rule of RULES for each column that is neither key nor order; the rows of a key, the one that is there and those of the
    batch, are merged by them. last takes its columns from the row that is last by order (ties: the greatest of these columns); the order
    columns keep that row's values. The result doesn't depend on how rows came in batches. Null keys are keys of their own. A batch whose batch_id is committed already has
    no effect. Merging is an aggregate that is formed before the shuffle, so many rows of one key are no burden.
    """
    spark, columns = batch.sparkSession, [*keys, *order, *rules]
    schema = ", ".join(f"`{c}` {batch.schema[c].dataType.simpleString()}" for c in columns)
    done = _commits(spark, path)
    if batch_id is not None and done.where(F.col("batch") == batch_id).head(1):
        return {"inserted": 0, "updated": 0, "buckets": 0}
    versions = _versions(spark, path)
    rows = batch.select(*columns)
    touched = {r[0] for r in rows.select(bucket_of(keys, buckets).alias("b")).distinct().collect()}
    if not touched:
        return {"inserted": 0, "updated": 0, "buckets": 0}
    old = _read(spark, path, {b: v for b, v in versions.items() if b in touched}, schema)
    both = old.select(*columns, F.lit(True).alias("_old")).unionByName(rows.withColumn("_old", F.lit(False)))
    at = F.struct(*order, *sorted(c for c, r in rules.items() if r == "last"))
    kept = [F.max_by(c, at).alias(c) for c in order] + [RULES[r](c, at).alias(c) for c, r in rules.items()]
    state = (F.bool_or("_old").alias("_was"), F.bool_or(~F.col("_old")).alias("_came"))
    merged = both.groupBy(*keys).agg(*kept, *state).withColumn("bucket", bucket_of(keys, buckets))
    number = (done.agg(F.max("v")).first()[0] or 0) + 1
    to = f"{path}/data/v={number}"
    merged.repartition(max(1, len(touched)), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(to)
    written = spark.read.schema(f"{schema}, _was boolean, _came boolean, bucket int").parquet(to)
    counts = written.agg(F.count_if(~F.col("_was")), F.count_if(F.col("_was") & F.col("_came"))).first()
    commit = [(number, b, batch_id, counts[0], counts[1]) for b in sorted(touched)]
    spark.createDataFrame(commit, COMMITS).coalesce(1).write.mode("append").parquet(f"{path}/commits")
    stale = done.groupBy("bucket").agg(F.sort_array(F.collect_list("v"), False).alias("vs")).where("size(vs) > 1").collect()
    for r in stale:  # what commits before this one had replaced
        for v in r["vs"][1:]:
            _remove(spark, f"{path}/data/v={v}/bucket={r['bucket']}")
    return {"inserted": counts[0], "updated": counts[1], "buckets": len(touched)}


def sink(path: str, keys: list[str], order: list[str], rules: dict[str, str], name: str = "stream", buckets: int = BUCKETS):
    """A foreachBatch function that merges each micro-batch once, however often it is run."""

    def write(batch: DataFrame, number: int) -> None:
        merge(batch, path, keys, order, rules, f"{name}-{number}", buckets)

    return write
