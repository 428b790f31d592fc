"""Readers of the driver's tables and of JSON, and the ways in which tables are written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Typed JSON lines; a line that doesn't parse is kept in _corrupt_record instead of being dropped."""
    return spark.read.schema(f"{schema}, _corrupt_record string").option("mode", "PERMISSIVE").json(path)


def tagged_json_lines(spark: SparkSession, path: str, schema: str, tag: str = "kind", default: str = "free") -> DataFrame:
    """JSON lines of several kinds in one file, the kind filled in where it is absent."""
    return json_lines(spark, path, f"{schema}, {tag} string").withColumn(tag, F.coalesce(tag, F.lit(default)))


def snapshot(spark: SparkSession, path: str, field: str, schema: str) -> DataFrame:
    """The array under one field of a JSON document, a row for each element."""
    return spark.read.schema(f"{field} array<struct<{schema}>>").option("multiLine", True).json(path).select(F.inline(field))


def split_records(df: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Lines of two kinds in one file: those that have a key, and the others without its column."""
    return df.where(F.col(key).isNotNull()), df.where(F.col(key).isNull()).drop(key)


def lookup(spark: SparkSession, path: str) -> DataFrame:
    """A TOML file of name = value (or name = [values]) lines, a row (name, value) each. Such files are written by hand, so the driver reads them."""
    import tomllib

    text = "\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())
    rows = [(k, str(v)) for k, vs in tomllib.loads(text).items() for v in (vs if isinstance(vs, list) else [vs])]
    return spark.createDataFrame(rows, "name string, value string")


def append_log(df: DataFrame, path: str) -> None:
    """Rows are added to a log; what is there stays."""
    df.write.mode("append").parquet(path)


def write_new(df: DataFrame, path: str) -> None:
    """A result that must not be there yet; the writer's commit makes it whole or absent."""
    df.write.mode("errorifexists").parquet(path)


def archived(payloads: DataFrame, keys: list[str], order: str, payload: str, schema: str) -> DataFrame:
    """The elements of each key's latest JSON payload, a row each; a payload that doesn't parse gives none."""
    from ..operators.latest import latest_per_key

    last = latest_per_key(payloads.select(*keys, order, payload), keys, [order])
    return last.select(*keys, F.inline(F.from_json(payload, f"array<struct<{schema}>>")))


def weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(league, manager, gw, points, total): orders as a league's weeks. A nation is a league, a customer a manager, a month a week, cents are points."""
    from pyspark.sql import Window

    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    per = (
        orders.join(customers, orders.o_custkey == customers.c_custkey)
        .groupBy(F.col("c_nationkey").cast("bigint").alias("league"), F.col("c_custkey").alias("manager"), (F.year("o_orderdate") * 12 + F.month("o_orderdate")).cast("bigint").alias("gw"))
        .agg(F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint")).alias("points"))
    )
    return per.withColumn("total", F.sum("points").over(Window.partitionBy("manager").orderBy("gw")))


def tasks_for(*tables: DataFrame, rows: int = 500_000) -> int:
    """How many tasks deal tables out so that each holds about so many rows of the largest: their memory stays the same as the tables grow."""
    return max(1, *(-(-t.count() // rows) for t in tables))
