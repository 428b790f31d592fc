"""Where intermediate tables go: the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where it is unset (tests on one machine), a temporary folder."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return _own.setdefault("dir", "file://" + tempfile.mkdtemp(prefix="touchline-"))


def materialize(df: DataFrame) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: computed once, no lineage, any executor may be lost."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, row_bytes: int = 24, limit: int = 12 << 20) -> DataFrame:
    """df with a broadcast hint if its counted rows take up to limit bytes, else as it is. For tables that materialize() wrote: their
    rows are counted from file footers."""
    from pyspark.sql import functions as F

    return F.broadcast(df) if df.count() * row_bytes <= limit else df


def free_name(df: DataFrame, name: str) -> str:
    """name, lengthened until no column of df has it, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def bounded(df: DataFrame, columns: list[str], most: int) -> DataFrame:
    """The distinct rows of df, at most so many of them: those with the smallest hashes. Meant for samples whose rows may repeat a key."""
    from pyspark.sql import functions as F

    few = df.select(*columns).dropDuplicates().orderBy(F.xxhash64(*columns)).limit(most)
    return few.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
