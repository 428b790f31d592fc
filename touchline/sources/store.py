"""Tables that the library keeps for itself, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}
_kept: dict[tuple, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where it is unset (tests on one machine), a temporary folder."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return _own.setdefault("dir", "file://" + tempfile.mkdtemp(prefix="touchline-"))


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: computed once, whichever executor is lost."""
    path = new_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def kept(source: DataFrame, name: str, build) -> str:
    """The path of what build(path) wrote from this source; built once in a session for the same files with the same sizes and times."""
    spark = source.sparkSession
    meta = F.struct("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time")
    state = source.select(meta.alias("m")).agg(F.count("*"), F.bit_xor(F.xxhash64("m")), F.max("m")).first()  # of the rows' files: no column is read
    key = (spark.sparkContext.applicationId, name, str(state))
    if key not in _kept:
        path = new_path(spark, name)
        build(path)
        _kept[key] = path
    return _kept[key]
