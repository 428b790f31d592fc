"""Streams over files against what a batch gives."""

import datetime

import pytest
from pyspark.sql import functions as F

from touchline.operators.latest import change_log, latest_per_key
from touchline.sources import keyed
from touchline.streaming import changes

SCHEMA = "id bigint, user string, ts timestamp, kind string"


def at(minute):
    return datetime.datetime(2026, 1, 1, 10) + datetime.timedelta(minutes=minute)


BATCHES = [
    [(1, "a", at(0), "out"), (2, "a", at(1), "out"), (3, "b", at(2), None), (1, "a", at(0), "out"), (4, None, at(2), "out")],
    [(5, "a", at(20), "doubt"), (6, "b", at(21), "out"), (2, "a", at(1), "out")],
    [(7, "a", at(60), "doubt"), (8, "b", at(61), None), (9, "c", at(62), "out"), (10, "b", at(70), None)],
]


@pytest.fixture
def folder(spark, tmp_path):
    for k, rows in enumerate(BATCHES):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return str(tmp_path / "in")


def drain(stream, tmp_path, sink=None, mode="append"):
    w = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "state"))
    if sink:
        w.foreachBatch(sink).start().awaitTermination()
        return None
    w.outputMode(mode).format("parquet").option("path", str(tmp_path / "out")).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(str(tmp_path / "out"))


def test_changes(spark, folder, tmp_path):
    got = drain(changes.changes(changes.follow(spark, folder), "user", "ts", "kind"), tmp_path)
    want = change_log(spark.read.parquet(folder).where("user is not null"), ["user"], ["ts", "id"], ["kind"]).select("user", "ts", F.col("kind").alias("now"))
    assert sorted(map(str, got.select("user", "ts", "now").collect())) == sorted(map(str, want.collect()))


def test_first_seen(spark, folder, tmp_path):
    got = drain(changes.first_seen(changes.follow(spark, folder), ["id"], "ts", "1 hour"), tmp_path)
    assert sorted(r["id"] for r in got.collect()) == list(range(1, 11))


def test_window_counts(spark, folder, tmp_path):
    got = drain(changes.window_counts(changes.follow(spark, folder), "ts", "5 minutes", "30 minutes", ["user"]), tmp_path)
    rows = {(r["start"], r["user"]): r["n"] for r in got.collect()}
    assert rows[at(0), "a"] == 5 and rows[at(0), "b"] == 2 and rows[at(0), None] == 1
    assert (at(60), "c") not in rows  # the watermark has not passed that window


def test_keyed_sink(spark, folder, tmp_path):
    path = str(tmp_path / "table")
    rules = {"user": "last", "kind": "last"}
    drain(changes.follow(spark, folder, 1), tmp_path, keyed.sink(path, ["id"], ["ts"], rules))
    want = latest_per_key(spark.read.parquet(folder), ["id"], ["ts"]).select("id", "ts", "user", "kind")
    now = lambda: sorted(map(str, keyed.read(spark, path, "id bigint, ts timestamp, user string, kind string").collect()))
    assert now() == sorted(map(str, want.collect()))
    keyed.sink(path, ["id"], ["ts"], rules)(spark.createDataFrame([(1, "zz", at(99), "out")], SCHEMA), 2)  # the number of a batch that is in already
    assert now() == sorted(map(str, want.collect()))
