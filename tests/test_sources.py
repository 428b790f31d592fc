"""JSON and TOML sources, logs, refusal to overwrite, and back-fills from archived payloads."""

import pytest
from pyspark.errors import AnalysisException

from touchline.functions import text
from touchline.operators import latest
from touchline.sources import tables


def test_json_lines_keep_broken_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": 1, "kind": "player"}\n{"id": 2}\nnot json\n{"id": "x"}\n')
    got = tables.tagged_json_lines(spark, f"file://{tmp_path}/a.jsonl", "id bigint").collect()
    assert sorted((r["id"], r["kind"]) for r in got if r["_corrupt_record"] is None) == [(1, "player"), (2, "free")]
    assert len([r for r in got if r["_corrupt_record"] is not None]) == 2


def test_lines_of_two_kinds(spark, tmp_path):
    (tmp_path / "b.jsonl").write_text('{"x_id": 7, "seconds": 1.5}\n{"polls": 3}\n{"x_id": 8, "seconds": 2.0}\n')
    posts, polls = tables.split_records(spark.read.schema("x_id bigint, seconds double, polls int").json(f"file://{tmp_path}/b.jsonl"), "x_id")
    assert sorted(r["x_id"] for r in posts.collect()) == [7, 8] and [r["polls"] for r in polls.collect()] == [3] and "x_id" not in polls.columns


def test_snapshot_and_lookup(spark, tmp_path):
    (tmp_path / "s.json").write_text('{"players": [{"id": 1, "name": "a"},\n {"id": 2, "name": null}]}')
    got = tables.snapshot(spark, f"file://{tmp_path}/s.json", "players", "id bigint, name string").collect()
    assert [(r["id"], r["name"]) for r in got] == [(1, "a"), (2, None)]
    (tmp_path / "l.toml").write_text('gunners = "arsenal"\nspurs = ["tottenham", "thfc"]\n')
    assert {tuple(r) for r in tables.lookup(spark, f"file://{tmp_path}/l.toml").collect()} == {("gunners", "arsenal"), ("spurs", "tottenham"), ("spurs", "thfc")}


def test_logs_grow_and_results_are_not_overwritten(spark, tmp_path):
    one = spark.range(2)
    for n in (2, 4):
        tables.append_log(one, f"file://{tmp_path}/log")
        assert spark.read.parquet(f"file://{tmp_path}/log").count() == n
    tables.write_new(one, f"file://{tmp_path}/result")
    with pytest.raises(AnalysisException):
        tables.write_new(one, f"file://{tmp_path}/result")


def test_backfill_from_the_latest_payload(spark):
    rows = [(1, 10, '[{"h": 1, "a": 2}]'), (1, 11, '[{"h": 3, "a": 4}, {"h": 5, "a": null}]'), (2, 10, "broken"), (3, 10, "[]"), (4, 10, None)]
    got = tables.archived(spark.createDataFrame(rows, "gw int, at int, payload string"), ["gw"], "at", "payload", "h bigint, a bigint").collect()
    assert sorted(map(tuple, got), key=str) == [(1, 3, 4), (1, 5, None)]


def test_clock_slots_and_first_rows(spark):
    """A slot at a civil time, before and after the change of clocks; and the first row of each key."""
    import datetime as dt

    days = spark.createDataFrame([(dt.date(2024, 3, 30), 0), (dt.date(2024, 4, 1), 0), (dt.date(2024, 4, 1), 3)], "day date, before int")
    from pyspark.sql import functions as F

    got = [r[0] for r in days.select(text.wall_clock_utc(F.col("day"), F.col("before"), F.lit("18:30"), "Europe/Warsaw")).collect()]
    assert [t.hour for t in got] == [17, 16, 17]
    assert [r[0] for r in spark.createDataFrame([("90",), ("D-1@18:00",), (None,)], "s string").select(text.slot_minutes(F.col("s"))).collect()] == [90, None, None]
    df = spark.createDataFrame([(1, 5, "b"), (1, 2, "a"), (2, 9, None)], "k int, at int, v string")
    assert sorted(map(tuple, latest.first_per_key(df, ["k"], ["at"]).collect())) == [(1, 2, "a"), (2, 9, None)]
