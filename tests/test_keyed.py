"""The keyed table against a plain dictionary: touched buckets, replays, flags, inserts, what a lost job leaves."""

import datetime
import random

from touchline.sources import keyed

T = datetime.datetime(2024, 1, 1)
SCHEMA = "id long, page string, at timestamp_ntz, text string, repost boolean, kept boolean, seen long, first string"
READ = SCHEMA.replace("long", "bigint")
RULES = {"text": "last", "repost": "or", "kept": "and", "seen": "sum", "first": "min"}
KEYS, ORDER = ["id", "page"], ["at"]


def batch(rng, n, ids=40):
    rows = []
    for _ in range(n):
        t = f"t{rng.randrange(1000)}"
        rows.append((rng.choice([None, *range(ids)]), rng.choice([None, "a"]), T + datetime.timedelta(minutes=rng.randrange(10_000)), t, rng.random() < 0.3, rng.choice([True, True, None, False]), rng.randrange(5), t))
    return rows


def plain(batches):
    table = {}
    for rows in batches:
        for r in rows:
            table.setdefault(r[:2], []).append(r)
    out = set()
    for key, rows in table.items():
        last = max(rows, key=lambda r: (r[2], r[3]))
        kept = [r[5] for r in rows if r[5] is not None]
        out.add((*key, last[2], last[3], any(r[4] for r in rows), all(kept) if kept else None, sum(r[6] for r in rows), min(r[7] for r in rows)))
    return out


def now(spark, path):
    return {tuple(r) for r in keyed.read(spark, path, READ).collect()}


def test_batches_fold_into_one_row_a_key(spark, tmp_path):
    """Times overlap between batches, and some are equal."""
    path, rng, batches, known = str(tmp_path / "t"), random.Random(2), [], set()
    for k in range(3):
        rows = batch(rng, 80)
        rows += [(r[0], r[1], r[2], f"{r[3]}!", False, True, 1, "t") for r in rows[:10]]
        got = keyed.merge(spark.createDataFrame(rows, SCHEMA).repartition(3), path, KEYS, ORDER, RULES, f"b{k}", 8)
        new = {r[:2] for r in rows}
        assert (got["inserted"], got["updated"]) == (len(new - known), len(new & known))
        known |= new
        batches.append(rows)
        assert now(spark, path) == plain(batches)


def test_a_small_batch_leaves_other_buckets_alone(spark, tmp_path):
    path = str(tmp_path / "t")
    row = lambda i, m, t: (i, "a", T + datetime.timedelta(minutes=m), t, False, True, 1, t)
    keyed.merge(spark.createDataFrame([row(i, 0, "x") for i in range(200)], SCHEMA), path, KEYS, ORDER, RULES, "one", 16)
    files = lambda: {f: f.stat().st_mtime_ns for f in (tmp_path / "t" / "data").rglob("part-*.parquet")}
    before = files()
    got = keyed.merge(spark.createDataFrame([row(5, 1, "y"), row(5, 2, "z"), row(900, 1, "w")], SCHEMA), path, KEYS, ORDER, RULES, "two", 16)
    assert got["inserted"] == 1 and got["updated"] == 1 and got["buckets"] <= 2
    assert before.items() <= files().items() and len(files()) == len(before) + got["buckets"]
    state = now(spark, path)
    assert {r[3] for r in state if r[0] == 5} == {"z"} and len(state) == 201
    assert keyed.merge(spark.createDataFrame([row(5, 3, "never")], SCHEMA), path, KEYS, ORDER, RULES, "two", 16) == {"inserted": 0, "updated": 0, "buckets": 0}
    assert now(spark, path) == state
    keyed.merge(spark.createDataFrame([row(5, 4, "v")], SCHEMA), path, KEYS, ORDER, RULES, "three", 16)
    assert not before.items() <= files().items()  # versions that the second batch replaced are gone
    assert {r[3] for r in now(spark, path) if r[0] == 5} == {"v"} and len(now(spark, path)) == 201


def test_what_is_not_committed_is_not_read(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([(1, "a", T, "x", False, True, 1, "x")], SCHEMA)
    keyed.merge(rows, path, KEYS, ORDER, RULES, "one", 4)
    state = now(spark, path)
    rows.withColumn("_was", rows.repost).withColumn("_came", rows.kept).withColumn("bucket", rows.seen.cast("int")).write.partitionBy("bucket").parquet(f"{path}/data/v=2")  # a job that was lost before its commit
    assert now(spark, path) == state
    keyed.merge(spark.createDataFrame([(2, "a", T, "y", False, True, 1, "y")], SCHEMA), path, KEYS, ORDER, RULES, "two", 4)
    assert {r[0] for r in now(spark, path)} == {1, 2}


def test_nothing_in_nothing_out(spark, tmp_path):
    path = str(tmp_path / "t")
    empty = spark.createDataFrame([], SCHEMA)
    assert keyed.merge(empty, path, KEYS, ORDER, RULES) == {"inserted": 0, "updated": 0, "buckets": 0}
    assert now(spark, path) == set()
