"""Places by ranges against a plain version: null groups and values, ties, a group and a value of a third of all rows."""

import random

from pyspark.sql import functions as F

from touchline.operators import places


def test_places(spark):
    rng = random.Random(11)
    rows = [(i, rng.choice([None, "a", "b", "c", "hot", "hot", "hot"]), rng.choice([None, 5, 5, 5, rng.randrange(40)])) for i in range(900)]
    df = spark.createDataFrame(rows, "id long, g string, v int").withColumn("_sum", F.lit(1)).repartition(7)
    ranked = {r["id"]: r["place"] for r in places.competition_places(df, ["g"], "v", "place").collect()}
    ordered = {r["id"]: r["n"] for r in places.row_places(df, ["g"], [F.desc_nulls_last("v"), F.col("id")], "n").collect()}
    least = lambda v: -1 if v is None else v
    for i, g, v in rows:
        own = [(least(y), k) for k, x, y in rows if x == g]
        assert ranked[i] == 1 + sum(y > least(v) for y, _ in own)
        assert ordered[i] == 1 + sum((-y, k) < (-least(v), i) for y, k in own)


def test_sums_without_groups_and_without_rows(spark):
    df = spark.createDataFrame([(i, (i * 7) % 11) for i in range(50)], "id long, n int")
    got = {r["id"]: r["s"] for r in places.sum_before(df, [], [F.col("id")], F.col("n"), "s").collect()}
    assert got == {i: sum((k * 7) % 11 for k in range(i)) for i in range(50)}
    assert places.row_places(df.where("false"), ["n"], [F.col("id")], "p").collect() == []


def test_extremes(spark):
    df = spark.createDataFrame([(1, None, 3), (2, None, 5), (3, "a", None), (4, "a", 2)], "id long, g string, v int")
    got = {r["id"]: (r["hi"], r["lo"]) for r in places.with_extremes(df, ["g"], "v", "hi", "lo").collect()}
    assert got == {1: (5, 3), 2: (5, 3), 3: (2, 2), 4: (2, 2)}


def test_no_group_is_gathered_in_one_task(spark):
    """One group of all rows is numbered by several tasks, none of which sees most of it."""
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(20_000).withColumn("g", F.lit(1))
        dealt = df.repartitionByRange("g", "id").groupBy(F.spark_partition_id().alias("p")).count().collect()
        assert len(dealt) == 8 and max(r["count"] for r in dealt) < 5_000
        assert places.row_places(df, ["g"], [F.desc("id")], "n").where("n <> 20000 - id").count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
