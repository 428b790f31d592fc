"""The queue with timers over a stream of files, stopped and started again, against what a batch says."""

from pyspark.sql import functions as F

from touchline.sources.tables import table
from touchline.streaming import changes, retries

SF = "/root/testdata/sf0.001"


def test_retries_over_restarts(spark, tmp_path):
    runs = table(spark, SF, "events").select(F.expr("event_id div 4").alias("post"), F.col("ts").alias("at"), (F.col("event_type") != "error").alias("ok"), "event_id")
    runs = runs.withColumn("ok", F.col("event_id") % 7 == 0).orderBy("at")
    rows = runs.collect()
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", retries.PROVIDER)
    schema, folder, out = runs.schema, str(tmp_path / "in"), str(tmp_path / "out")
    try:
        for part in range(3):  # a new query for each part: state and timers come from the checkpoint
            own = rows[part * len(rows) // 3 : (part + 1) * len(rows) // 3]
            spark.createDataFrame(own, schema).coalesce(1).write.mode("append").parquet(folder)
            due = retries.retries(changes.follow(spark, folder, 1), "post", "at", "ok", "10 minutes", 5)
            due.writeStream.trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").format("parquet").option("path", out).start().awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = {}
    for r in spark.read.schema("post bigint, attempts int, last_at timestamp_ntz").parquet(out).collect():
        got.setdefault(r["post"], []).append((r["attempts"], r["last_at"]))
    end = max(r["at"] for r in rows)
    tries = {}
    for r in rows:
        tries.setdefault(r["post"], []).append((r["at"], r["ok"]))
    want = {p: (len(x), max(a for a, _ in x)) for p, x in tries.items() if not any(ok for _, ok in x) and len(x) < 5}
    waited = {p: x for p, x in want.items() if (end - x[1]).total_seconds() > 3600}  # long before the last watermark
    millis = lambda d: d.replace(microsecond=d.microsecond // 1000 * 1000)
    assert len(waited) > 3
    for p, (n, last) in waited.items():
        assert got[p][-1] == (n, millis(last)) or (n, millis(last)) in got[p]
    for p, found in got.items():  # nothing is due that had succeeded, or had five tries, in what was known then
        for n, last in found:
            before = [ok for a, ok in tries[p] if millis(a) <= last]
            assert n < 5 and len(before) == n and not any(before)


def test_spans():
    assert [retries.seconds_of(x) for x in ("10 minutes", "1 hour", "2 days", "5 seconds")] == [600, 3600, 172800, 5]
