"""A queue of retries with timers: a try that failed is due again after a while, a success or too many tries end it.

Needs the RocksDB state store (spark.sql.streaming.stateStore.providerClass), as all stateful processors with timers do.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Retries(StatefulProcessor):
    """State of a key: tries so far and the last of them; one timer, wait after the last failed try. A key that succeeded keeps -1 tries, so
    that a late failure doesn't bring it back."""

    def __init__(self, wait_ms: int, most: int):
        self.wait_ms, self.most = wait_ms, most

    def init(self, handle: Any) -> None:
        self.handle = handle
        self.state = handle.getValueState("tries", "tries int, last_ms bigint")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        tries, last = self.state.get() if self.state.exists() else (0, 0)
        if tries >= 0:
            came = [(r["ms"], r["ok"]) for r in rows]
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if any(ok for _, ok in came):
                self.state.update((-1, 0))
            else:
                tries, last = tries + len(came), max(last, *(ms for ms, _ in came))
                self.state.update((tries, last))
                if tries < self.most:
                    self.handle.registerTimer(last + self.wait_ms)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        tries, last = self.state.get()
        yield Row(key=key[0], attempts=tries, last_at=datetime.fromtimestamp(last / 1000, timezone.utc).replace(tzinfo=None))

    def close(self) -> None:
        pass


def retries(tries: DataFrame, key: str, at: str, ok: str, wait: str = "10 minutes", most: int = 5, late: str = "1 minute") -> DataFrame:
    """(key, attempts, last_at) each time that a key is due: all its tries failed, there were fewer than most, and wait has passed since the
    last one, by the watermark. Rows with a null key, time or outcome don't take part; state is one small row a key."""
    kind = tries.schema[key].dataType.simpleString()
    wait_ms = int(seconds_of(wait) * 1000)
    slim = tries.where(F.col(key).isNotNull() & F.col(at).isNotNull() & F.col(ok).isNotNull()).select(F.col(key).alias("key"), F.col(at).cast("timestamp").alias("at"), F.col(ok).alias("ok"))
    timed = slim.withWatermark("at", late).withColumn("ms", F.unix_millis("at"))
    return timed.groupBy("key").transformWithState(Retries(wait_ms, most), f"key {kind}, attempts int, last_at timestamp_ntz", "append", "EventTime").withColumnRenamed("key", key)


def seconds_of(span: str) -> float:
    """Seconds of a span such as '10 minutes'."""
    number, unit = span.split()
    return float(number) * {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[unit.rstrip("s")]
