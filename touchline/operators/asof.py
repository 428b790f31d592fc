"""As-of joins by one sort: both sides are united and the nearest row is carried along a window, so no key's rows are multiplied."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def around(points: DataFrame, marks: DataFrame, by: str, at: str, mark: str, mark_id: str) -> DataFrame:
    """points with prev_* (last mark at or before the point) and next_* (first mark strictly after), by (time, id)."""
    p = points.select("*", F.col(at).alias("_t"), F.lit(1).alias("_kind"), F.lit(None).cast("bigint").alias("_id"))
    m = marks.select(F.col(by), F.col(mark).alias("_t"), F.lit(0).alias("_kind"), F.col(mark_id).cast("bigint").alias("_id"))
    u = p.unionByName(m, allowMissingColumns=True)
    own = F.when(F.col("_kind") == 0, F.struct(F.col("_t").alias("t"), F.col("_id").alias("id")))
    back = Window.partitionBy(by).orderBy("_t", "_kind", "_id").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(by).orderBy(F.desc("_t"), F.desc("_kind"), F.desc("_id")).rowsBetween(Window.unboundedPreceding, 0)
    u = u.withColumn("_prev", F.last(own, True).over(back)).withColumn("_next", F.last(own, True).over(ahead))
    return u.where("_kind = 1").select(*points.columns, F.col("_prev.t").alias("prev_at"), F.col("_prev.id").alias("prev_id"), F.col("_next.t").alias("next_at"), F.col("_next.id").alias("next_id"))


def met_spans(spans: DataFrame, on: list[str], id_col: str, start: str, end: str) -> DataFrame:
    """on, one, two: candidates for an overlap, of which one starts first (then the smaller id) and two starts, by day, while one lasts.

    A span waits in the bins of its days whose width is the power of two next above its length, at most two of them; another span is
    looked for in the bin of its first day, once for each width that there is. So a long span meets what starts in it, and many short
    ones don't meet each other. The widths (at most 32) come to the driver.
    """
    day = lambda c: F.unix_date(F.to_date(F.col(c)))
    level = F.ceil(F.log2(F.col("_b") - F.col("_a") + 1)).cast("int")
    s = spans.select(*on, F.col(id_col).alias("_id"), F.col(start).alias("_start"), F.col(end).alias("_end")).withColumn("_a", day("_start")).withColumn("_b", F.greatest(day("_end"), "_a")).withColumn("_level", level)
    levels = sorted(r[0] for r in s.select("_level").distinct().where("_level is not null").collect())
    bin_ = lambda d, n: F.expr(f"shiftright({d}, {n})")
    waiting = s.withColumn("_bin", F.explode(F.sequence(bin_("_a", "_level"), bin_("_b", "_level"))))
    looking = s.select(*on, "_id", "_start", "_end", F.explode(F.array(*map(F.lit, levels)) if levels else F.array().cast("array<int>")).alias("_level"), "_a").withColumn("_bin", bin_("_a", "_level")).drop("_a")
    x, y = waiting.alias("x"), looking.alias("y")
    first = F.struct("x._start", "x._id") < F.struct("y._start", "y._id")
    met = x.join(y, [F.col(f"x.{k}") == F.col(f"y.{k}") for k in (*on, "_level", "_bin")] + [first])
    return met.select(*[F.col(f"x.{k}").alias(k) for k in on], F.col("x._id").alias("one"), F.col("y._id").alias("two"), F.col("x._start").alias("_xs"), F.col("x._end").alias("_xe"), F.col("y._start").alias("_ys"), F.col("y._end").alias("_ye"))


def overlaps(spans: DataFrame, on: list[str], id_col: str, start: str, end: str) -> DataFrame:
    """on, one, two: pairs of spans of one key that overlap, one.start < two.end and two.start < one.end; one starts first, then has the
    smaller id. Spans with a null key, start or end overlap with nothing; each id of a key is one span."""
    return met_spans(spans, on, id_col, start, end).where("_xs < _ye and _ys < _xe").drop("_xs", "_xe", "_ys", "_ye")
