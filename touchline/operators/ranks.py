"""League tables: ranks, movements, streaks, records, swaps. Windows are partitioned by league and week or by manager; tables and movements are placed by ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import places


def competition_rank(groups: list[str], value: str) -> Column:
    """1 + number of strictly greater values in the group."""
    return F.rank().over(Window.partitionBy(*groups).orderBy(F.desc(value))).cast("bigint")


def table_order(groups: list[str], value: str, name: str) -> Column:
    """Position by falling value, ties by name."""
    return F.row_number().over(Window.partitionBy(*groups).orderBy(F.desc(value), name)).cast("bigint")


def movement(df: DataFrame, groups: list[str], week: str, member: str, value: str) -> DataFrame:
    """Ranks this week and the week before among members of both weeks, and the places gained; others have no row."""
    before = df.select(*groups, (F.col(week) + 1).alias(week), member, F.col(value).alias("_before"))
    both = df.join(before, [*groups, week, member])
    ranked = places.competition_places(places.competition_places(both, [*groups, week], value, "rank_now"), [*groups, week], "_before", "rank_before")
    return ranked.withColumn("moved", F.col("rank_before") - F.col("rank_now")).drop("_before")


def at_extremes(df: DataFrame, groups: list[str], value: str) -> DataFrame:
    """Whether a row has its group's largest or smallest value (ties all have)."""
    w = places.with_extremes(df, groups, value, "_most", "_least")
    return w.withColumn("is_win", F.col(value) == F.col("_most")).withColumn("is_flop", F.col(value) == F.col("_least")).drop("_most", "_least")


def trailing_streak(df: DataFrame, member: str, week: str, flag: str) -> DataFrame:
    """Length of the run of consecutive weeks with the flag that ends at each row; a missing week breaks it."""
    w = Window.partitionBy(member).orderBy(week)
    breaks = F.when(~F.col(flag), F.col(week)).when(F.coalesce(F.lag(week).over(w), F.col(week) - 2) != F.col(week) - 1, F.col(week) - 1)
    df = df.withColumn("_break", breaks)
    return df.withColumn("streak", (F.col(week) - F.max("_break").over(w.rowsBetween(Window.unboundedPreceding, 0))).cast("bigint")).drop("_break")


def personal_best(df: DataFrame, member: str, week: str, rank: str, least: int = 3) -> DataFrame:
    """Whether a rank is better than all earlier ones, or worse, once there are so many weeks."""
    w = Window.partitionBy(member).orderBy(week)
    earlier = w.rowsBetween(Window.unboundedPreceding, -1)
    enough = F.row_number().over(w) >= least
    return df.withColumn("is_best", enough & (F.col(rank) < F.min(rank).over(earlier))).withColumn("is_worst", enough & (F.col(rank) > F.max(rank).over(earlier)))


def swaps(df: DataFrame, groups: list[str], week: str, member: str, value: str) -> DataFrame:
    """Pairs of a league whose order by value was reversed since the week before. The equi-join on league and week keeps pairs inside a league."""
    before = df.select(*groups, (F.col(week) + 1).alias(week), member, F.col(value).alias("was"))
    both = df.join(before, [*groups, week, member]).select(*groups, week, member, F.col(value).alias("now"), "was")
    a, b = both.alias("a"), both.alias("b")
    keys = [*groups, week]
    joined = a.join(b, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys] + [F.col("a.was") < F.col("b.was"), F.col("a.now") > F.col("b.now")])
    return joined.select(*[F.col(f"a.{k}").alias(k) for k in keys], F.col(f"a.{member}").alias("ahead"), F.col(f"b.{member}").alias("behind"))


def podium_changes(df: DataFrame, groups: list[str], week: str, member: str, value: str, n: int = 3) -> DataFrame:
    """Members that entered or left the first places since the week before."""
    top = df.withColumn("place", table_order([*groups, week], value, member)).where(F.col("place") <= n).select(*groups, week, member, "place")
    weeks = df.select(*groups, week).distinct()
    old = top.select(*groups, (F.col(week) + 1).alias(week), member, F.col("place").alias("place_before")).join(weeks, [*groups, week], "left_semi")
    known = weeks.select(*groups, (F.col(week) + 1).alias(week))
    joined = top.join(known, [*groups, week], "left_semi").join(old, [*groups, week, member], "full_outer")
    return joined.where(F.col("place").isNull() | F.col("place_before").isNull()).withColumn("kind", F.when(F.col("place").isNotNull(), "entered").otherwise("left"))


def podium_events(df: DataFrame, groups: list[str], week: str, member: str, value: str, n: int = 3) -> DataFrame:
    """What happened to the first places since the week before, where the league had one: new_leader, entered, left, swap.

    other is the leader before, the n-th member out for the n-th in, or the one overtaken, if still in the league; gap is the lead over it.
    One window a league and week orders the members; then only those of the first places of either week are gathered, at most 2 n.
    """
    g = [*groups, week]
    own = Window.partitionBy(*groups, member).orderBy(week)
    former = F.lag(week).over(own) == F.col(week) - 1
    placed = df.withColumn("place", table_order(g, value, member)).withColumn("rank_now", competition_rank(g, value))
    for name, source in (("place_before", "place"), ("rank_before", "rank_now")):
        placed = placed.withColumn(name, F.when(former, F.lag(source).over(own)))
    known = df.select(*groups, (F.col(week) + 1).alias(week)).distinct()
    either = placed.where((F.col("place") <= n) | (F.col("place_before") <= n)).join(known, g, "left_semi")
    man = F.struct(F.col("place"), F.col("place_before"), F.col(member).alias("member"), F.col(value).alias("value"))
    either = either.withColumn("_all", F.collect_list(man).over(Window.partitionBy(*g)))
    inside, outside = lambda c: c <= n, lambda c: c.isNull() | (c > n)
    fresh = lambda x: inside(x["place"]) & outside(x["place_before"])
    me = {c: F.col(c) for c in ("place", "place_before")}
    old_leader = F.filter("_all", lambda x: x["place_before"] == 1)
    out = F.transform(F.array_sort(F.transform(F.filter("_all", lambda x: inside(x["place_before"]) & outside(x["place"])), lambda x: F.struct(x["place_before"], x.alias("man")))), lambda x: x["man"])
    turn = F.size(F.filter("_all", lambda x: fresh(x) & (x["place"] < me["place"])))
    new_leader = (me["place"] == 1) & (me["place_before"].isNull() | (me["place_before"] != 1))
    passed = F.filter("_all", lambda x: inside(x["place"]) & inside(x["place_before"]) & inside(me["place"]) & inside(me["place_before"]) & (x["place"] > me["place"]) & (x["place_before"] < me["place_before"]) & ~((me["place"] == 1) & (x["place_before"] == 1)))
    one = lambda kind, when, other: F.when(when, F.array(F.struct(F.lit(kind).alias("kind"), other.alias("man"))))
    nobody = F.get(F.filter("_all", lambda x: F.lit(False)), F.lit(0))
    events = [
        one("new_leader", new_leader, F.get(old_leader, F.lit(0))),
        one("entered", fresh(me), F.get(out, turn)),
        one("left", inside(me["place_before"]) & outside(me["place"]), nobody),
        F.transform(passed, lambda x: F.struct(F.lit("swap").alias("kind"), x.alias("man"))),
    ]
    events = F.flatten(F.array_compact(F.array(*events)))
    other = F.col("_event.man.member")
    return either.withColumn("_event", F.explode(events)).select(*g, member, F.col("_event.kind").alias("kind"), "rank_before", "rank_now", other.alias("other"), (F.col(value) - F.col("_event.man.value")).alias("gap"))


def last_unskipped(df: DataFrame, member: str, week: str, flag: Column) -> DataFrame:
    """The latest earlier week whose row isn't skipped."""
    w = Window.partitionBy(member).orderBy(week).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("week_before", F.last(F.when(~flag, F.col(week)), True).over(w))
