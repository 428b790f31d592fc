"""Line-ups: automatic substitutions as a fold over the starters, transfers as pairs of neighbouring rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def counted(starters: str, bench: str, limits: dict[str, tuple[int, int]], keeper: str = "K") -> Column:
    """The eleven after substitutions, by names of array columns of struct<role, played, ...>.

    Each starter who did not play, in order, gives his place to the first substitute left who played and fits: one of his own role,
    or, keepers apart, one whose change leaves both roles within their limits (least, most). Null starters give null, a null bench nobody.
    """
    bound = lambda man, side, default: f"CASE {man}.role " + " ".join(f"WHEN '{r}' THEN {n[side]}" for r, n in limits.items()) + f" ELSE {default} END"
    number = lambda man: f"size(filter(acc.xi, z -> z.role = {man}.role))"
    change = f"c.man.role <> '{keeper}' AND b.role <> '{keeper}' AND {number('c.man')} > {bound('c.man', 0, 0)} AND {number('b')} < {bound('b', 1, 11)}"
    first = f"array_position(transform(acc.left, b -> b.played AND (b.role = c.man.role OR ({change}))), true)"
    swap = "struct(transform(acc.xi, (x, j) -> CASE WHEN j = c.i THEN element_at(acc.left, cast(p AS int)) ELSE x END) AS xi, filter(acc.left, (y, k) -> k + 1 <> p) AS left)"
    step = f"CASE WHEN c.man.played THEN acc ELSE transform(array({first}), p -> CASE WHEN p > 0 THEN {swap} ELSE acc END)[0] END"
    return F.expr(f"aggregate(transform({starters}, (s, i) -> struct(s AS man, i AS i)), struct({starters} AS xi, {bench} AS left), (acc, c) -> {step}, acc -> acc.xi)")


def armband(starters: str, bench: str, final: str) -> Column:
    """Points once more of the captain (armband 1) who played, else of the vice (armband 2) who did, if among those who count; else 0."""
    worn = f"filter(concat({starters}, {bench}), x -> x.armband = %d AND x.played)"
    return F.expr(f"aggregate(slice(concat({worn % 1}, {worn % 2}), 1, 1), 0D, (s, x) -> s + CASE WHEN array_contains({final}, x) THEN x.points ELSE 0D END)")


def lineups(df: DataFrame, squad: list[str], position: str, starters: int, player: list[str]) -> DataFrame:
    """squad, starters, bench: arrays of the players' structs in the order of position. A squad is a bounded group."""
    row = F.struct(position, *player)
    part = lambda c: F.transform(F.sort_array(F.collect_list(F.when(c, row))), lambda x: F.struct(*[x[p].alias(p) for p in player]))
    return df.groupBy(*squad).agg(part(F.col(position) <= starters).alias("starters"), part(F.col(position) > starters).alias("bench"))


def exchanges(df: DataFrame, keys: list[str], order: list[str], value: str, win: float) -> DataFrame:
    """Each row (in) against the row before it (out): gain, whether it missed (came out lower) and whether it won (by win or more)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    df = df.withColumn("out_value", F.lag(value).over(w)).where("out_value is not null").withColumn("gain", F.col(value) - F.col("out_value"))
    return df.withColumn("missed", F.col("gain") < 0).withColumn("won", F.col("gain") >= win)
