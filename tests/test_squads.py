"""The substitution fold against a loop."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from touchline.operators import ranks, squads
from touchline.plans.squads import WHATIF_LIMITS, squad_whatif

SF = "/root/testdata/sf0.001"
TYPE = "array<struct<role: string, played: boolean, points: double>>"


def by_loop(starters, bench, limits):
    xi, left = list(starters), list(bench)
    for i, x in enumerate(starters):
        if x[1]:
            continue
        for b in left:
            after = [y[0] for y in [*xi[:i], b, *xi[i + 1 :]]]
            fits = x[0] == b[0] or ("K" not in (x[0], b[0]) and after.count(x[0]) >= limits[x[0]][0] and after.count(b[0]) <= limits[b[0]][1])
            if b[1] and fits:
                xi[i] = b
                left.remove(b)
                break
    return xi


def test_counted(spark):
    rng = random.Random(5)
    man = lambda role: (role, rng.random() < 0.6, float(rng.randrange(20)))
    cases = [([man("K"), *[man(rng.choice("DMF")) for _ in range(10)]], [man("K"), *[man(rng.choice("DMF")) for _ in range(3)]]) for _ in range(300)]
    cases += [([], []), ([], [man("D")]), ([man("K")], [])]
    limits = {"K": (1, 1), "D": (3, 5), "M": (2, 5), "F": (1, 3)}
    df = spark.createDataFrame([(k, *c) for k, c in enumerate(cases)], f"k int, starters {TYPE}, bench {TYPE}")
    got = {r["k"]: [tuple(x) for x in r["final"]] for r in df.select("k", squads.counted("starters", "bench", limits).alias("final")).collect()}
    assert got == {k: by_loop(a, b, limits) for k, (a, b) in enumerate(cases)}
    nulls = spark.createDataFrame([(None, [man("D")])], f"starters {TYPE}, bench {TYPE}")
    assert nulls.select(squads.counted("starters", "bench", limits).alias("final")).first()["final"] is None


def test_upper_limits(spark):
    """A fourth forward may not come in for a midfielder; the defender behind him may."""
    man = lambda role, played=True: (role, played, 1.0)
    eleven = [man("K"), *[man("D")] * 3, *[man("M")] * 3, man("M", False), *[man("F")] * 3]
    bench = [man("K"), man("F"), man("D")]
    df = spark.createDataFrame([(eleven, bench), (eleven, None)], f"starters {TYPE}, bench {TYPE}")
    limits = {"K": (1, 1), "D": (3, 5), "M": (2, 5), "F": (1, 3)}
    got = [[x["role"] for x in r["final"]] for r in df.select(squads.counted("starters", "bench", limits).alias("final")).collect()]
    assert got == [[*"KDDDMMMDFFF"], [*"KDDDMMMMFFF"]]


def test_armband(spark):
    kind = "array<struct<role: string, played: boolean, points: double, armband: int>>"
    cases = [
        ([("M", True, 7.0, 1), ("F", True, 5.0, 2)], [], 7.0),
        ([("M", False, 0.0, 1), ("F", True, 5.0, 2)], [], 5.0),
        ([("M", False, 0.0, 1), ("F", False, 0.0, 2)], [], 0.0),
        ([("F", True, 5.0, 2)], [("M", True, 7.0, 1)], 0.0),  # the captain played, but does not count
        ([], [], 0.0),
    ]
    df = spark.createDataFrame(cases, f"starters {kind}, bench {kind}, want double")
    assert df.where(squads.armband("starters", "bench", "starters") != F.col("want")).count() == 0


def test_squad_whatif(spark):
    rows = spark.read.parquet(f"{SF}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity").collect()
    per = defaultdict(list)
    for order, line, supplier, q in rows:
        per[order].append((line, "K" if line in (1, 5) else "DMF"[supplier % 3], q > 10, q, {2: 1, 3: 2}.get(line, 0)))
    want = {}
    for order, men in per.items():
        men.sort()
        xi = by_loop([m[1:] for m in men if m[0] <= 4], [m[1:] for m in men if m[0] > 4], WHATIF_LIMITS)
        worn = [m[1:] for band in (1, 2) for m in men if m[4] == band and m[2]][:1]
        want[order] = (len(xi), sum(x[2] for x in xi if x[1]) + sum(x[2] for x in worn if x in xi))
    assert {r[0]: (r[1], r[2]) for r in squad_whatif(spark, SF).collect()} == want


def test_exchanges(spark):
    df = spark.createDataFrame([(1, 1, 5.0), (1, 2, 11.0), (1, 3, 10.0), (2, 1, 4.0)], "k int, n int, v double")
    got = squads.exchanges(df, ["k"], ["n"], "v", 6).orderBy("n").select("k", "n", "gain", F.col("missed"), "won").collect()
    assert [tuple(r) for r in got] == [(1, 2, 6.0, False, True), (1, 3, -1.0, True, False)]


def test_podium_events(spark):
    before, now = [9, 8, 7, 6, 5], {1: 10, 2: 8, 3: 11, 4: 12, 5: 6}
    rows = [("a", 1, k + 1, v) for k, v in enumerate(before)] + [("a", 2, k, v) for k, v in now.items()] + [("b", 2, 9, 1)]
    df = spark.createDataFrame(rows, "league string, gw int, who int, total int")
    got = ranks.podium_events(df, ["league"], "gw", "who", "total").select("who", "kind", "rank_before", "rank_now", "other", "gap").collect()
    # 4 comes from behind the podium: it enters and leads, but swaps with nobody
    want = [(4, "new_leader", 4, 1, 1, 2), (4, "entered", 4, 1, 2, 4), (2, "left", 2, 4, None, None), (3, "swap", 3, 2, 1, 1)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
