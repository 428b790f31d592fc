"""Overlaps and containment against all pairs, and the number of candidates."""

import datetime
import random

from pyspark.sql import functions as F

from touchline.operators import asof, containment

T = datetime.datetime(2024, 1, 1)
SPANS = "k string, id long, a timestamp_ntz, b timestamp_ntz"


def spans(rows, spark):
    at = lambda h: None if h is None else T + datetime.timedelta(hours=h)
    return spark.createDataFrame([(k, i, at(a), at(b)) for k, i, a, b in rows], SPANS)


def test_overlaps_against_all_pairs(spark):
    rng = random.Random(4)
    rows = [(rng.choice("ab"), i, a, a + rng.choice([0, 0, 1, 5, 24, 30, 200, 3000])) for i, a in ((i, rng.randrange(-500, 4000)) for i in range(250))]
    rows += [("a", 1000 + i, 100, 130) for i in range(4)] + [("a", 2000, None, 5), ("b", 2001, 5, None), (None, 2002, 0, 9), (None, 2003, 0, 9)]
    known = [r for r in rows if None not in r]
    want = {(k, *sorted(((a, i), (c, j)))[0][1:], *sorted(((a, i), (c, j)))[1][1:]) for k, i, a, b in known for x, j, c, d in known if k == x and i != j and a < d and c < b}
    assert {tuple(r) for r in asof.overlaps(spans(rows, spark), ["k"], "id", "a", "b").collect()} == want
    assert asof.overlaps(spans(rows, spark).where("false"), ["k"], "id", "a", "b").collect() == []


def test_one_long_and_many_short_spans(spark):
    """Two thousand spans of a few hours and one of years: candidates stay near the result, where all pairs are two millions."""
    rows = [("k", i, 24 * i, 24 * i + 5) for i in range(2000)] + [("k", 9999, 0, 24 * 2000)]
    df = spans(rows, spark)
    result, met = asof.overlaps(df, ["k"], "id", "a", "b").count(), asof.met_spans(df, ["k"], "id", "a", "b").count()
    assert result == 2000 and met <= 2 * result


def test_containment_against_all_pairs(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(12)]
    rows = [(rng.choice("ab"), i, ["hot"] * (i % 3 == 0) + [rng.choice(words) for _ in range(rng.randrange(5))]) for i in range(300)] + [("a", 900, None), ("a", 901, [None]), ("a", 902, []), ("b", 903, ["w1", None, "w1"])]
    df = spark.createDataFrame(rows, "g string, id long, w array<string>")
    c = containment.classes(df, ["g"], "w", "id")
    sets = {}
    for g, i, w in rows:
        if s := frozenset(x for x in w or () if x is not None):
            sets.setdefault((g, s), []).append(i)
    assert {(r["g"], frozenset(r["elements"]), r["n"], r["least"]) for r in c.collect()} == {(g, s, len(x), min(x)) for (g, s), x in sets.items()}
    want = {(g, s, t, len(x), len(y)) for (g, s), x in sets.items() for (h, t), y in sets.items() if g == h and s < t}
    got = {(r["g"], frozenset(r["part"]), frozenset(r["whole"]), r["n_part"], r["n_whole"]) for r in containment.within(c, ["g"]).collect()}
    assert got == want and len(want) > 50


def test_candidates_grow_with_the_elements(spark):
    """Sets that share a frequent element and have one of their own: met once each at their own, never at the frequent one."""
    df = spark.range(3000).select(F.lit(1).alias("g"), "id", F.array(F.lit("all"), F.concat(F.lit("own"), "id")).alias("w"))
    df = df.unionByName(spark.range(3000).select(F.lit(1).alias("g"), (F.col("id") + 5000).alias("id"), F.array(F.lit("all"), F.concat(F.lit("own"), "id"), F.lit("more")).alias("w")))
    assert containment.within(containment.classes(df, ["g"], "w", "id"), ["g"]).count() == 3000
