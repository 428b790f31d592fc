"""Queries on whole tables."""

from touchline.plans import analysis, league
from touchline.sources.tables import table

SF = "/root/testdata/sf0.001"


def test_overlaps_of_all_suppliers(spark):
    spans = {}
    for r in table(spark, SF, "lineitem").select("l_suppkey", "l_orderkey", "l_shipdate").collect():
        spans.setdefault((r[0], r[1]), []).append(r[2])
    by = {}
    for (s, o), days in spans.items():
        if len(days) > 1:
            by.setdefault(s, []).append((o, min(days), max(days)))
    want = {(s, o, p) for s, x in by.items() for o, a, b in x for p, c, d in x if o < p and a < d and c < b}
    assert {tuple(r) for r in league.interval_overlap(spark, SF).collect()} == want
    assert any(s % 10 for s, _, _ in want)


def test_searches_for_every_hundredth_row(spark):
    ids = {r[0] for r in table(spark, SF, "embeddings").where("vec_id % 100 = 0").select("vec_id").collect()}
    got = [(r["q"], r["place"]) for r in analysis.cosine_topk(spark, SF).collect()]
    assert len(ids) > 1 and sorted(got) == [(q, p) for q in sorted(ids) for p in range(1, 51)]
    assert {r["q"] for r in analysis.recall_mrr(spark, SF).collect()} == ids


def test_swings_of_every_nation(spark):
    nation = {r[0]: r[1] for r in table(spark, SF, "customer").select("c_custkey", "c_nationkey").collect()}
    rows = table(spark, SF, "lineitem").join(table(spark, SF, "orders").withColumnRenamed("o_orderkey", "l_orderkey"), "l_orderkey").select("o_custkey", "l_partkey", "l_quantity").collect()
    have = {}
    for c, p, n in rows:
        have.setdefault(c, {})[p] = have.get(c, {}).get(p, 0) + int(n)
    want = set()
    for n in set(nation.values()):
        own = sorted(c for c in nation if nation[c] == n)
        for a, b in zip(own, own[1:], strict=False):
            x, y = have.get(a, {}), have.get(b, {})
            want |= {(a, b, p, x.get(p, 0) - y.get(p, 0)) for p in {*x, *y} if x.get(p, 0) != y.get(p, 0)}
    assert {tuple(r) for r in analysis.pair_swings(spark, SF).collect()} == want
