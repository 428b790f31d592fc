"""Faults that the reviewer of round 4 found, each on small tables, against a plain form or the SQL."""

from pyspark.sql import DataFrame

from touchline.operators import textindex
from touchline.plans import facts, retrieval
from touchline.sources import store

from test_round3 import both


def test_search_writes_no_pairs_of_queries_and_terms(spark, tmp_path, monkeypatch):
    """80 queries ask for a stem that 90 terms begin with: their 7,200 pairs were rows of a table before."""
    docs = spark.createDataFrame([(i, f"cat{i} cat{i}x rivers cat", None) for i in range(45)], "id long, text string, at timestamp_ntz")
    asked = spark.createDataFrame([(q, f"cat catz{q} ri rivers river{q}") for q in range(80)], "q long, text string")
    textindex.add(docs, str(tmp_path / "index"), "id", "text", "at")
    sizes = []

    def counted(df: DataFrame) -> DataFrame:
        out = store.written(df)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(textindex, "written", counted)
    found = textindex.search(str(tmp_path / "index"), asked, depth=3).select("q", "place", "id", "covers").collect()
    assert sorted(tuple(r) for r in found) == [(q, k + 1, 44 - k, 4) for q in range(80) for k in range(3)]  # "cat" and "catz1" are one cover for "cat"
    assert max(sizes) <= 80 * 5


def test_packs_hold_every_posting_and_compaction_leaves_dead_documents_out(spark, tmp_path):
    path, to = str(tmp_path / "index"), str(tmp_path / "compact")
    rows = lambda texts: spark.createDataFrame([(i, x, None) for i, x in texts.items()], "id long, text string, at timestamp_ntz")
    textindex.add(rows({1: "bridge of stone, bridge", 2: "river stone", 3: None}), path, "id", "text", "at")
    held = lambda p: sorted((r["doc"], r["term"], r["places"]) for r in spark.read.parquet(f"{p}/postings").select(*(x.split()[0] for x in textindex.PACK.split(", "))).mapInArrow(textindex._rows, "bucket int, batch int, term string, doc bigint, places array<int>").collect())
    assert held(path) == [(1, "bridge", [0, 3]), (1, "stone", [2]), (2, "river", [0]), (2, "stone", [1])]
    textindex.add(rows({2: "stone stone"}), path, "id", "text", "at")
    textindex.remove(spark.createDataFrame([(1,)], "id long"), path, "id")
    textindex.compact(spark, path, to)
    assert held(to) == [(2, "stone", [0, 1])]
    assert [tuple(r) for r in textindex.term_counts(spark, to).collect()] == [("stone", 1, 2)]


def test_an_index_without_any_term_is_searched(spark, tmp_path):
    textindex.add(spark.createDataFrame([(1, None, None)], "id long, text string, at timestamp_ntz"), str(tmp_path / "index"), "id", "text", "at")
    assert textindex.search(str(tmp_path / "index"), spark.createDataFrame([(1, "bridge")], "q long, text string")).collect() == []


def test_a_bucket_whose_postings_meet_no_word(spark, tmp_path):
    """The word's bucket is read, and nothing there begins with it."""
    textindex.add(spark.createDataFrame([(1, "cat cats", None)], "id long, text string, at timestamp_ntz"), str(tmp_path / "index"), "id", "text", "at")
    asked = spark.createDataFrame([(1, "catnip"), (2, "ca"), (3, "ca cat")], "q long, text string")
    assert [tuple(r)[:4] for r in textindex.search(str(tmp_path / "index"), asked).collect()] == [(3, 1, 1, 2)]


def test_each_leg_of_a_mode_is_searched_once(spark):
    """The legs are tables when they are fused; before, what counts the legs and what fuses them searched once each."""
    for name in ("fulltext_mode", "hybrid_search"):
        assert "MapInArrow" not in retrieval.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()


def test_member_rows_add_orders_whose_keys_are_null_or_repeat(spark, tmp_path):
    """Every order counts: before, one key for several orders left some out, and orders without a key gave no total."""
    orders = "SELECT CASE WHEN i % 3 = 0 THEN NULL WHEN i % 3 = 1 THEN i // 8 ELSE i END AS o_orderkey, i % 7 AS o_custkey, 'P' AS o_orderstatus, i + 0.25::DOUBLE AS o_totalprice FROM range(96) r(i) UNION ALL SELECT NULL, 8, 'O', 5"
    got, want = both(spark, tmp_path, facts, "member_rows", customer="SELECT i AS c_custkey, 1.5::DOUBLE AS c_acctbal FROM range(10) r(i)", orders=orders)
    assert got == want and len(got) == 8
