"""Corroboration of all topics at once against a loop over topics, and the cases that each branch needs."""

import datetime

import pytest
from pyspark.sql import functions as F

from touchline.operators import corroboration as ops
from touchline.operators import rules
from touchline.plans import corroboration as plans

T = datetime.datetime(2024, 1, 1)
#: topic: claims (hour, id, type), flags (hour, id, status), chosen id, expected (anchor, reversed claim, reversed flag, way).
CASES = {
    "newest": ([(1, 1, "out"), (2, 2, "doubt")], [], None, (2, None, None, "claim")),
    "reverses": ([(1, 1, "available"), (2, 2, "out")], [], None, (2, 1, None, "claim")),
    "same time": ([(1, 1, "benched"), (1, 2, "out")], [], None, (2, 1, None, "claim")),
    "back": ([(1, 1, "out"), (2, 2, "available")], [(0, 1, "i")], None, (2, 1, None, "claim reversed")),
    "only the newest older": ([(1, 1, "out"), (2, 2, "benched"), (3, 3, "available")], [], None, (2, 1, None, "fallback")),
    "flag": ([(5, 1, "available")], [(1, 1, "a"), (2, 2, "d"), (6, 3, "a")], None, (1, None, 2, "flag reversed")),
    "flag at the moment": ([(5, 1, "available")], [(5, 7, "i"), (5, 8, "d")], None, (1, None, 8, "flag reversed")),
    "flag taken back": ([(5, 1, "available")], [(1, 1, "d"), (2, 2, "a")], None, (None, None, None, "none")),
    "later flag": ([(5, 1, "available")], [(6, 1, "i")], None, (None, None, None, "none")),
    "no flag": ([(5, 1, "available")], [], None, (None, None, None, "none")),
    "steps in": ([(1, 1, "confirmed_starter"), (2, 2, "available")], [], None, (1, None, None, "fallback")),
    "contradicted": ([(1, 1, "out"), (2, 2, "available"), (3, 3, "available")], [], None, (None, None, None, "none")),
    "chosen": ([(1, 1, "out"), (2, 2, "doubt")], [], 1, (1, None, None, "claim")),
    "chosen is no claim": ([(1, 1, "out"), (2, 2, "doubt")], [], 99, (2, None, None, "claim")),
    "chosen available isn't newest": ([(1, 1, "available"), (2, 2, "benched")], [(0, 1, "i")], 1, (2, None, None, "fallback")),
}


def _at(hour):
    return T + datetime.timedelta(hours=hour)


def test_every_way_of_an_anchor(spark):
    claims = spark.createDataFrame([(t, t, 1000 * k + i, _at(h), x) for k, (t, (c, *_)) in enumerate(CASES.items()) for h, i, x in c], "topic string, player string, post_id long, created timestamp_ntz, type string")
    flags = spark.createDataFrame([(t, 1000 * k + i, _at(h), s) for k, (t, (_, f, *_)) in enumerate(CASES.items()) for h, i, s in f], "player string, flag_id long, observed_at timestamp_ntz, status string")
    chosen = spark.createDataFrame([(t, t, 1000 * k + i) for k, (t, (_, _, i, _)) in enumerate(CASES.items()) if i], "topic string, player string, chosen_id long")
    got = {r["topic"]: (r["anchor_id"], r["reversed_claim"], r["reversed_flag"], r["way"]) for r in ops.choose_anchor(claims, flags, ["topic", "player"], "player", chosen).collect()}
    for k, (t, case) in enumerate(CASES.items()):
        assert got[t] == tuple(1000 * k + x if isinstance(x, int) else x for x in case[3]), t


def test_no_claims_no_anchors(spark):
    empty = spark.createDataFrame([], "player long, post_id long, created timestamp_ntz, type string")
    flags = spark.createDataFrame([(1, 1, T, "i")], "player long, flag_id long, observed_at timestamp_ntz, status string")
    assert ops.choose_anchor(empty, flags, ["player"], "player").collect() == []


def test_accounts_count_once(spark):
    """The newest post of each account; a quoted account counts unless the post contradicts; the anchor's accounts don't count."""
    posts = [  # id, hour, author, quoted, label, origin
        (1, 1, "a", "q", "supports", "sql"), (2, 2, "b", None, "supports", "sql"), (3, 3, "b", None, "contradicts", "judge"), (4, 4, "c", "b", "contradicts", "sql"), (5, 5, "d", "e", "supports", "sql"),
        (6, 6, "f", "q", "supports", "sql"), (7, 7, "a", None, "contradicts", "sql"), (8, 8, "g", None, "unrelated", "judge"), (9, 9, "h", None, "related", "judge"), (10, 10, "i", "a", "related", "sql"),
    ]
    labelled = spark.createDataFrame([(1, i, _at(h), a, q, x, o) for i, h, a, q, x, o in posts], "t int, post_id long, created timestamp_ntz, author string, quoted string, label string, origin string")
    anchors = spark.createDataFrame([(1, 1, "a", "q")], "t int, anchor_id long, anchor_author string, anchor_quoted string")
    got = {(r["side"], r["account"], r["post_id"]) for r in ops.account_lists(labelled, anchors, ["t"]).collect()}
    assert got == {("contradicting", "b", 3), ("contradicting", "c", 4), ("supporting", "e", 5), ("related", "h", 9), ("related", "a", 10)}


@pytest.mark.parametrize(
    ("certainty", "rows", "want"),
    [
        ("rumour", [], ("low", "little")),
        ("likely", [], ("medium", "likely")),
        ("rumour", [("supporting", 1, "sql")], ("medium", "weight")),
        ("rumour", [("supporting", 1, "sql")] * 2, ("high", "weight")),
        ("confirmed", [("supporting", 1, "sql")], ("high", "confirmed with support")),
        ("confirmed", [("supporting", 1, "sql")] * 2 + [("contradicting", 9, "sql")], ("medium", "confirmed with support,weight;new contradiction")),
        ("likely", [("contradicting", 4, "judge")], ("low", "likely;newer contradiction")),
        ("likely", [("contradicting", 4, "sql")], ("medium", "likely")),  # neither new since the last look nor judged
        ("likely", [("contradicting", 3, "judge")], ("medium", "likely")),  # not after the anchor
        ("rumour", [("contradicting", 9, "judge")], ("low", "little;new contradiction,newer contradiction,already low")),
    ],
)
def test_grades_and_reasons(spark, certainty, rows, want):
    lists = spark.createDataFrame([(1, s, f"x{k}", k, _at(h), o) for k, (s, h, o) in enumerate(rows)], "t int, side string, account string, post_id int, created timestamp_ntz, origin string")
    anchors = spark.createDataFrame([(1, certainty, _at(3), _at(5))], "t int, certainty string, anchor_at timestamp_ntz, new_since timestamp_ntz")
    r = ops.graded(lists, anchors, ["t"], F.lit(1)).first()
    assert (r["grade"], r["reasons"]) == want


def test_all_branches_occur_in_the_queries(spark):
    """What the SQL comparison covers at sf0.01, where the driver makes it."""
    sf = "/root/testdata/sf0.01"
    ways = {(r["way"], r["reversed_claim"] is not None, r["reversed_flag"] is not None) for r in plans.anchor_chosen(spark, sf).collect()}
    assert ways >= {("claim", True, False), ("claim", False, False), ("claim reversed", True, False), ("flag reversed", False, True), ("fallback", False, False), ("none", False, False)}
    reasons = ",".join(r["reasons"] for r in plans.corroboration_graded(spark, sf).collect())
    for x in ("confirmed with support", "weight", "likely", "little", "new contradiction", "newer contradiction", "already low"):
        assert x in reasons


def test_label_pairs():
    assert len(rules.CONTRADICT) == 6
