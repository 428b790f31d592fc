"""Tables that are written or refused as a whole, and bad fields by name."""

import pytest
from pyspark.sql import functions as F

from touchline.sources import refusal
from touchline.sources.tables import table, weekly

SF = "/root/testdata/sf0.001"


def sheet_rules():
    points, total, members = F.col("points"), F.col("total"), F.col("members")
    rank = F.col("place")
    return {
        "no league": F.col("league").isNull(), "no manager": F.col("manager").isNull(), "no week": F.col("gw").isNull(), "no points": points.isNull(), "no total": total.isNull(), "points below zero": points < 0, "total below zero": total < 0,
        "total below the week's points": total < points, "total isn't the sum": total != F.coalesce("before", F.lit(0)) + points, "first week has a total before": F.col("before").isNull() & (total != points),
        "points above the best": points > F.col("top_points"), "average above the best": F.col("average") > F.col("top_points"), "average below the worst": F.col("average") < F.col("low_points"), "no members": members < 1,
        "place below one": rank < 1, "place beyond the members": rank > members, "leader behind": (rank == 1) & (F.col("gap") != 0), "gap of others is zero above the leader": F.col("gap") < 0,
        "gap doesn't match": F.col("gap") != F.col("top_total") - total, "winner without the best points": F.col("is_win") & (points != F.col("top_points")), "best points without a win": ~F.col("is_win") & (points == F.col("top_points")), "month out of range": F.col("gw") % 12 > 11,
    }


def sheet(spark):
    from pyspark.sql import Window

    w = weekly(spark, SF)
    g = Window.partitionBy("league", "gw")
    own = Window.partitionBy("manager").orderBy("gw")
    w = w.withColumns({"before": F.lag("total").over(own), "top_points": F.max("points").over(g), "low_points": F.min("points").over(g), "top_total": F.max("total").over(g), "average": F.avg("points").over(g), "members": F.count("*").over(g)})
    return w.withColumns({"place": F.rank().over(g.orderBy(F.desc("total"))), "gap": F.col("top_total") - F.col("total"), "is_win": F.col("points") == F.col("top_points")})


def test_a_clean_sheet_is_written(spark, tmp_path):
    path, rules = str(tmp_path / "sheet"), sheet_rules()
    assert len(rules) >= 20
    df = sheet(spark)
    got = refusal.write_checked(df, path, rules)
    assert got["rows"] == df.count() == spark.read.parquet(path).count() and not any(got[r] for r in rules)
    with pytest.raises(FileExistsError):
        refusal.write_checked(df, path, rules)


@pytest.mark.parametrize(
    ("change", "broken"),
    [
        ({"total": "total + 1"}, "total isn't the sum"), ({"points": "CAST(NULL AS BIGINT)"}, "no points"), ({"points": "-points"}, "points below zero"), ({"place": "members + 1"}, "place beyond the members"), ({"gap": "gap + 1"}, "leader behind"),
        ({"is_win": "NOT is_win"}, "best points without a win"), ({"average": "top_points + 1"}, "average above the best"), ({"league": "CAST(NULL AS BIGINT)"}, "no league"), ({"members": "0"}, "no members"), ({"gap": "-1"}, "gap of others is zero above the leader"),
    ],
)
def test_one_planted_row_refuses_the_sheet(spark, tmp_path, change, broken):
    df = sheet(spark)
    one = df.orderBy("league", "gw", "place").select("manager", "gw").first()
    here = f"manager = {one['manager']} AND gw = {one['gw']}"
    bad = df.selectExpr(*[f"CASE WHEN {here} THEN {change[c]} ELSE {c} END AS {c}" if c in change else c for c in df.columns])
    with pytest.raises(refusal.Refused) as told:
        refusal.write_checked(bad, str(tmp_path / "sheet"), sheet_rules())
    assert told.value.broken[broken] == 1 and broken in str(told.value)
    assert not list(tmp_path.glob("sheet*"))  # neither the table nor what was written aside


def test_too_few_rows(spark, tmp_path):
    with pytest.raises(refusal.Refused, match="too few rows: 5"):
        refusal.write_checked(table(spark, SF, "region"), str(tmp_path / "r"), {}, least_rows=6)


def test_bad_fields_by_name(spark):
    rows = [
        (1, '{"id": 5, "name": "a", "score": 1.5}', []), (2, '{"id": "x", "name": "a"}', ["id"]), (3, '{"name": 7.5, "score": "high"}', ["id", "score"]), (4, "[1, 2]", ["json"]), (5, "{broken", ["json"]), (6, None, ["json"]),
        (7, '{"id": null, "name": null}', ["id"]), (8, '{"id": 5, "extra": {}}', []),
    ]
    df = spark.createDataFrame([(i, raw) for i, raw, _ in rows], "k int, raw string")
    faults = refusal.bad_fields("raw", "id bigint, name string, score double", ("id",))
    assert {r["k"]: r["f"] for r in df.select("k", faults.alias("f")).collect()} == {i: want for i, _, want in rows}
    assert refusal.refuse(df.where("k in (1, 8)"), faults, F.col("k")).count() == 2
    with pytest.raises(Exception, match="row 3: id, score"):
        refusal.refuse(df.where("k in (1, 3)"), faults, F.col("k")).collect()
