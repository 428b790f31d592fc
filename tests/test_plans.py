"""Every query of the library's own plans against its SQL in DuckDB, over the smallest tables."""

import datetime
import decimal

import duckdb
import pytest

from touchline.plans import alerts, analysis, archives, chips, corroboration, facts, league, posts, reports, retrieval, squads, tables

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
PAIRS = [(name, plan) for plan in (league, analysis, squads, posts, facts, alerts, reports, retrieval, corroboration, tables, chips, archives) for name in plan.ORACLE]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, (float, decimal.Decimal)):
        return f"{float(x):.6g}"
    if isinstance(x, datetime.datetime):
        return x.isoformat()
    return str(x)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return [names[k] for k in order], sorted(tuple(plain(r[k]) for k in order) for r in data)


@pytest.mark.parametrize(("name", "plan"), PAIRS, ids=[n for n, _ in PAIRS])
def test_against_sql(spark, duck, name, plan):
    got = plan.QUERIES[name](spark, SF)
    want = duck.execute(plan.ORACLE[name])
    names = [c[0] for c in want.description]
    assert rows(got.columns, got.collect()) == rows(names, want.fetchall())
