"""Every query of the catalogue against its SQL on DuckDB."""

from pathlib import Path

import duckdb
import pytest

from tests.conftest import SF
from tidemark.plans.catalogue import QUERIES, SQL


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def test_all_have_sql():
    assert QUERIES.keys() == SQL.keys()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF)
    want = duck.sql(SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(got.columns)
    rows = [tuple(r[c] for c in order) for r in got.collect()]
    at = [want.columns.index(c) for c in order]
    assert sorted(rows, key=repr) == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=repr)


def test_many_rows_in_one_commit_on_a_table_with_their_keys(spark, duck, tmp_path):
    """The table of 60 times sf0.1 has keys of the range that is inserted; the SQL keeps both rows."""
    duck.sql(f"COPY (SELECT * REPLACE (o_orderkey + 999900 AS o_orderkey) FROM orders) TO '{tmp_path}/orders.parquet'")
    QUERIES["atomic_multichunk"](spark, str(tmp_path)).write.parquet(f"{tmp_path}/got")
    want = SQL["atomic_multichunk"].replace("FROM orders", f"FROM '{tmp_path}/orders.parquet'")
    got = f"SELECT k, v FROM '{tmp_path}/got/*.parquet'"
    assert duck.sql(f"SELECT count(*) FROM (SELECT k FROM ({want}) GROUP BY k HAVING count(*) > 1)").fetchall() == [(1400,)]
    assert duck.sql(f"({got} EXCEPT ALL ({want})) UNION ALL (({want}) EXCEPT ALL {got})").fetchall() == []


def test_filters_reach_the_scan(spark):
    from tidemark.operators import lookup, overlay
    from tidemark.plans.catalogue import log

    stored = spark.read.parquet(f"{SF}/orders.parquet").selectExpr("o_orderkey AS k", "o_custkey AS v")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_orderkey,5)" in plan(lookup.point_get(stored, 5))
    assert "In(o_orderkey" in plan(lookup.multi_get(stored, range(30)))
    over = overlay.overlay(stored, overlay.net_effect(log(spark)))
    text = plan(lookup.point_get(over, 5))
    assert "EqualTo(o_orderkey,5)" in text and "FullOuter" not in text


def test_few_requests_do_not_move_the_table(spark):
    """Each plan that meets a small batch filters the table where it lies."""
    from tidemark.functions.schema import local
    from tidemark.operators import batch, lookup, overlay
    from tidemark.plans.catalogue import BAD_LOG, LOG, REQUESTS, log

    stored = spark.read.parquet(f"{SF}/orders.parquet").selectExpr("o_orderkey AS k", "o_custkey AS v")
    few = local(spark, [(0, 5), (1, 7)], "req_id long, k long")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for df in (lookup.find_many(stored, few), batch.answers(stored, log(spark, REQUESTS)), overlay.classified(stored, log(spark, LOG)), overlay.violations(stored, log(spark, BAD_LOG))):
            lines = df._jdf.queryExecution().executedPlan().toString().split("\n")
            scan = next(i for i, x in enumerate(lines) if "FileScan parquet" in x)
            above = [x for x in lines[:scan] if x.index(x.lstrip(" :+-*")) < lines[scan].index(lines[scan].lstrip(" :+-*"))]
            joins = [i for i, x in enumerate(above) if "BroadcastHashJoin" in x and "LeftSemi" in x]
            assert joins and not any("Exchange" in x for x in above[joins[-1] :])
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_repeated_keys_in_an_upsert(spark):
    from tidemark.operators import dml

    make = lambda rows: spark.createDataFrame(rows, "k long, v long")
    assert sorted(map(tuple, dml.upsert(make([(1, 1), (2, 2)]), make([(1, 5), (1, 9), (3, 3)])).collect())) == [(1, 9), (2, 2), (3, 3)]
