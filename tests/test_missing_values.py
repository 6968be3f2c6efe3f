"""Rows without an amount, a date or an owner, against the SQL."""

import duckdb
import pytest

from eventide.plans.all_queries import ORACLE, QUERIES


@pytest.fixture(scope="module")
def gaps(tmp_path_factory, sf):
    folder = tmp_path_factory.mktemp("gaps")
    con = duckdb.connect()
    lines = "CASE WHEN l_orderkey % 3 = 0 THEN NULL ELSE l_quantity END AS l_quantity, CASE WHEN l_orderkey % 5 = 0 THEN NULL ELSE l_partkey END AS l_partkey"
    orders = "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderdate END AS o_orderdate, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_custkey END AS o_custkey"
    for name, columns in (("lineitem", lines), ("orders", orders)):
        con.sql(f"COPY (SELECT * REPLACE ({columns}) FROM '{sf}/{name}.parquet') TO '{folder}/{name}.parquet' (FORMAT parquet)")
    return str(folder)


def agrees(spark, name, folder, *tables):
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in tables:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    rel = con.sql(ORACLE[name])
    got = sorted(map(str, (tuple(r) for r in QUERIES[name](spark, folder).select(*rel.columns).collect())))
    assert got == sorted(map(str, rel.fetchall())) and got


@pytest.mark.parametrize("name", ["m12_wallet_pnl", "m10_taker_maker_pnl", "b18_taker_fee", "m13_consistent_winners", "m14_sign_randomised_null"])
def test_fills_with_gaps(spark, gaps, name):
    agrees(spark, name, gaps, "lineitem", "orders")


def test_risk_state_of_trades_without_result_or_time(spark, sf, tmp_path):
    columns = "CASE WHEN event_id % 5 = 0 THEN NULL ELSE value END AS value, CASE WHEN event_id % 17 = 0 THEN NULL ELSE ts END AS ts"
    duckdb.connect().sql(f"COPY (SELECT * REPLACE ({columns}) FROM '{sf}/events.parquet') TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    agrees(spark, "r8_account_risk_state", str(tmp_path), "events")
