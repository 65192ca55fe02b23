"""Queries against their SQL on tables in which a case occurs that the test data lack."""

import re

import duckdb
import pytest

import __spark_entry__ as entry
from check_oracle import TABLES, compare
from small_data import SMALL


@pytest.fixture
def changed(tmp_path):
    """Tables of which one is replaced by the rows of a SQL text."""
    def make(name, text):
        con = duckdb.connect()
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
            if t != name:
                (tmp_path / f"{t}.parquet").symlink_to(f"{SMALL}/{t}.parquet")
        con.execute(f"COPY ({text}) TO '{tmp_path}/{name}.parquet'")
        con.execute(f"CREATE OR REPLACE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet')")
        return con, str(tmp_path)
    return make


def test_minute_bars_of_value_zero(spark, changed):
    con, folder = changed("events", "SELECT * REPLACE (CASE WHEN event_id % 5 = 0 THEN 0e0 ELSE value END AS value) FROM events")
    text, ok = compare(spark, con, folder, "validate_minute_bars")
    assert ok, text


def test_completeness_when_no_symbol_is_active(spark, changed):
    con, folder = changed("orders", """SELECT * FROM orders UNION ALL SELECT 10000000 + i, i, 'F', 1e0, TIMESTAMP '1999-02-28 00:00:00', '1-URGENT'
        FROM range(25) r(i) UNION ALL SELECT 20000000 + i, i, 'F', 1e0, t, '1-URGENT'
        FROM range(25) r(i), range(TIMESTAMP '1999-03-01', TIMESTAMP '1999-04-01', INTERVAL 1 DAY) s(t)""")
    assert con.execute("SELECT count(*) FROM orders WHERE o_orderkey >= 10000000").fetchone() == (800,)
    text, ok = compare(spark, con, folder, "kpi_symbol_completeness")
    assert ok, text


def test_strict_rules_read_a_text_and_a_list_once(spark):
    df = entry.queries()["strict_run_issues"](spark, SMALL)
    spark.conf.set("spark.sql.debug.maxToStringFields", 1000)
    try:
        plan = df._jdf.queryExecution().analyzed().toString()
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")
    assert [len(re.findall(p, plan)) for p in (r"parse_json\(extended#", r"transform\(symbols#", r"transform\(universe#")] == [1, 1, 1]


@pytest.mark.parametrize("name", ["micro_kpi_drift", "microstructure_observations", "tradability_state"])
def test_lines_are_reduced_to_bars_once(spark, name):
    df = entry.queries()[name](spark, SMALL)
    read = " ".join(df.inputFiles())
    # bars and lifecycle marks are stored; of the large tables only the events' orders are left
    assert "lineitem" not in read and "orders" in read
    spark.conf.set("spark.sql.debug.maxToStringFields", 1000)
    try:
        plan = df._jdf.queryExecution().analyzed().toString()
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")
    assert "o_orderstatus = F" not in plan
