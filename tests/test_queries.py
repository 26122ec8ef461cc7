"""Every query against its SQL on the smallest tables, and what all reports must agree on."""

import oracle
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tallyflow.functions import clock, money
from tallyflow.operators import reports
from tallyflow.plans import oracles, queries
from tallyflow.plans.report_queries import priced

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.duck(SMALL)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query_equals_its_sql(spark, con, name):
    assert oracle.difference(queries()[name](spark, SMALL), con, oracles()[name]) == ""


def with_events(folder, con, changed):
    """A folder of the small tables with `changed` columns of the events, and its connection."""
    con.sql(f"COPY (SELECT * REPLACE ({changed}) FROM events) TO '{folder}/events.parquet'")
    for name in ("customer", "nation"):
        con.sql(f"COPY {name} TO '{folder}/{name}.parquet'")
    return str(folder), oracle.duck(str(folder))


def test_community_totals_where_all_days_are_flagged(spark, con, tmp_path):
    d, own = with_events(tmp_path, con, "value + 100000 AS value")
    df = queries()["community_totals"](spark, d)
    assert oracle.difference(df, own, oracles()["community_totals"]) == "" and tuple(df.first()) == (None, None, 0, 0)


def test_codex_source_on_events_without_tokens(spark, con, tmp_path):
    none = "event_id * 7 % 5 < 2"
    d, own = with_events(tmp_path, con, f"""CASE WHEN {none} THEN 0.0 ELSE value END AS value, CASE WHEN {none} THEN '{{"k": 0}}' ELSE props END AS props""")
    assert oracle.difference(queries()["codex_source"](spark, d), own, oracles()["codex_source"]) == ""


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_all_reports_hold_the_same_tokens(spark):
    e = priced(spark, SMALL)
    day = reports.daily(e)
    rows = (day, reports.weekly(day), reports.monthly(day), reports.summarize(e, "session_id"), reports.grand_totals(day))
    whole = e.agg(F.sum(money.tokens())).first()[0]
    for r in rows:
        assert r.agg(F.sum(F.col("input") + F.col("output") + F.col("cache_create") + F.col("cache_read"))).first()[0] == whole


def test_an_active_ts_filter_reaches_the_scan(spark):
    plan = spark.read.parquet(f"{SMALL}/events.parquet").where("event_id < 10").select("event_id", "value")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(event_id), LessThan(event_id,10)]" in plan and "ReadSchema: struct<event_id:bigint,value:double>" in plan


def test_driver_side_windows():
    assert clock.last_periods_since("day", 3, "2026-03-01") == "20260227"
    assert clock.last_periods_since("week", 2, "2026-01-01", reports.SUNDAY) == "20251221"
    assert clock.last_periods_since("week", 1, "2026-01-01", reports.MONDAY) == "20251229"
    assert clock.last_periods_since("month", 3, "2026-01-15") == "20251101"
    assert clock.named_range("7d", "2026-03-03") == ("2026-02-25", "2026-03-03")
    assert clock.day_bounds_ms("2026-03-01", "2026-03-01", "Asia/Shanghai") == (1772294400000, 1772380800000)
