"""Report queries: periods, sessions, breakdowns, merges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import clock, money, rate_card
from ..operators import pricing, reports
from ..operators.ranking import row_numbers
from ..sources.events import usage_entries
from .registry import ENTRIES, PRICED, SUMS, query

SHOWN = ("input", "output", "cache_create", "cache_read")
WEEK = "CAST(CAST(usage_date AS DATE) - CAST((dayofweek(CAST(usage_date AS DATE)) - {0} + 7) % 7 AS INTEGER) AS VARCHAR)"


def priced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries with rate, cost (auto) and missing_model."""
    rated = pricing.with_rates(usage_entries(spark, sf_dir), rate_card.card(spark))
    return rated.withColumns({"cost": money.cost("auto"), "missing_model": money.missing_model("auto")})


def shown(rows: DataFrame, *keys) -> DataFrame:
    return rows.select(*keys, *SHOWN, F.round("cost", 8).alias("cost"))


@query(f"SELECT usage_date, tool, {SUMS} FROM c GROUP BY ALL", PRICED)
def daily_by_tool(spark, d):
    return shown(reports.summarize(priced(spark, d), "usage_date", "tool"), "usage_date", "tool")


@query(f"SELECT usage_date, project, {SUMS} FROM c GROUP BY ALL", PRICED)
def daily_by_project(spark, d):
    return shown(reports.daily(priced(spark, d), by_project=True), "usage_date", "project")


@query(f"SELECT {WEEK.format(0)} AS period, tool, {SUMS} FROM c GROUP BY ALL", PRICED)
def weekly_sunday(spark, d):
    return shown(reports.weekly(reports.summarize(priced(spark, d), "usage_date", "tool"), reports.SUNDAY, "tool"), "period", "tool")


@query(f"SELECT {WEEK.format(1)} AS period, tool, {SUMS} FROM c GROUP BY ALL", PRICED)
def weekly_monday(spark, d):
    return shown(reports.weekly(reports.summarize(priced(spark, d), "usage_date", "tool"), reports.MONDAY, "tool"), "period", "tool")


@query(f"SELECT substr(usage_date, 1, 7) AS period, tool, {SUMS} FROM c GROUP BY ALL", PRICED)
def monthly_rollup(spark, d):
    return shown(reports.monthly(reports.summarize(priced(spark, d), "usage_date", "tool"), "tool"), "period", "tool")


@query(
    f"SELECT session_id, min(ts_ms) AS first_ms, max(ts_ms) AS last_ms, arg_max(project, ts_ms * 1000000 - event_id % 1000000) AS project, string_agg(DISTINCT version, ',' ORDER BY version) AS versions, {SUMS} FROM c GROUP BY session_id",
    PRICED,
)
def session_activity(spark, d):
    return shown(reports.sessions(priced(spark, d)), "session_id", "first_ms", "last_ms", "project", F.array_join("versions", ",").alias("versions"))


@query(f"SELECT session_id, {SUMS} FROM c GROUP BY session_id", PRICED)
def session_keyswap(spark, d):
    return shown(reports.summarize(priced(spark, d), "session_id"), "session_id")


@query("SELECT session_id, max(ts_ms) AS last_ms, CAST(sum(tokens) AS BIGINT) AS tokens FROM e GROUP BY session_id HAVING strftime(make_timestamp(max(ts_ms) * 1000), '%Y%m%dT%H:%M:%S.%gZ') BETWEEN '20240110' AND '20240130T23:30'")
def session_having_last_activity(spark, d):
    rows = usage_entries(spark, d).groupBy("session_id").agg(F.max("ts_ms").alias("last_ms"), F.sum(money.tokens()).alias("tokens"))
    return reports.having_last_activity(rows, "20240110", "20240130T23:30")


@query("SELECT usage_date, CAST(sum(tokens) AS BIGINT) AS tokens FROM e WHERE usage_date >= '2024-01-24' GROUP BY usage_date")
def last_n_days(spark, d):
    since = clock.last_periods_since("day", 7, "2024-01-30")
    return usage_entries(spark, d).where(clock.in_window(F.col("usage_date"), since)).groupBy("usage_date").agg(F.sum(money.tokens()).alias("tokens"))


@query("SELECT usage_date, CAST(sum(tokens) AS BIGINT) AS tokens FROM e WHERE replace(usage_date, '-', '') >= '202401' AND replace(usage_date, '-', '') <= '20240115' GROUP BY usage_date")
def date_prefix_window(spark, d):
    return usage_entries(spark, d).where(clock.in_window(F.col("usage_date"), "202401", "2024-01-15")).groupBy("usage_date").agg(F.sum(money.tokens()).alias("tokens"))


@query(f"SELECT usage_date, model, bool_or(missing_model IS NOT NULL) AS missing, row_number() OVER (PARTITION BY usage_date ORDER BY round(sum(cost), 8) DESC, min(event_id)) AS place, {SUMS} FROM c GROUP BY usage_date, model", PRICED)
def model_breakdown(spark, d):
    entries = priced(spark, d).withColumn("cost", F.col("cost").cast("decimal(30,12)"))
    rows = reports.model_breakdown(entries, "usage_date", order=F.col("line_ord"))
    flat = rows.select("usage_date", F.posexplode("breakdown").alias("pos", "b")).select("usage_date", (F.col("pos") + 1).cast("bigint").alias("place"), "b.*")
    return flat.select("usage_date", "model", "missing", "place", *SHOWN, F.round(F.col("cost").cast("double"), 8).alias("cost"))


@query("SELECT session_id, string_agg(model, ',' ORDER BY seen) AS models FROM (SELECT session_id, model, min(event_id) AS seen FROM e GROUP BY ALL) GROUP BY session_id")
def models_first_seen(spark, d):
    rows = reports.model_breakdown(priced(spark, d), "session_id", order=F.col("line_ord"))
    return rows.select("session_id", F.array_join("models", ",").alias("models"))


@query(f"SELECT {SUMS} FROM c", PRICED)
def grand_totals(spark, d):
    return shown(reports.grand_totals(reports.daily(priced(spark, d))))


@query(
    f"""SELECT period, 'tool' AS kind, name, input, output, cache_create, cache_read, cost FROM (SELECT {WEEK.format(1)} AS period, tool AS name, {SUMS} FROM c GROUP BY 1, 2)
    UNION ALL SELECT period, 'model', name, input, output, cache_create, cache_read, cost FROM (SELECT {WEEK.format(1)} AS period, model AS name, {SUMS} FROM c GROUP BY 1, 2)
    UNION ALL SELECT period, 'total', NULL, input, output, cache_create, cache_read, cost FROM (SELECT {WEEK.format(1)} AS period, {SUMS} FROM c GROUP BY 1)""",
    PRICED,
)
def all_agent_merge(spark, d):
    rows = reports.merge_tools(priced(spark, d), clock.week_start(F.col("usage_date"), reports.MONDAY))
    measure = lambda x: [F.col(f"{x}.{m}") for m in SHOWN]
    parts = [
        rows.select("period", F.explode("tools").alias("x")).select("period", F.lit("tool").alias("kind"), F.col("x.tool").alias("name"), *measure("x"), F.round("x.cost", 8).alias("cost")),
        rows.select("period", F.explode("breakdown").alias("x")).select("period", F.lit("model").alias("kind"), F.col("x.model").alias("name"), *measure("x"), F.round("x.cost", 8).alias("cost")),
        rows.select("period", F.lit("total").alias("kind"), F.lit(None).cast("string").alias("name"), *SHOWN, F.round("cost", 8).alias("cost")),
    ]
    return parts[0].union(parts[1]).union(parts[2])


@query(
    f"""SELECT 'daily' AS section, usage_date AS period, {SUMS} FROM c GROUP BY 2 UNION ALL SELECT 'weekly', {WEEK.format(1)}, {SUMS} FROM c GROUP BY 2
    UNION ALL SELECT 'monthly', substr(usage_date, 1, 7), {SUMS} FROM c GROUP BY 2 UNION ALL SELECT 'session', session_id, {SUMS} FROM c GROUP BY 2""",
    PRICED,
)
def sections_grouping_sets(spark, d):
    return shown(reports.sections(priced(spark, d)), "section", "period")


@query("SELECT DISTINCT missing_model AS model FROM c WHERE missing_model IS NOT NULL", PRICED)
def missing_pricing(spark, d):
    return reports.missing_prices(priced(spark, d))


@query("SELECT concat_ws('|', usage_date, tool, model, CAST(sum(input) AS BIGINT), CAST(sum(output) AS BIGINT)) AS line FROM e GROUP BY usage_date, tool, model")
def canonical_dump(spark, d):
    rows = usage_entries(spark, d).groupBy("usage_date", "tool", "model").agg(F.sum("input").alias("input"), F.sum("output").alias("output"))
    return reports.canonical_dump(rows, "usage_date", "tool", "model", "input", "output")


@query("SELECT DISTINCT tool AS value, 'tool' AS kind FROM e UNION ALL SELECT DISTINCT model, 'model' FROM e UNION ALL SELECT DISTINCT n_name, 'city' FROM nation")
def distinct_filters(spark, d):
    e = usage_entries(spark, d)
    city = spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_name").alias("value"), F.lit("city").alias("kind"))
    return e.select(F.col("tool").alias("value"), F.lit("tool").alias("kind")).union(e.select("model", F.lit("model"))).union(city).distinct()


@query(f"SELECT strftime(make_timestamptz(ts_ms * 1000) AT TIME ZONE 'Asia/Shanghai', '%Y-%m-%d') AS day, CAST(sum(tokens) AS BIGINT) AS tokens FROM e GROUP BY 1", ENTRIES)
def daily_in_zone(spark, d):
    return usage_entries(spark, d).groupBy(clock.local_date(F.col("ts_ms"), "Asia/Shanghai").alias("day")).agg(F.sum(money.tokens()).alias("tokens"))


@query("SELECT session_id, event_id, ts_ms, tokens FROM e WHERE session_id = 's7' OR CAST(user_id AS VARCHAR) = 's7'")
def session_by_id(spark, d):
    e = usage_entries(spark, d)
    return e.where((F.col("session_id") == "s7") | (F.col("raw_session_id") == "s7")).select("session_id", F.col("line_ord").alias("event_id"), "ts_ms", money.tokens().alias("tokens")).orderBy("ts_ms", "event_id")


@query(f"SELECT session_id, row_number() OVER (ORDER BY round(sum(cost), 8) DESC, session_id) AS place, {SUMS} FROM c GROUP BY session_id", PRICED)
def sessions_by_cost(spark, d):
    rows = shown(reports.summarize(priced(spark, d), "session_id"), "session_id")
    return row_numbers(rows, "place", F.desc("cost"), F.asc("session_id"))
