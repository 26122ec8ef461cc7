"""Hourly cube, leaderboard and dashboard queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import money, rate_card
from ..operators import cube, pricing
from ..sources import events
from .registry import PRICED, query

TODAY = "2024-01-30"
_SUM = "CAST(sum(input) AS BIGINT) AS input, CAST(sum(output) AS BIGINT) AS output, CAST(sum(cache_read) AS BIGINT) AS cache_read, CAST(sum(c5m) AS BIGINT) AS cache_5m, CAST(sum(c1h) AS BIGINT) AS cache_1h"
HOURLY = (
    PRICED
    + f""",
hh AS (SELECT device_id, usage_date AS date, CAST(hour(make_timestamp(ts_ms * 1000)) AS INTEGER) AS hour, tool, model, {_SUM},
  sum(CASE WHEN priced THEN input * i + output * o + cache_read * rd + c5m * w + c1h * 2 * i ELSE 0 END) AS cost,
  sum(CASE WHEN priced THEN cache_read * (i - rd) - c5m * (w - i) - c1h * i ELSE 0 END) AS savings FROM j GROUP BY ALL),
ha AS (SELECT *, input + output + cache_read + cache_5m + cache_1h AS tokens FROM hh),
h AS (SELECT *, sum(tokens) OVER (PARTITION BY device_id, date) > 3000000 AS flagged FROM ha),
dev AS (SELECT 'd' || i AS device_id, i % 60 AS user_id FROM range(120) t(i)),
u AS (SELECT c_custkey AS user_id, c_name AS name, n_name AS city FROM customer JOIN nation ON c_nationkey = n_nationkey),
l AS (SELECT h.*, user_id, name, city FROM h JOIN dev USING (device_id) JOIN u USING (user_id))"""
)
ALARM = 3_000_000


def hourly(spark: SparkSession, d: str) -> DataFrame:
    return cube.cells(events.device_entries(spark, d), "device_id")


def served(spark: SparkSession, d: str, **filters) -> DataFrame:
    rated = pricing.with_rates(cube.flagged(hourly(spark, d), ALARM), rate_card.card(spark))
    priced = rated.withColumns({"cost": F.coalesce(money.card_cost(), F.lit(0.0)), "savings": F.coalesce(money.card_savings(), F.lit(0.0))}).drop("rate")
    return cube.served(priced, events.devices(spark, d), events.users(spark, d), **filters)


@query(f"SELECT date, hour, tool, model, CAST(sum(input) AS BIGINT) AS input, CAST(sum(output) AS BIGINT) AS output, CAST(sum(cache_read) AS BIGINT) AS cache_read, CAST(sum(cache_5m) AS BIGINT) AS cache_5m, CAST(sum(cache_1h) AS BIGINT) AS cache_1h FROM h GROUP BY ALL", HOURLY)
def hourly_cube(spark, d):
    return cube.cells(events.usage_entries(spark, d))


@query(", old AS (SELECT * FROM h WHERE date <= '2024-01-20'), new AS (SELECT * EXCLUDE (input), input + 1 AS input FROM h WHERE date >= '2024-01-18' AND device_id < 'd5') SELECT device_id, date, hour, tool, model, input FROM new UNION ALL SELECT device_id, date, hour, tool, model, input FROM old WHERE (device_id, date) NOT IN (SELECT (device_id, date) FROM new)", HOURLY)
def latest_wins_upsert(spark, d):
    rows = hourly(spark, d)
    new = rows.where("date >= '2024-01-18' and device_id < 'd5'").withColumn("input", F.col("input") + 1)
    return cube.latest_wins(rows.where("date <= '2024-01-20'"), new).select("device_id", "date", "hour", "tool", "model", "input")


@query("SELECT DISTINCT device_id, date, flagged FROM h", HOURLY)
def anomaly_flag(spark, d):
    return cube.flagged(hourly(spark, d), ALARM).select("device_id", "date", "flagged").distinct()


@query("SELECT user_id, name, city, CAST(sum(tokens) AS BIGINT) AS tokens, round(sum(cost), 8) AS cost, count(DISTINCT device_id) AS devices, CAST(row_number() OVER (ORDER BY sum(tokens) DESC, name) AS INTEGER) AS rank FROM l WHERE NOT flagged GROUP BY user_id, name, city", HOURLY)
def leaderboard(spark, d):
    return cube.leaderboard(served(spark, d)).select("user_id", "name", "city", "tokens", F.round("cost", 8).alias("cost"), "devices", "rank")


@query("SELECT user_id, name, CAST(sum(input + output) AS BIGINT) AS tokens, CAST(row_number() OVER (ORDER BY sum(input + output) DESC, name) AS INTEGER) AS rank FROM l WHERE NOT flagged AND date BETWEEN '2024-01-05' AND '2024-01-25' AND tool = 'view' AND city = 'NATION_3' GROUP BY user_id, name, city", HOURLY)
def leaderboard_filtered(spark, d):
    rows = served(spark, d, since="2024-01-05", until="2024-01-25", tool="view", city="NATION_3")
    return cube.leaderboard(rows, cache=False).select("user_id", "name", "tokens", "rank")


@query(", g AS (SELECT user_id, model, CAST(sum(tokens) AS BIGINT) AS tokens FROM l WHERE NOT flagged GROUP BY ALL) SELECT user_id, model, tokens, place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY tokens DESC, model) AS INTEGER) AS place FROM g WHERE tokens > 0) WHERE place <= 4", HOURLY)
def leaderboard_top_models(spark, d):
    return cube.top_models(served(spark, d))


@query("SELECT CAST(sum(tokens) AS BIGINT) AS tokens, round(sum(cost), 8) AS cost, count(DISTINCT user_id) AS users, CAST(count(DISTINCT device_id) AS BIGINT) AS devices FROM l WHERE NOT flagged", HOURLY)
def community_totals(spark, d):
    return cube.community(cube.by_user(served(spark, d))).withColumn("cost", F.round("cost", 8))


_RATE = "CASE WHEN sum(cache_read + cache_5m + cache_1h + input) > 0 THEN round(sum(cache_read) / sum(cache_read + cache_5m + cache_1h + input), 9) END"


@query(f"SELECT tool, model, CAST(sum(tokens) AS BIGINT) AS tokens, round(sum(cost), 8) AS cost, {_RATE} AS hit_rate FROM l GROUP BY tool, model ORDER BY tokens DESC, tool, model LIMIT 50", HOURLY)
def dashboard_tool_model_top50(spark, d):
    return cube.tool_models(served(spark, d, include_flagged=True)).select("tool", "model", "tokens", F.round("cost", 8).alias("cost"), F.round("hit_rate", 9).alias("hit_rate"))


_DASH = "CAST(sum(input) AS BIGINT) AS input, CAST(sum(output) AS BIGINT) AS output, CAST(sum(cache_read) AS BIGINT) AS cache_read, CAST(sum(cache_5m) AS BIGINT) AS cache_5m, CAST(sum(cache_1h) AS BIGINT) AS cache_1h, round(sum(cost), 8) AS cost FROM l WHERE user_id = 7"
_ISO = "CAST((dayofweek(CAST(date AS DATE)) + 6) % 7 AS VARCHAR)"


@query(
    f"""SELECT 'tool' AS section, tool AS key1, NULL AS key2, {_DASH} GROUP BY tool UNION ALL SELECT 'model', model, NULL, {_DASH} GROUP BY model UNION ALL SELECT 'tool_model', tool, model, {_DASH} GROUP BY tool, model
    UNION ALL SELECT 'date', date, NULL, {_DASH} GROUP BY date UNION ALL SELECT 'weekday_at', {_ISO}, CAST(hour AS VARCHAR), {_DASH} GROUP BY 2, 3 UNION ALL SELECT 'all', NULL, NULL, {_DASH}""",
    HOURLY,
)
def dashboard_sections(spark, d):
    return cube.dashboard(served(spark, d, user_id=7, include_flagged=True)).withColumn("cost", F.round("cost", 8))


@query(f", g AS (SELECT {_ISO} AS wd, hour, sum(tokens) AS t FROM l GROUP BY 1, 2) SELECT CAST(w AS INTEGER) AS weekday, CAST(hr AS INTEGER) AS hour, CAST(coalesce(t, 0) AS BIGINT) AS tokens FROM range(7) a(w) CROSS JOIN range(24) b(hr) LEFT JOIN g ON g.wd = CAST(w AS VARCHAR) AND g.hour = hr", HOURLY)
def heatmap_7x24(spark, d):
    return cube.heatmap(served(spark, d, include_flagged=True))


@query(f", g AS (SELECT date, sum(tokens) AS t, sum(cost) AS c, {_RATE} AS r FROM l WHERE user_id = 11 GROUP BY date) SELECT CAST(DATE '{TODAY}' - CAST(k AS INTEGER) AS VARCHAR) AS date, CAST(coalesce(t, 0) AS BIGINT) AS tokens, round(coalesce(c, 0), 8) AS cost, r AS hit_rate FROM range(30) z(k) LEFT JOIN g ON g.date = CAST(DATE '{TODAY}' - CAST(k AS INTEGER) AS VARCHAR)", HOURLY)
def daily30_zero_filled(spark, d):
    rows = cube.days_until(served(spark, d, user_id=11, include_flagged=True), TODAY)
    return rows.select("date", "tokens", F.round("cost", 8).alias("cost"), F.round("hit_rate", 9).alias("hit_rate"))


@query(f"SELECT user_id, {_RATE} AS hit_rate, round(sum(cache_5m + cache_1h) / nullif(sum(cache_read + cache_5m + cache_1h + input), 0), 9) AS write_share, round(sum(cache_read) / nullif(sum(cache_5m + cache_1h), 0), 9) AS read_per_write FROM l GROUP BY user_id", HOURLY)
def cache_hit_rate(spark, d):
    by = served(spark, d, include_flagged=True).groupBy("user_id").agg(*(F.sum(c).alias(c) for c in cube.COUNTERS))
    write = F.col("cache_5m") + F.col("cache_1h")
    total = F.col("cache_read") + write + F.col("input")
    return by.select("user_id", F.round(cube.hit_rate(), 9).alias("hit_rate"), F.round(F.when(total > 0, write / total), 9).alias("write_share"), F.round(F.when(write > 0, F.col("cache_read") / write), 9).alias("read_per_write"))


@query("SELECT user_id, round(sum(savings), 8) AS savings, round(sum(cost), 8) AS cost FROM l GROUP BY user_id", HOURLY)
def cache_savings(spark, d):
    return served(spark, d, include_flagged=True).groupBy("user_id").agg(F.round(F.sum("savings"), 8).alias("savings"), F.round(F.sum("cost"), 8).alias("cost"))


_DAYS = f""", day AS (SELECT user_id, date, sum(tokens) AS t FROM l GROUP BY ALL), who AS (SELECT user_id, count(*) AS active_days, bool_or(date = '{TODAY}') AS now FROM day GROUP BY user_id),
ago AS (SELECT user_id, DATE '{TODAY}' - CAST(date AS DATE) - CASE WHEN now THEN 0 ELSE 1 END AS k FROM day JOIN who USING (user_id) WHERE t > 0),
run AS (SELECT user_id, k, row_number() OVER (PARTITION BY user_id ORDER BY k) - 1 AS n FROM ago WHERE k >= 0)"""


@query(f"{_DAYS} SELECT user_id, active_days, coalesce((SELECT count(*) FROM run WHERE run.user_id = who.user_id AND k = n), 0) AS streak FROM who", HOURLY)
def streak(spark, d):
    return cube.streaks(served(spark, d, include_flagged=True), TODAY, "user_id")


@query("SELECT user_id, count(DISTINCT date) AS active_days FROM l GROUP BY user_id", HOURLY)
def active_days(spark, d):
    return cube.streaks(served(spark, d, include_flagged=True), TODAY, "user_id").select("user_id", "active_days")


@query("SELECT city, count(*) AS cells, count(DISTINCT device_id) AS devices, CAST(sum(tokens) AS BIGINT) AS tokens FROM l WHERE NOT flagged GROUP BY city", HOURLY)
def three_way_join(spark, d):
    return served(spark, d).groupBy("city").agg(F.count("*").alias("cells"), F.countDistinct("device_id").alias("devices"), F.sum(cube.cell_tokens()).alias("tokens"))


@query("SELECT device_id, date, hour, tool, model, CAST(2 * input AS BIGINT) AS input, CAST(2 * output AS BIGINT) AS output, CAST(2 * cache_read AS BIGINT) AS cache_read, CAST(2 * cache_5m AS BIGINT) AS cache_5m, CAST(2 * cache_1h AS BIGINT) AS cache_1h FROM h", HOURLY)
def duplicate_cell_merge(spark, d):
    rows = hourly(spark, d)
    return cube.merge_cells(rows.union(rows), "device_id", "date")


@query(", x AS (SELECT CASE WHEN hour = 5 THEN '' ELSE device_id END AS device_id, CASE WHEN hour = 7 THEN '2024-02-31' ELSE date END AS date, CASE WHEN hour = 9 THEN 24 ELSE hour END AS hr FROM h) SELECT device_id <> '' AND date <> '2024-02-31' AND hr <= 23 AS ok, count(*) AS n FROM x GROUP BY 1", HOURLY)
def payload_validation(spark, d):
    h = F.col("hour")
    bad = hourly(spark, d).select(F.when(h == 5, "").otherwise(F.col("device_id")).alias("device_id"), F.when(h == 7, "2024-02-31").otherwise(F.col("date")).alias("date"), F.when(h == 9, 24).otherwise(h).alias("hour"), "tool", "model")
    return bad.groupBy(cube.valid(bad).alias("ok")).agg(F.count("*").alias("n"))


@query(
    """RECURSIVE , s AS (SELECT tool AS token, ts_ms, event_id, row_number() OVER (PARTITION BY tool ORDER BY ts_ms, event_id) AS n FROM e),
    f(token, n, ts_ms, open, used) AS (SELECT token, n, ts_ms, ts_ms, CAST(1 AS BIGINT) FROM s WHERE n = 1
      UNION ALL SELECT s.token, s.n, s.ts_ms, CASE WHEN s.ts_ms - open >= 3600000 THEN s.ts_ms ELSE open END, CASE WHEN s.ts_ms - open >= 3600000 THEN 1 ELSE used + 1 END FROM f JOIN s ON s.token = f.token AND s.n = f.n + 1)
    SELECT token, open AS window_ms, count(*) AS requests, CAST(sum(CASE WHEN used <= 2 THEN 1 ELSE 0 END) AS BIGINT) AS allowed FROM f GROUP BY ALL"""
)
def rate_limit(spark, d):
    asked = events.usage_entries(spark, d).select(F.col("tool").alias("token"), "ts_ms")
    return cube.within_limit(asked, 2).groupBy("token", "window_ms").agg(F.count("*").alias("requests"), F.sum(F.col("allowed").cast("bigint")).alias("allowed"))


@query("SELECT sha256(tool || user_id) AS hash, count(*) AS n FROM e GROUP BY 1")
def token_hash(spark, d):
    return events.usage_entries(spark, d).groupBy(F.sha2(F.concat("tool", F.col("user_id").cast("string")), 256).alias("hash")).agg(F.count("*").alias("n"))


