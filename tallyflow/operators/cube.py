"""The hourly usage cube and what is served from it: upserts, leaderboard, dashboard."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from ..functions import clock
from ..functions.money import cache_1h, cache_5m
from .ranking import row_numbers

CELL = ("hour", "tool", "model")
COUNTERS = ("input", "output", "cache_read", "cache_5m", "cache_1h")
#: Tokens a device-day beyond which it is flagged; limits of a report.
ANOMALY, MAX_ROWS_A_DAY, MAX_DAYS, MAX_ROWS = 1_000_000_000, 24 * 64, 550, 200_000


def cells(entries: DataFrame, *keys: str, tz: str = "UTC") -> DataFrame:
    """Counters by date, local hour, tool and model."""
    model = F.when(F.coalesce("model", F.lit("")) == "", F.lit("unknown")).otherwise(F.col("model"))
    own = {"cache_5m": cache_5m(), "cache_1h": cache_1h()}
    return entries.groupBy(*keys, clock.local_date(F.col("ts_ms"), tz).alias("date"), clock.local_hour(F.col("ts_ms"), tz).alias("hour"), "tool", model.alias("model")).agg(
        *(F.sum(own.get(c, F.col(c))).alias(c) for c in COUNTERS)
    )


def merge_cells(rows: DataFrame, *keys: str) -> DataFrame:
    """Repeated cells of a report, folded."""
    return rows.groupBy(*keys, *CELL).agg(*(F.sum(c).alias(c) for c in COUNTERS))


def valid(rows: DataFrame) -> Column:
    """Whether a cell is acceptable in a report."""
    sized = lambda c, most: F.length(c).between(1, most)
    ok = sized("device_id", 64) & F.col("date").rlike(r"^\d{4}-\d\d-\d\d$") & F.try_to_date("date", "yyyy-MM-dd").isNotNull() & F.col("hour").between(0, 23) & sized("tool", 32) & sized("model", 128)
    return F.coalesce(ok, F.lit(False))


def over_limits(reports: DataFrame, *keys: str, rows_a_day: int = MAX_ROWS_A_DAY, days: int = MAX_DAYS, rows: int = MAX_ROWS) -> DataFrame:
    """Reports (by `keys`) that break a limit: keys, days, rows, most_rows (of a day) and `fault`."""
    by_day = reports.groupBy(*keys, "date").agg(F.count("*").alias("n"))
    sums = by_day.groupBy(*keys).agg(F.count("*").alias("days"), F.sum("n").alias("rows"), F.max("n").alias("most_rows"))
    fault = F.when(F.col("most_rows") > rows_a_day, F.lit(f"more than {rows_a_day} rows a day")).when(F.col("days") > days, F.lit(f"more than {days} days")).when(F.col("rows") > rows, F.lit(f"more than {rows} rows"))
    return sums.withColumn("fault", fault).where("fault is not null")


def cell_tokens(cache: bool = True) -> Column:
    """Tokens of a cell; without cache, input and output only."""
    return sum((F.col(c) for c in (COUNTERS if cache else ("input", "output"))), F.lit(0))


def latest_wins(stored: DataFrame, reported: DataFrame) -> DataFrame:
    """A reported (device, date) replaces the stored one whole; a day without rows replaces nothing."""
    days = reported.select("device_id", "date").distinct()
    return stored.join(days, ["device_id", "date"], "left_anti").unionByName(reported)


def latest_report(reports: DataFrame) -> DataFrame:
    """Of many reports (device_id, date, generated_at) the rows of each device-day's last."""
    last = F.max("generated_at").over(Window.partitionBy("device_id", "date"))
    return reports.withColumn("_last", last).where("generated_at = _last").drop("_last")


def flagged(rows: DataFrame, most: int = ANOMALY) -> DataFrame:
    """`rows` with `flagged`: whether their device-day has too many tokens."""
    day = rows.groupBy("device_id", "date").agg((F.sum(cell_tokens()) > most).alias("flagged"))
    return rows.join(day, ["device_id", "date"])


def served(hourly: DataFrame, devices: DataFrame, users: DataFrame, **filters: str | int | bool | None) -> DataFrame:
    """Cells with their user; filters: since, until, tool, model, city, user_id, include_flagged."""
    rows = hourly if filters.get("include_flagged") else hourly.where(~F.col("flagged"))
    for name, test in (("since", F.col("date") >= F.lit(filters.get("since"))), ("until", F.col("date") <= F.lit(filters.get("until"))), ("tool", F.col("tool") == F.lit(filters.get("tool"))), ("model", F.col("model") == F.lit(filters.get("model")))):
        rows = rows.where(test) if filters.get(name) is not None else rows
    who = users
    for name in ("city", "user_id"):
        who = who.where(F.col(name) == F.lit(filters[name])) if filters.get(name) is not None else who
    return rows.join(devices, "device_id").join(who, "user_id")


def by_user(rows: DataFrame, cache: bool = True) -> DataFrame:
    """What each user has used; `rows` have a cost."""
    return rows.groupBy("user_id", "name", "city").agg(F.sum(cell_tokens(cache)).alias("tokens"), F.sum("cost").alias("cost"), F.countDistinct("device_id").alias("devices"), F.max("flagged").alias("flagged"))


def leaderboard(rows: DataFrame, cache: bool = True) -> DataFrame:
    """Users by tokens, then name, with their rank; `rows` have a cost."""
    return row_numbers(by_user(rows, cache), "rank", F.desc("tokens"), F.asc("name"), F.asc("user_id")).withColumn("rank", F.col("rank").cast("int"))


def top_models(rows: DataFrame, most: int = 4, cache: bool = True) -> DataFrame:
    """Each user's models with most tokens, ties by name."""
    by = rows.groupBy("user_id", "model").agg(F.sum(cell_tokens(cache)).alias("tokens")).where("tokens > 0")
    return by.withColumn("place", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("tokens"), "model"))).where(F.col("place") <= most)


def community(board: DataFrame) -> DataFrame:
    """Totals of all users; without any, the counts are 0 and the sums null."""
    return board.agg(F.sum("tokens").alias("tokens"), F.sum("cost").alias("cost"), F.count("*").alias("users"), F.coalesce(F.sum("devices"), F.lit(0)).alias("devices"))


def hit_rate(read: str = "cache_read", writes: tuple[str, str] = ("cache_5m", "cache_1h"), fresh: str = "input") -> Column:
    """Cache reads over the input side; null where there was none."""
    total = F.col(read) + F.col(writes[0]) + F.col(writes[1]) + F.col(fresh)
    return F.when(total > 0, F.col(read) / total)


def dashboard(rows: DataFrame) -> DataFrame:
    """Totals by tool, model, both, date, weekday and hour, and overall, in one pass: section, two keys, counters, cost."""
    text = rows.withColumns({"weekday": clock.weekday_monday0(F.col("date")).cast("string"), "at": F.col("hour").cast("string")})
    sets = [["tool"], ["model"], ["tool", "model"], ["date"], ["weekday", "at"], []]
    names = ("tool", "model", "date", "weekday", "at")
    out = text.groupingSets([[F.col(c) for c in s] for s in sets], *names).agg(*(F.sum(c).alias(c) for c in COUNTERS), F.sum("cost").alias("cost"), *(F.grouping(c).alias(f"_{c}") for c in names))
    held = lambda *on: [F.col(f"_{c}") == (0 if c in on else 1) for c in names]

    def is_set(*on: str) -> Column:
        ok = F.lit(True)
        for c in held(*on):
            ok = ok & c
        return ok

    section = F.coalesce(*(F.when(is_set(*s), F.lit("_".join(s) or "all")) for s in sets))
    return out.select(section.alias("section"), F.coalesce("tool", "model", "date", "weekday").alias("key1"), F.when(section == "tool_model", F.col("model")).when(section == "weekday_at", F.col("at")).alias("key2"), *COUNTERS, "cost")


def tool_models(rows: DataFrame, most: int = 50) -> DataFrame:
    by = rows.groupBy("tool", "model").agg(*(F.sum(c).alias(c) for c in COUNTERS), F.sum("cost").alias("cost")).withColumn("tokens", cell_tokens())
    return by.withColumn("hit_rate", hit_rate()).orderBy(F.desc("tokens"), "tool", "model").limit(most)


def heatmap(rows: DataFrame) -> DataFrame:
    """Tokens of all 7 x 24 weekdays (Monday 0) and hours, zeros too."""
    spark = rows.sparkSession
    grid = spark.range(7 * 24).select((F.col("id") / 24).cast("int").alias("weekday"), (F.col("id") % 24).cast("int").alias("hour"))
    found = rows.groupBy(clock.weekday_monday0(F.col("date")).alias("weekday"), "hour").agg(F.sum(cell_tokens()).alias("tokens"))
    return grid.join(found, ["weekday", "hour"], "left").select("weekday", "hour", F.coalesce("tokens", F.lit(0)).alias("tokens"))


def days_until(rows: DataFrame, today: str, days: int = 30) -> DataFrame:
    """The days that end with today, those without rows as zeros."""
    calendar = rows.sparkSession.range(days).select(F.date_format(F.date_sub(F.lit(today).cast("date"), F.col("id").cast("int")), "yyyy-MM-dd").alias("date"))
    found = rows.groupBy("date").agg(F.sum(cell_tokens()).alias("tokens"), F.sum("cost").alias("cost"), *(F.sum(c).alias(c) for c in COUNTERS))
    return calendar.join(found, "date", "left").select("date", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("cost", F.lit(0.0)).alias("cost"), hit_rate().alias("hit_rate"))


def streaks(rows: DataFrame, today: str, *keys: str) -> DataFrame:
    """Active days, and the run of days with tokens that ends today, or yesterday if today has no rows."""
    day = rows.groupBy(*keys, "date").agg(F.sum(cell_tokens()).alias("tokens"))
    every = Window.partitionBy(*keys)
    day = day.withColumn("ago", F.datediff(F.lit(today).cast("date"), F.to_date("date"))).withColumn("begin", F.when(F.max(F.col("date") == today).over(every), 0).otherwise(1))
    used = F.when((F.col("tokens") > 0) & (F.col("ago") >= F.col("begin")), 1).otherwise(0)
    before = F.sum("used").over(every.orderBy("ago").rowsBetween(Window.unboundedPreceding, -1))
    day = day.withColumn("used", used).withColumn("place", F.coalesce(before, F.lit(0)))
    unbroken = (F.col("used") == 1) & (F.col("ago") - F.col("begin") == F.col("place"))
    return day.groupBy(*keys).agg(F.count("*").alias("active_days"), F.sum(F.when(unbroken, 1).otherwise(0)).alias("streak"))


def within_limit(requests: DataFrame, most: int = 60, window_ms: int = clock.HOUR_MS, key: str = "token") -> DataFrame:
    """`requests` (key, ts_ms) with window_ms and `allowed`: at most `most` in each window that opens with the first request after the last one closed.

    A task reads its keys' requests in order of time, batch by batch, and remembers only the open window. A request without a time has neither.
    """

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, opened, used = None, None, 0
        for batch in batches:
            ts, runs = batch["ts_ms"].to_numpy(zero_copy_only=False), pc.run_end_encode(batch[key])
            open_at, allowed = np.zeros(len(ts), np.int64), np.zeros(len(ts), bool)
            missing = batch["ts_ms"].is_null().to_numpy(zero_copy_only=False)
            a = 0
            for end, name in zip(runs.run_ends.to_pylist(), runs.values.to_pylist(), strict=True):
                if (name,) != now:
                    now, opened, used = (name,), None, 0
                a += int(missing[a:end].sum())  # those without a time come first
                while a < end:
                    if opened is None or ts[a] - opened >= window_ms:
                        opened, used = int(ts[a]), 0
                    b = a + int(np.searchsorted(ts[a:end], opened + window_ms))
                    open_at[a:b], allowed[a:b] = opened, used + np.arange(b - a) < most
                    a, used = b, used + b - a
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(open_at, mask=missing), pa.array(allowed, mask=missing)], names=[*batch.schema.names, "window_ms", "allowed"])

    ordered = requests.repartition(key).sortWithinPartitions(key, "ts_ms")
    return ordered.mapInArrow(judge, StructType([*requests.schema.fields, StructField("window_ms", LongType()), StructField("allowed", BooleanType())]))
