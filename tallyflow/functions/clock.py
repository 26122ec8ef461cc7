"""Dates and times: milliseconds since the epoch are the truth, dates are text in the report's time zone."""

from __future__ import annotations

import datetime as dt
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

HOUR_MS, DAY_MS = 3_600_000, 86_400_000
_TIMESTAMP = r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d{3})?(Z|[+-]\d\d:\d\d)$"


def check_zone(tz: str) -> str:
    """An unknown zone falls back to UTC instead of failing each row."""
    try:
        ZoneInfo(tz)
    except Exception:
        return "UTC"
    return tz


def parse_ms(text: Column) -> Column:
    """Milliseconds of a timestamp with seconds or three fraction digits and a zone; null for any other text."""
    return F.when(text.rlike(_TIMESTAMP), F.unix_millis(F.try_to_timestamp(text)))


def at(ts_ms: Column) -> Column:
    return F.timestamp_millis(ts_ms)


def local(ts_ms: Column, tz: str = "UTC") -> Column:
    return at(ts_ms) if tz == "UTC" else F.from_utc_timestamp(at(ts_ms), check_zone(tz))


def local_date(ts_ms: Column, tz: str = "UTC") -> Column:
    return F.date_format(local(ts_ms, tz), "yyyy-MM-dd")


def local_hour(ts_ms: Column, tz: str = "UTC") -> Column:
    return F.hour(local(ts_ms, tz))


def rfc3339(ts_ms: Column) -> Column:
    return F.date_format(at(ts_ms), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def floor_hour(ts_ms: Column) -> Column:
    return ts_ms - F.pmod(ts_ms, F.lit(HOUR_MS))


def month_key(date: Column) -> Column:
    return F.substring(date, 1, 7)


def week_start(date: Column, start: int = 0) -> Column:
    """First day of the week of a date text; weeks begin on `start`, Sunday 0. Text that is no date stays."""
    day = F.try_to_date(date, "yyyy-MM-dd")
    return F.coalesce(F.date_format(F.date_sub(day, F.pmod(F.dayofweek(day) - 1 - start, F.lit(7))), "yyyy-MM-dd"), date)


def weekday_monday0(date: Column) -> Column:
    return F.weekday(F.to_date(date))


def in_window(date: Column, since: str | None = None, until: str | None = None) -> Column:
    """Bounds compare as text without hyphens, so `2026` or `202601` are bounds too."""
    compact = F.replace(date, F.lit("-"), F.lit(""))
    ok = F.lit(True)
    if since is not None:
        ok = ok & (compact >= since.replace("-", ""))
    if until is not None:
        ok = ok & (compact <= until.replace("-", ""))
    return ok


def day_bounds_ms(since: str, until: str, tz: str = "UTC") -> tuple[int, int]:
    """From the start of the first day to the end of the last, in the zone."""
    zone = ZoneInfo(check_zone(tz))
    ends = (dt.date.fromisoformat(since), dt.date.fromisoformat(until) + dt.timedelta(days=1))
    return tuple(int(dt.datetime.combine(d, dt.time(), zone).timestamp() * 1000) for d in ends)


def last_periods_since(unit: str, count: int, today: str, start: int = 0) -> str:
    """Since-bound (YYYYMMDD) of the last `count` days, weeks or months, today's included."""
    day, count = dt.date.fromisoformat(today), max(1, count) - 1
    if unit == "day":
        first = day - dt.timedelta(days=count)
    elif unit == "week":
        first = day - dt.timedelta(days=(day.isoweekday() % 7 - start) % 7 + 7 * count)
    else:
        months = day.year * 12 + day.month - 1 - count
        first = dt.date(months // 12, months % 12 + 1, 1)
    return first.strftime("%Y%m%d")


def named_range(name: str, today: str) -> tuple[str | None, str | None]:
    """From and to of the named ranges of the leaderboard."""
    day = dt.date.fromisoformat(today)
    back = {"today": (0, 0), "yesterday": (1, 1), "daybefore": (2, 2), "3d": (2, 0), "7d": (6, 0), "30d": (29, 0)}.get(name)
    return (None, None) if back is None else tuple((day - dt.timedelta(days=n)).isoformat() for n in back)


def seconds_or_millis(value: Column, inclusive: bool = True) -> Column:
    """Numbers up to 10^12 are seconds; whether 10^12 itself is depends on the source."""
    bound = F.lit(1_000_000_000_000)
    return F.when(value <= bound if inclusive else value < bound, value * 1000).otherwise(value).cast("bigint")


def remaining_text(minutes: Column) -> Column:
    hours = F.floor(minutes / 60)
    return F.when(hours > 0, F.format_string("%dh %dm left", hours, minutes % 60)).otherwise(F.format_string("%dm left", minutes))
