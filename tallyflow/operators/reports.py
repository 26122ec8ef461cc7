"""Reports over priced usage entries: periods, sessions, breakdowns, merges across tools."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import clock
from ..functions.money import cache_create

MEASURES = ("input", "output", "cache_create", "cache_read", "extra", "cost", "credits", "message_count")
SUNDAY, MONDAY = 0, 1


@dataclass(frozen=True)
class Profile:
    """How a tool's reports are made: first weekday, sessions with activity bounds, window after grouping."""

    week_start: int = SUNDAY
    by_activity: bool = False
    filter_after: bool = False


# Report profiles by tool; others take the default.
PROFILES = {
    "claude": Profile(SUNDAY, True, True),
    "cline": Profile(SUNDAY, True, True),
    "qwen": Profile(SUNDAY, True, True),
    "zcode": Profile(MONDAY, True, True),
    "opencode": Profile(MONDAY, True, False),
    "pi": Profile(SUNDAY, True, False),
    "omp": Profile(SUNDAY, True, False),
    "openclaw": Profile(SUNDAY, True, False),
}


def measures() -> list[Column]:
    """Sums; credits and message counts stay null until one is seen."""
    own = {"cache_create": cache_create()}
    return [F.sum(own.get(m, F.col(m))).alias(m) for m in MEASURES]


def summarize(entries: DataFrame, *keys: Column | str) -> DataFrame:
    return entries.groupBy(*keys).agg(*measures())


def daily(entries: DataFrame, by_project: bool = False) -> DataFrame:
    return summarize(entries, "usage_date", *(["project"] if by_project else []))


def rollup(rows: DataFrame, period: Column, *keys: str) -> DataFrame:
    """Daily rows into longer periods."""
    return rows.groupBy(*keys, period.alias("period")).agg(*(F.sum(m).alias(m) for m in MEASURES))


def weekly(rows: DataFrame, start: int = SUNDAY, *keys: str) -> DataFrame:
    return rollup(rows, clock.week_start(F.col("usage_date"), start), *keys)


def monthly(rows: DataFrame, *keys: str) -> DataFrame:
    return rollup(rows, clock.month_key(F.col("usage_date")), *keys)


def sessions(entries: DataFrame, *keys: str) -> DataFrame:
    """With first and last activity, the project of the latest entry (the first of equals) and the versions seen."""
    latest = F.struct("ts_ms", *(F.negative(c) for c in ("line_ord", "sub_ord")))
    bounds = [F.min("ts_ms").alias("first_ms"), F.max("ts_ms").alias("last_ms"), F.max_by(F.struct("project"), latest)["project"].alias("project"), F.array_sort(F.collect_set("version")).alias("versions")]
    return entries.groupBy("session_id", *keys).agg(*measures(), *bounds)


def having_last_activity(rows: DataFrame, since: str | None = None, until: str | None = None) -> DataFrame:
    """Compares the whole UTC timestamp text, so a session last active on the day `until` names is out."""
    return rows.where(clock.in_window(clock.rfc3339(F.col("last_ms")), since, until))


def model_breakdown(entries: DataFrame, *keys: str, order: Column) -> DataFrame:
    """Per group: `models` by first use, and `breakdown`, a struct a model, dearest first, ties by first use."""
    by_model = entries.where("model is not null").groupBy(*keys, "model").agg(*measures(), F.min(order).alias("seen"), F.max(F.col("missing_model").isNotNull()).alias("missing"))
    entry = F.struct(F.negative(F.coalesce("cost", F.lit(0.0))).alias("less"), "seen", "model", *MEASURES, "missing")
    return by_model.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("seen", "model"))), lambda x: x["model"]).alias("models"),
        F.transform(F.array_sort(F.collect_list(entry)), lambda x: x.dropFields("less", "seen")).alias("breakdown"),
    )


def grand_totals(rows: DataFrame) -> DataFrame:
    return rows.agg(*(F.sum(m).alias(m) for m in MEASURES))


def merge_tools(entries: DataFrame, period: Column, descending: bool = False) -> DataFrame:
    """One row a period: totals, a struct a tool, a struct a model, sorted names. From one grouping by (period, tool, model)."""
    cells = entries.groupBy(period.alias("period"), "tool", "model").agg(*measures())
    per_tool = cells.groupBy("period", "tool").agg(*(F.sum(m).alias(m) for m in MEASURES)).where(F.col("input") + F.col("output") + F.col("cache_create") + F.col("cache_read") + F.col("extra") > 0)
    per_model = cells.where("model is not null").groupBy("period", "model").agg(*(F.sum(m).alias(m) for m in MEASURES))
    tools = per_tool.groupBy("period").agg(*(F.sum(m).alias(m) for m in MEASURES), F.array_sort(F.collect_list(F.struct("tool", *MEASURES))).alias("tools"))
    cheap = F.struct(F.negative("cost").alias("less"), "model", *MEASURES)
    models = per_model.groupBy("period").agg(F.array_sort(F.collect_set("model")).alias("models"), F.transform(F.array_sort(F.collect_list(cheap)), lambda x: x.dropFields("less")).alias("breakdown"))
    out = tools.join(models, "period", "left")
    return out.orderBy(F.desc("period") if descending else F.asc("period"))


def sections(entries: DataFrame, start: int = MONDAY) -> DataFrame:
    """Daily, weekly, monthly and session totals in one pass: section, period, measures."""
    base = entries.withColumns({"_week": clock.week_start(F.col("usage_date"), start), "_month": clock.month_key(F.col("usage_date"))})
    cols = {"daily": "usage_date", "weekly": "_week", "monthly": "_month", "session": "session_id"}
    sets = base.groupingSets([[F.col(c)] for c in cols.values()], *cols.values()).agg(*measures(), *(F.grouping(c).alias(f"_g{c}") for c in cols.values()))
    section = F.coalesce(*(F.when(F.col(f"_g{c}") == 0, F.lit(s)) for s, c in cols.items()))
    return sets.select(section.alias("section"), F.coalesce(*cols.values()).alias("period"), *MEASURES)


def ordered(rows: DataFrame, key: str, descending: bool = False, arrival: str | None = None) -> DataFrame:
    """Equal keys keep their arrival order in either direction."""
    return rows.orderBy(F.desc(key) if descending else F.asc(key), *([arrival] if arrival else []))


def missing_prices(entries: DataFrame) -> DataFrame:
    return entries.where("missing_model is not null").select(F.col("missing_model").alias("model")).distinct().orderBy("model")


def canonical_dump(rows: DataFrame, *columns: str) -> DataFrame:
    """One line of text a row, in order: equal tables give equal dumps."""
    return rows.select(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)).alias("line")).orderBy("line")


