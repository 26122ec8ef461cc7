"""Billing blocks: sessions cut by length and by pause, their burn rates and projections.

A block begins on the hour (UTC) of its first entry. The next entry opens another block if it comes more
than the block's length after that hour, or after the entry before.

Cuts only depend on which multiples of the common part of an hour and the length entries lie between, so
entries are first reduced to points: those exactly on a multiple, and those between it and the next. What
is folded in order is the points of one island without a long pause, never the entries.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import clock
from ..functions.money import tokens


def with_blocks(entries: DataFrame, hours: float = 5, by: tuple[str, ...] = ("tool",)) -> DataFrame:
    """`entries` with `block_start` (milliseconds)."""
    length = int(hours * clock.HOUR_MS)
    step = math.gcd(clock.HOUR_MS, length)
    slot = F.col("ts_ms") - F.pmod("ts_ms", F.lit(step))
    marked = entries.withColumns({"_slot": slot, "_exact": F.col("ts_ms") == slot})
    points = marked.groupBy(*by, "_slot", "_exact").agg(F.min("ts_ms").alias("first"), F.max("ts_ms").alias("last"))
    line = Window.partitionBy(*by).orderBy("first")
    points = points.withColumn("pause", F.coalesce((F.col("first") - F.lag("last").over(line) > length).cast("int"), F.lit(0)))
    points = points.withColumn("island", F.sum("pause").over(line))
    start = F.struct(F.lit(None).cast("bigint").alias("start"), F.array().cast("array<struct<first:bigint,start:bigint>>").alias("cuts"))

    def step_over(state: Column, p: Column) -> Column:
        cut = state["start"].isNull() | (p - state["start"] > length)
        opened = F.when(cut, p - F.pmod(p, F.lit(clock.HOUR_MS))).otherwise(state["start"])
        cuts = F.when(cut, F.concat(state["cuts"], F.array(F.struct(p.alias("first"), opened.alias("start"))))).otherwise(state["cuts"])
        return F.struct(opened.alias("start"), cuts.alias("cuts"))

    firsts = points.groupBy(*by, "island").agg(F.array_sort(F.collect_list("first")).alias("firsts"))
    folded = firsts.select(*by, "island", F.explode(F.aggregate("firsts", start, step_over)["cuts"]).alias("c"))
    cuts = folded.select(*by, "island", "c.first", "c.start")
    inside = Window.partitionBy(*by, "island").orderBy("first").rowsBetween(Window.unboundedPreceding, 0)
    placed = points.join(cuts, [*by, "island", "first"], "left").withColumn("block_start", F.last("start", ignorenulls=True).over(inside))
    return marked.join(placed.select(*by, "_slot", "_exact", "block_start"), [*by, "_slot", "_exact"]).drop("_slot", "_exact")


def blocks(entries: DataFrame, now_ms: int, hours: float = 5, by: tuple[str, ...] = ("tool",)) -> DataFrame:
    """A row a block: bounds, counters, cost, first limit reset, whether it is active at `now_ms`."""
    length = int(hours * clock.HOUR_MS)
    arrival = F.struct("ts_ms", "file_ord", "line_ord", "sub_ord")
    out = with_blocks(entries, hours, by).groupBy(*by, "block_start").agg(
        F.min("ts_ms").alias("first_ms"),
        F.max("ts_ms").alias("last_ms"),
        F.count("*").alias("entries"),
        F.sum(tokens()).alias("tokens"),
        F.sum(F.col("input") + F.col("output")).alias("fresh_tokens"),
        F.sum("cost").alias("cost"),
        F.min_by("limit_reset_ms", F.when(F.col("limit_reset_ms").isNotNull(), arrival)).alias("limit_reset_ms"),
    )
    out = out.withColumn("block_end", F.col("block_start") + length)
    return out.withColumn("active", (F.lit(now_ms) - F.col("last_ms") < length) & (F.lit(now_ms) < F.col("block_end")))


def gaps(found: DataFrame, hours: float = 5, by: tuple[str, ...] = ("tool",)) -> DataFrame:
    """The pauses between blocks that are longer than a block: from `hours` after the last entry to the next."""
    length = int(hours * clock.HOUR_MS)
    line = Window.partitionBy(*by).orderBy("first_ms")
    pairs = found.select(*by, F.col("last_ms").alias("before"), F.lead("first_ms").over(line).alias("gap_end"))
    gap = pairs.where(F.col("gap_end") - F.col("before") > length).withColumn("gap_start", F.col("before") + length)
    return gap.select(*by, F.concat(F.lit("gap-"), clock.rfc3339(F.col("gap_start"))).alias("gap_id"), "gap_start", "gap_end")


def burn_rate(found: DataFrame) -> DataFrame:
    """Tokens a minute, fresh tokens a minute, cost an hour; null for a block of one instant."""
    minutes = (F.col("last_ms") - F.col("first_ms")) / 60_000.0
    rate = lambda c: F.when(minutes > 0, F.col(c) / minutes)
    return found.withColumns({"tokens_per_minute": rate("tokens"), "fresh_per_minute": rate("fresh_tokens"), "cost_per_hour": rate("cost") * 60.0})


def projection(found: DataFrame, now_ms: int) -> DataFrame:
    """Where active blocks with a burn rate end up at their end."""
    left = F.round((F.col("block_end") - F.lit(now_ms)) / 60_000.0)
    rates = burn_rate(found).where("active and tokens_per_minute is not null").withColumn("remaining_minutes", left.cast("bigint"))
    return rates.withColumns(
        {
            "projected_tokens": F.round(F.col("tokens") + F.col("tokens_per_minute") * F.col("remaining_minutes")).cast("bigint"),
            "projected_cost": F.round(F.col("cost") + F.col("cost_per_hour") / 60.0 * F.col("remaining_minutes"), 2),
        }
    )


def limit_status(value: Column, limit: Column) -> Column:
    """Beyond the limit, beyond four fifths of it, or below."""
    return F.when(value > limit, F.lit("exceeds")).when(value > limit * 0.8, F.lit("warning")).otherwise(F.lit("ok"))


def parse_limit(text: str | None, most: int) -> int | None:
    """`max` or nothing: the largest completed block; else the leading whole number."""
    if text in (None, "", "max"):
        return most or None
    digits = ""
    for ch in text:
        if not ch.isdigit():
            break
        digits += ch
    return int(digits) if digits else None


def recent(found: DataFrame, now_ms: int, days: int = 3, active_only: bool = False) -> DataFrame:
    return found.where("active") if active_only else found.where(F.col("active") | (F.col("block_start") >= now_ms - days * clock.DAY_MS))
