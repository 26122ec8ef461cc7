"""Replayed and repeated records: closed forms of order-dependent rules, by window functions.

`order` gives the arrival order of a row; keys that are null or empty never collapse.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import tokens
from ..scratch import Scratch

ARRIVAL = ("file_ord", "line_ord", "sub_ord")


def _main() -> Column:
    return ~F.coalesce(F.col("is_sidechain"), F.lit(False))


def dedup_generic(entries: DataFrame, order: tuple[str, ...] = ARRIVAL) -> DataFrame:
    """One row for each (message, request): main rows before sidechain replays, then more tokens, then a known speed, then the first.

    A message with a main row loses its sidechain rows whatever their request; without one it is one row.
    """
    has_main = F.max(_main()).over(Window.partitionBy("message_id"))
    bucket = Window.partitionBy("message_id", F.when(F.col("_has_main"), F.col("request_id")))
    best = bucket.orderBy(F.desc(tokens()), F.desc(F.col("speed").isNotNull()), *order)
    known = entries.where("message_id is not null").withColumn("_has_main", has_main).where(~F.col("_has_main") | _main())
    kept = known.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n", "_has_main")
    return kept.unionByName(entries.where("message_id is null"))


def dedup_daily(entries: DataFrame, order: tuple[str, ...] = ARRIVAL) -> DataFrame:
    """As `dedup_generic`, with the recorded cost before the speed; and where a sidechain row came first, the first main row of another request stays beside its own request's best."""
    arrival = F.struct(*order)
    message = Window.partitionBy("message_id")
    known = entries.where("message_id is not null").withColumn("_has_main", F.max(_main()).over(message))
    known = known.withColumns({"_first": F.min(F.struct(arrival, _main().alias("main"), F.col("request_id").alias("r"))).over(message), "_first_main": F.min(F.when(_main(), arrival)).over(message)})
    known = known.where(~F.col("_has_main") | _main())
    single = F.coalesce((arrival == F.col("_first_main")) & ~F.col("_first.main") & ~F.col("request_id").eqNullSafe(F.col("_first.r")), F.lit(False))
    bucket = Window.partitionBy("message_id", F.when(F.col("_has_main"), F.col("request_id")), "_single")
    best = bucket.orderBy(F.desc(tokens()), F.desc(F.coalesce("cost_usd", F.lit(0.0))), F.desc(F.col("speed").isNotNull()), *order)
    kept = known.withColumn("_single", single).withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n", "_has_main", "_first", "_first_main", "_single")
    return kept.unionByName(entries.where("message_id is null"))


def first_wins(rows: DataFrame, keys: list[str], order: tuple[str, ...] = ARRIVAL, last: bool = False) -> DataFrame:
    """The first row (the last, if asked) of each key; a row with a null or empty key part stays."""
    no_key = F.lit(False)
    for k in keys:
        no_key = no_key | F.col(k).isNull() | (F.col(k).cast("string") == "")
    by = Window.partitionBy(*keys, F.when(no_key, F.struct(*order))).orderBy(*(F.desc(c) if last else F.asc(c) for c in order))
    return rows.withColumn("_n", F.row_number().over(by)).where("_n = 1").drop("_n")


def merge_tier(events: DataFrame, keys: list[str], tier: str = "tier") -> DataFrame:
    """One row a key with the strongest service tier seen: standard before fast before none."""
    rank = F.when(F.col(tier) == "standard", 1).when(F.col(tier) == "fast", 2).otherwise(3)
    return events.groupBy(*keys).agg(F.min(rank).alias("_rank")).select(*keys, F.when(F.col("_rank") == 1, F.lit("standard")).when(F.col("_rank") == 2, F.lit("fast")).alias(tier))


def carry_forward(rows: DataFrame, column: str, by: list[str], order: tuple[str, ...] = ARRIVAL) -> DataFrame:
    """Nulls take the last value before them."""
    before = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(column, F.last(column, ignorenulls=True).over(before))


def deltas(rows: DataFrame, counters: list[str], by: list[str], order: tuple[str, ...] = ARRIVAL) -> DataFrame:
    """Running totals become what each row adds, never below 0; a row that adds nothing goes."""
    before = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.where(F.col(counters[0]).isNotNull()).withColumns({f"_{c}": F.coalesce(F.last(c, ignorenulls=True).over(before), F.lit(0)) for c in counters})
    changed = F.lit(False)
    for c in counters:
        changed = changed | (F.col(c) != F.col(f"_{c}"))
    return out.where(changed).withColumns({c: F.greatest(F.col(c) - F.col(f"_{c}"), F.lit(0)) for c in counters}).drop(*(f"_{c}" for c in counters))


def best_source(rows: DataFrame, keys: list[str], rank: str = "rank") -> DataFrame:
    """Drops a row if a source of lower rank reports one of its keys; null keys never match, and their rows are spread by what else they hold."""
    out = rows
    spread = F.xxhash64(*(F.col(c) for c, t in rows.dtypes if "map<" not in t))
    for k in keys:
        by = Window.partitionBy(k, F.when(F.col(k).isNull(), spread))
        out = out.withColumn(f"_{k}", F.when(F.col(k).isNotNull(), F.min(rank).over(by)))
    for k in keys:
        out = out.where(F.col(f"_{k}").isNull() | (F.col(rank) <= F.col(f"_{k}"))).drop(f"_{k}")
    return out


def fallback(rows: DataFrame, preferred: DataFrame, key: str) -> DataFrame:
    """`preferred`, and those of `rows` whose key it does not have."""
    return preferred.unionByName(rows.join(preferred.select(key).distinct(), key, "left_anti").select(*preferred.columns))


def _tops(up: DataFrame, scratch: Scratch, name: str) -> tuple[DataFrame, DataFrame]:
    """Pointer doubling over (id, parent), where a null parent is none. Returns id and top of the ids that have one, and the ids whose way runs in a loop.

    After round k, `node` is 2^k steps up, or the top. Ids that are met 2^k steps up grow fewer each round until only loops are left.
    """
    now, met, k = scratch.keep(up.select("id", F.coalesce("parent", "id").alias("node"), F.col("parent").isNotNull().alias("open")), f"{name}-0"), None, 0
    while True:
        open_nodes = now.where("open").agg(F.countDistinct("node")).first()[0]
        if open_nodes == 0 or open_nodes == met:
            return now.where("not open").select("id", F.col("node").alias("top")), now.where("open").select(F.col("node").alias("id")).distinct()
        met, k = open_nodes, k + 1
        above = now.select(F.col("id").alias("node"), F.col("node").alias("_node"), F.col("open").alias("_open"))
        moved = now.where("open").join(above, "node").select("id", F.col("_node").alias("node"), F.col("_open").alias("open"))
        now = scratch.keep(now.where("not open").unionByName(moved), f"{name}-{k}")


def top_ancestor(links: DataFrame) -> DataFrame:
    """id and root of each (id, parent): parents are followed until there is none among the ids, or a loop closes.

    In a loop the root is the last session before the one where the loop was entered. An id with several parents has the smallest.
    """
    scratch = Scratch(links.sparkSession, "ancestors")
    up = links.where("id is not null").groupBy("id").agg(F.min("parent").alias("parent"))
    up = up.join(up.select(F.col("id").alias("parent"), F.lit(True).alias("_there")), "parent", "left").select("id", F.when(F.col("_there"), F.col("parent")).alias("parent"))
    up = scratch.keep(up, "links")
    tops, loops = _tops(up, scratch, "all")
    if not loops.head(1):
        return tops.withColumnRenamed("top", "root")
    # Cut at every session of a loop, each way ends where it enters; what points there closes the loop.
    loops = scratch.keep(loops, "loops")
    cut = up.join(loops.withColumn("_loop", F.lit(True)), "id", "left").select("id", F.when(F.col("_loop").isNull(), F.col("parent")).alias("parent"))
    entered, _ = _tops(cut, scratch, "cut")
    last = up.join(loops, "id", "left_semi").select(F.col("parent").alias("top"), F.col("id").alias("_last"))
    return entered.join(last, "top", "left").select("id", F.coalesce("_last", "top").alias("root"))
