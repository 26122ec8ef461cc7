"""Rules that depend on order, against plain folds over random streams; prices and names by value."""

import random

import pytest
from pyspark.sql import functions as F

from tallyflow.functions import clock, money, rate_card, text
from tallyflow.operators import blocks, cube, dedup, pricing
from tallyflow.operators.ranking import row_numbers
from tallyflow.schema import canonical

H = clock.HOUR_MS


def entries(spark, rows, schema):
    return canonical(spark.createDataFrame(rows, schema))


def fold_blocks(times, length):
    out, start, last = [], None, None
    for t in sorted(times):
        if start is None or t - start > length or t - last > length:
            start = t - t % H
        last = t
        out.append((t, start))
    return out


@pytest.mark.parametrize("hours", [5, 1, 2.5])
def test_blocks_equal_the_fold(spark, hours):
    rng = random.Random(int(hours * 10))
    rows = []
    for tool in range(25):
        t = rng.randrange(0, 5 * H)
        for _ in range(30):
            t += rng.choice([0, 1, rng.randrange(H), rng.randrange(8 * H), H - t % H, int(hours * H), int(hours * H) + 1])
            rows.append((f"t{tool}", t))
    got = blocks.with_blocks(entries(spark, rows, "tool string, ts_ms long"), hours).select("tool", "ts_ms", "block_start").collect()
    expected = [(tool, *x) for tool in {r[0] for r in rows} for x in fold_blocks([t for n, t in rows if n == tool], int(hours * H))]
    assert sorted(map(tuple, got)) == sorted(expected)


def fold_dedup(rows, daily=False):
    """Row by row: rows are (order, message, request, side, tokens, cost, speed). A slot holds the best row that came to it.

    A row goes to the slot it was filed under if that still has its request, else to a slot of its message that
    is, or it is itself, a sidechain, else to a new one. Only the generic rule files a slot anew when its row changes.
    """
    slots, filed = [], {}
    rank = lambda r: (not r[3], r[4], *([r[5] or 0] if daily else []), r[6] is not None)
    for r in rows:
        _, mid, rid, side, *_ = r
        if mid is None:
            slots.append(r)
            continue
        mine = filed.setdefault(mid, {})
        at = next((i for i, keys in mine.items() if rid in keys and slots[i][2] == rid), None)
        if at is None:
            at = next((i for i in mine if side or slots[i][3]), None)
        if at is None:
            mine[len(slots)] = {rid}
            slots.append(r)
        elif rank(r) > rank(slots[at]):
            slots[at] = r
            if not daily:
                mine[at].add(rid)
    return sorted(r[0] for r in slots)


@pytest.mark.parametrize("daily", [False, True])
def test_dedup_equals_the_fold(spark, daily):
    rng = random.Random(11)
    streams = []
    for s in range(300):
        for k in range(rng.randint(1, 7)):
            streams.append((s * 10 + k, rng.choice([f"{s}a", f"{s}b", None]), rng.choice(["r1", "r2", None]), rng.random() < 0.4, rng.randint(1, 3), rng.choice([None, 1.0, 2.0]), rng.choice([None, "fast"])))
    df = entries(spark, streams, "line_ord long, message_id string, request_id string, is_sidechain boolean, input long, cost_usd double, speed string")
    got = (dedup.dedup_daily if daily else dedup.dedup_generic)(df, ("line_ord",))
    expected = []
    for s in range(300):
        expected += fold_dedup([r for r in streams if r[0] // 10 == s], daily)
    assert sorted(r["line_ord"] for r in got.collect()) == sorted(expected)


def cost_of(spark, model, **usage):
    split = usage.pop("split", None)
    row = {"model": model, "input": 0, "output": 0, "cache_read": 0, "cache_flat": 0, "speed": None, "cost_usd": None} | usage
    df = canonical(spark.createDataFrame([tuple(row.values())], "model string, input long, output long, cache_read long, cache_flat long, speed string, cost_usd double"))
    if split:
        df = df.withColumn("cache_split", F.struct(F.lit(split[0]).cast("bigint").alias("c5m"), F.lit(split[1]).cast("bigint").alias("c1h")))
    return pricing.with_rates(df, rate_card.card(spark)).select(*(money.cost(m).alias(m) for m in ("display", "auto", "calculate")), money.missing_model("auto").alias("missing")).first()


def test_costs(spark):
    assert cost_of(spark, "claude-sonnet-4", input=300_000)["auto"] == pytest.approx(200_000 * 3e-6 + 100_000 * 6e-6)
    assert cost_of(spark, "claude-sonnet-4", input=200_000)["auto"] == pytest.approx(0.6)
    assert cost_of(spark, "gpt-5.4", input=272_000, output=10)["auto"] == pytest.approx(272_000 * 2.5e-6 + 10 * 15e-6)
    assert cost_of(spark, "gpt-5.4", input=272_001, output=10, cache_read=100)["auto"] == pytest.approx(272_001 * 5e-6 + 10 * 22.5e-6 + 100 * 0.5e-6)
    assert cost_of(spark, "claude-opus-4-6", split=(1000, 100), cache_flat=9, speed="fast")["auto"] == pytest.approx(6 * (1000 * 6.25e-6 + 100 * 10e-6))
    row = cost_of(spark, "acme", input=5, cost_usd=0.25)
    assert (row["display"], row["auto"], row["calculate"], row["missing"]) == (0.25, 0.25, 0.0, None)
    assert cost_of(spark, "acme", input=5)["missing"] == "acme" and cost_of(spark, "acme")["missing"] is None


def test_overrides_scale_cache_rates(spark):
    rows = {r[0]: r for r in rate_card.rows({"gpt-5": {"input": 2.5}, "new": {"input": 4.0, "output": 8.0}, "glm-5": {"input": 2.0, "read": 0.5}})}
    assert rows["gpt-5"][1:5] == pytest.approx((2.5e-6, 10e-6, 2.5e-6, 0.25e-6))
    assert rows["new"][1:5] == pytest.approx((4e-6, 8e-6, 5e-6, 0.4e-6)) and rows["glm-5"][4] == pytest.approx(0.5e-6)


def test_names(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert one(text.droid_model(F.lit("custom:GPT-5.2 (Max)[beta]"))) == "gpt-5-2-(max)"
    assert one(text.clean_model(F.lit(" [pi] GPT-5 "))) == "gpt-5"
    assert one(text.without_date(F.lit("gpt-5.5-2026-04-23"))) == "gpt-5.5" and one(text.without_date(F.lit("claude-3-haiku-20240307"))) == "claude-3-haiku"
    assert one(text.short_model(F.lit("anthropic/claude-sonnet-4-20250514"))) == "sonnet-4"
    assert one(text.provider_of(F.lit("claude-x"), {"claude": "anthropic", "gpt": "openai"})) == "anthropic"
    assert one(text.cn_units(F.lit(123_456_789))) == "1.23亿" and one(clock.remaining_text(F.lit(125))) == "2h 5m left"
    assert one(clock.week_start(F.lit("no date"))) == "no date" and one(clock.week_start(F.lit("2026-01-01"), 1)) == "2025-12-29"
    for bad in ("2026-02-28", "2026-02-30T00:00:00Z", "2026-02-28T00:00:00.12Z", "x"):
        assert one(clock.parse_ms(F.lit(bad))) is None
    assert one(clock.parse_ms(F.lit("2026-02-28T01:00:00.123+01:00"))) == 1772236800123


def test_latest_report_wins_and_an_empty_day_clears_nothing(spark):
    schema = "device_id string, date string, hour int, tool string, model string, input long"
    stored = spark.createDataFrame([("d", "2026-01-01", 1, "t", "m", 5), ("d", "2026-01-02", 1, "t", "m", 6)], schema)
    got = cube.latest_wins(stored, spark.createDataFrame([("d", "2026-01-01", 2, "t", "m", 7)], schema)).collect()
    assert sorted(r["input"] for r in got) == [6, 7]
    assert cube.latest_wins(stored, spark.createDataFrame([], schema)).count() == 2


def test_parse_limit():
    assert [blocks.parse_limit(x, 9) for x in (None, "", "max", "12k", "x")] == [9, 9, 9, 12, None] and blocks.parse_limit("max", 0) is None


def test_ancestors_of_long_chains_and_loops(spark):
    chain = [(f"c{i:03}", f"c{i - 1:03}" if i else None) for i in range(400)]
    loop = [("a", "b"), ("b", "c"), ("c", "a"), ("x", "b"), ("y", "x"), ("self", "self"), ("under", "self"), ("lost", "nowhere")]
    links = spark.createDataFrame(chain + loop, "id string, parent string")
    parent = dict(chain + loop)

    def root(i):
        seen = {i}
        while parent[i] in parent and parent[i] not in seen:
            i = parent[i]
            seen.add(i)
        return i

    assert {r["id"]: r["root"] for r in dedup.top_ancestor(links).collect()} == {i: root(i) for i in parent}
    assert dedup.top_ancestor(links.where("false")).collect() == []


def test_gaps_lie_between_blocks_that_are_far_apart(spark):
    rows = [("a", 0, 2 * H), ("a", 7 * H, 8 * H), ("a", 14 * H, 15 * H), ("b", 100 * H, 101 * H)]
    found = spark.createDataFrame(rows, "tool string, first_ms long, last_ms long")
    got = [tuple(r) for r in blocks.gaps(found).collect()]
    assert got == [("a", "gap-1970-01-01T13:00:00.000Z", 13 * H, 14 * H)]


def test_streaks_end_today_or_yesterday_and_break(spark):
    days = {
        1: [("2024-01-10", 5), ("2024-01-09", 1), ("2024-01-08", 1), ("2024-01-06", 1)],  # broken on the 7th
        2: [("2024-01-09", 5), ("2024-01-08", 2), ("2024-01-05", 2)],  # nothing today yet
        3: [("2024-01-10", 0), ("2024-01-09", 5)],  # today has rows, but no tokens
        4: [("2024-01-07", 5)],
        5: [("2024-01-11", 5), ("2024-01-10", 5)],  # a day ahead
    }
    rows = [(u, d, h, t, 0, 0, 0, 0) for u, own in days.items() for d, t in own for h in (3, 20)]
    df = spark.createDataFrame(rows, "user_id long, date string, hour int, input long, output long, cache_read long, cache_5m long, cache_1h long")
    got = {r["user_id"]: (r["active_days"], r["streak"]) for r in cube.streaks(df, "2024-01-10", "user_id").collect()}
    assert got == {1: (4, 3), 2: (3, 2), 3: (2, 0), 4: (1, 0), 5: (2, 1)}


def test_limits_equal_the_fold_over_batches_of_any_size(spark):
    """One hot token, ties, a token of one request, requests without a token or a time; a key goes over many Arrow batches."""
    rng = random.Random(5)
    asked = [("hot", rng.randrange(4000)) for _ in range(900)] + [("b", 7), ("b", 7), ("b", 107), ("c", 1)] + [(None, t) for t in (3, 1, 2, 500)]
    want, state = [], {}
    for token, ts in sorted(asked, key=lambda r: (str(r[0]), r[1])):
        opened, used = state.get(token, (None, 0))
        if opened is None or ts - opened >= 100:
            opened, used = ts, 0
        state[token] = opened, used + 1
        want.append((str(token), ts, opened, used < 2))
    rows = spark.createDataFrame([(*r, "more") for r in asked] + [("hot", None, "more")], "token string, ts_ms long, kind string")
    for size in ("7", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        got = cube.within_limit(rows, 2, 100).collect()
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert sorted((str(r["token"]), r["ts_ms"], r["window_ms"], r["allowed"]) for r in got if r["ts_ms"] is not None) == sorted(want)
        assert [(r["window_ms"], r["allowed"], r["kind"]) for r in got if r["ts_ms"] is None] == [(None, None, "more")]
    assert cube.within_limit(rows.where("false")).collect() == []


def test_row_numbers_are_those_of_one_sort(spark):
    rows = spark.range(500).select("id", (F.col("id") * 37 % 11).alias("v"))
    got = {r["id"]: r["n"] for r in row_numbers(rows, "n", F.desc("v"), F.asc("id")).collect()}
    assert got == {i: n for n, i in enumerate(sorted(range(500), key=lambda i: (-(i * 37 % 11), i)), 1)}
    assert row_numbers(rows.where("false"), "n", F.asc("id")).collect() == []


def test_source_precedence_leaves_rows_without_keys(spark):
    rows = spark.createDataFrame([(1, "t", None, 1, {}), (2, "t", "r", 2, {}), (3, None, "r", 3, {}), (4, None, None, 9, {}), (5, None, None, 9, {}), (6, "u", "r", 2, {})], "id int, trace string, response string, rank int, more map<string,string>")
    assert sorted(r["id"] for r in dedup.best_source(rows, ["trace", "response"]).collect()) == [1, 4, 5, 6]
