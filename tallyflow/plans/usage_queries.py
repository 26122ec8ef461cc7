"""Dedup, pricing, carry-forward and block queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import clock, money, rate_card, text
from ..operators import blocks as B
from ..operators import dedup, pricing
from ..sources.events import usage_entries
from .registry import ENTRIES, PRICED, query
from .report_queries import priced

NOW = 1_706_659_200_000  # 2024-01-31 00:00 UTC
LINES = ("line_ord",)
IDS = ["line_ord", "message_id", "request_id"]


@query(
    """, x AS (SELECT *, max(CASE WHEN is_sidechain THEN 0 ELSE 1 END) OVER (PARTITION BY message_id) AS has_main FROM e),
    y AS (SELECT *, row_number() OVER (PARTITION BY message_id, CASE WHEN has_main = 1 THEN coalesce(request_id, '-') END ORDER BY tokens DESC, CASE WHEN speed IS NULL THEN 1 ELSE 0 END, event_id) AS n FROM x WHERE has_main = 0 OR NOT is_sidechain)
    SELECT event_id, message_id, request_id FROM y WHERE n = 1"""
)
def dedup_generic(spark, d):
    return dedup.dedup_generic(usage_entries(spark, d), LINES).select(F.col("line_ord").alias("event_id"), "message_id", "request_id")


@query(
    """, x AS (SELECT *, max(CASE WHEN is_sidechain THEN 0 ELSE 1 END) OVER w AS has_main, first(is_sidechain) OVER o AS first_side, first(coalesce(request_id, '-')) OVER o AS first_request,
      min(CASE WHEN NOT is_sidechain THEN event_id END) OVER w AS first_main FROM e WINDOW w AS (PARTITION BY message_id), o AS (PARTITION BY message_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
    y AS (SELECT *, event_id = first_main AND first_side AND coalesce(request_id, '-') <> first_request AS single FROM x WHERE has_main = 0 OR NOT is_sidechain),
    z AS (SELECT *, row_number() OVER (PARTITION BY message_id, CASE WHEN has_main = 1 THEN coalesce(request_id, '-') END, single ORDER BY tokens DESC, coalesce(cost_usd, 0) DESC, CASE WHEN speed IS NULL THEN 1 ELSE 0 END, event_id) AS n FROM y)
    SELECT event_id, message_id, request_id FROM z WHERE n = 1"""
)
def dedup_daily(spark, d):
    return dedup.dedup_daily(usage_entries(spark, d), LINES).select(F.col("line_ord").alias("event_id"), "message_id", "request_id")


@query("SELECT event_id, message_id, request_id FROM (SELECT *, row_number() OVER (PARTITION BY message_id, request_id ORDER BY event_id) AS n FROM e) WHERE n = 1 OR request_id IS NULL")
def dedup_first_wins(spark, d):
    return dedup.first_wins(usage_entries(spark, d), ["message_id", "request_id"], LINES).select(F.col("line_ord").alias("event_id"), "message_id", "request_id")


@query("SELECT event_id, message_id FROM (SELECT *, row_number() OVER (PARTITION BY message_id ORDER BY event_id DESC) AS n FROM e) WHERE n = 1")
def dedup_last_wins(spark, d):
    return dedup.first_wins(usage_entries(spark, d), ["message_id"], LINES, last=True).select(F.col("line_ord").alias("event_id"), "message_id")


@query("SELECT event_id, model, input, output, cost_usd FROM (SELECT *, row_number() OVER (PARTITION BY user_id, model, output, cost_usd ORDER BY event_id) AS n FROM e) WHERE n = 1 OR cost_usd IS NULL")
def dedup_composite_identity(spark, d):
    return dedup.first_wins(usage_entries(spark, d), ["raw_session_id", "model", "output", "cost_usd"], LINES).select(F.col("line_ord").alias("event_id"), "model", "input", "output", "cost_usd")


@query("SELECT tool, usage_date, user_id, CASE min(CASE WHEN event_id % 4 = 1 THEN 1 WHEN event_id % 4 = 0 THEN 2 ELSE 3 END) WHEN 1 THEN 'standard' WHEN 2 THEN 'fast' END AS tier FROM e GROUP BY tool, usage_date, user_id")
def dedup_tier_merge(spark, d):
    e = usage_entries(spark, d)
    tier = F.when(F.col("line_ord") % 4 == 1, "standard").when(F.col("line_ord") % 4 == 0, "fast")
    return dedup.merge_tier(e.withColumn("tier", tier), ["tool", "usage_date", "user_id"])


@query("SELECT session_id, event_id, ts_ms FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts_ms DESC, event_id DESC) AS n FROM e) WHERE n = 1")
def latest_per_session(spark, d):
    return dedup.first_wins(usage_entries(spark, d), ["session_id"], ("ts_ms", "line_ord"), last=True).select("session_id", F.col("line_ord").alias("event_id"), "ts_ms")


@query(
    """, t AS (SELECT event_id, user_id, sum(CASE WHEN event_id % 11 = 0 THEN 0 ELSE output END) OVER (PARTITION BY user_id ORDER BY event_id) AS running, sum(input) OVER (PARTITION BY user_id ORDER BY event_id) AS total FROM e),
    u AS (SELECT event_id, CAST(running AS BIGINT) AS running, CAST(total AS BIGINT) AS total, lag(running, 1, 0) OVER w AS r0, lag(total, 1, 0) OVER w AS t0 FROM t WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
    SELECT event_id, CAST(greatest(running - r0, 0) AS BIGINT) AS output, CAST(greatest(total - t0, 0) AS BIGINT) AS input FROM u WHERE running <> r0 OR total <> t0"""
)
def cumulative_delta(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("line_ord")
    e = usage_entries(spark, d).withColumns({"output": F.sum(F.when(F.col("line_ord") % 11 == 0, 0).otherwise(F.col("output"))).over(w), "input": F.sum("input").over(w)})
    return dedup.deltas(e, ["output", "input"], ["user_id"], LINES).select(F.col("line_ord").alias("event_id"), "output", "input")


@query("SELECT event_id, last_value(CASE WHEN event_id % 5 = 0 THEN model END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS model FROM e")
def carry_forward(spark, d):
    e = usage_entries(spark, d).withColumn("model", F.when(F.col("line_ord") % 5 == 0, F.col("model")))
    return dedup.carry_forward(e, "model", ["user_id"], LINES).select(F.col("line_ord").alias("event_id"), "model")


@query("SELECT event_id, round(CASE WHEN priced THEN marginal ELSE 0 END, 8) AS cost FROM m", PRICED)
def cost_marginal(spark, d):
    e = priced(spark, d)
    return e.select(F.col("line_ord").alias("event_id"), F.round(F.when(F.col("rate").isNull(), 0.0).otherwise(money.marginal_cost()), 8).alias("cost"))


@query("SELECT event_id, round(CASE WHEN priced THEN whole ELSE 0 END, 8) AS cost FROM m", PRICED)
def cost_whole_request(spark, d):
    e = priced(spark, d)
    return e.select(F.col("line_ord").alias("event_id"), F.round(F.when(F.col("rate").isNull(), 0.0).otherwise(money.whole_request_cost()), 8).alias("cost"))


@query("SELECT tool, round(sum(coalesce(cost_usd, 0)), 8) AS display, round(sum(cost), 8) AS auto, round(sum(calculated), 8) AS calculate FROM c GROUP BY tool", PRICED)
def cost_modes(spark, d):
    modes = ("display", "auto", "calculate")
    return priced(spark, d).groupBy("tool").agg(*(F.round(F.sum(money.cost(m)), 8).alias(m) for m in modes))


@query("SELECT model, CAST(sum(c1h) AS BIGINT) AS tokens, round(sum(c1h * 2 * i), 8) AS cost FROM j WHERE priced GROUP BY model", PRICED)
def cost_one_hour_cache(spark, d):
    e = priced(spark, d).where("rate is not null")
    return e.groupBy("model").agg(F.sum(money.cache_1h()).alias("tokens"), F.round(F.sum(money.cache_1h() * F.col("rate.input") * money.HOUR_WRITE), 8).alias("cost"))


@query("SELECT model, count(*) AS n, round(sum(calculated), 8) AS cost FROM c WHERE speed = 'fast' AND priced GROUP BY model", PRICED)
def fast_multiplier(spark, d):
    e = priced(spark, d).where("speed = 'fast' and rate is not null")
    return e.groupBy("model").agg(F.count("*").alias("n"), F.round(F.sum(money.token_cost()), 8).alias("cost"))


_CODEX = """, g AS (SELECT usage_date, model, any_value(i) AS i, any_value(o) AS o, any_value(rd) AS rd, any_value(ia) AS ia, any_value(oa) AS oa, any_value(ra) AS ra, any_value(fast) AS fast,
  sum(input) AS input, sum(least(cache_read, input)) AS cached, sum(output) AS output,
  sum(CASE WHEN input > coalesce(threshold, 200000) THEN input ELSE 0 END) AS li, sum(CASE WHEN input > coalesce(threshold, 200000) THEN least(cache_read, input) ELSE 0 END) AS lc, sum(CASE WHEN input > coalesce(threshold, 200000) THEN output ELSE 0 END) AS lo
  FROM j WHERE priced GROUP BY usage_date, model)"""
_BUCKET = "((input - li) - (cached - lc)) * i + (cached - lc) * rd + (output - lo) * o + (li - lc) * coalesce(ia, i) + lc * coalesce(ra, rd) + lo * coalesce(oa, o)"


def codex_groups(spark, d):
    """Usage by date and model with its long-context part."""
    cached = F.least("cache_read", "input")
    long = F.col("input") > F.coalesce("rate.threshold", F.lit(money.MARGINAL_FROM))
    own = {"input": F.col("input"), "cached": cached, "output": F.col("output")}
    sums = [F.sum(c).alias(n) for n, c in own.items()] + [F.sum(F.when(long, c).otherwise(0)).alias(f"long_{n}") for n, c in own.items()]
    return priced(spark, d).where("rate is not null").groupBy("usage_date", "model").agg(*sums, F.first("rate").alias("rate"))


@query(f"{_CODEX} SELECT usage_date, model, CAST(li AS BIGINT) AS long_input, CAST(lc AS BIGINT) AS long_cached, CAST(lo AS BIGINT) AS long_output, round({_BUCKET}, 8) AS cost FROM g", PRICED)
def long_context_split(spark, d):
    g = codex_groups(spark, d)
    return g.select("usage_date", "model", "long_input", "long_cached", "long_output", F.round(money.codex_bucket_cost(), 8).alias("cost"))


@query(f"{_CODEX} SELECT usage_date, model, round({_BUCKET}, 8) AS standard, round(({_BUCKET}) * fast, 8) AS forced_fast FROM g", PRICED)
def codex_speed_policy(spark, d):
    cost = money.codex_bucket_cost()
    return codex_groups(spark, d).select("usage_date", "model", F.round(cost, 8).alias("standard"), F.round(cost + cost * (F.col("rate.fast") - 1.0), 8).alias("forced_fast"))


_NAMES = {
    "claude-sonnet-4-20250514": "claude-sonnet-4",
    "anthropic/claude-opus-4-6": "claude-opus-4-6",
    "[pi] gpt-5": "gpt-5",
    "gpt-5-20260101": "gpt-5",
    "gpt-5.9": None,
    "gpt-5.6": "gpt-5.6-sol",
    "kimi-k2.5": "moonshot/kimi-k2.5",
    "claude-haiku-4.5": "claude-haiku-4-5",
    "glm-4.5-air": "zai/glm-4.5-air",
    "GLM-4.6": "glm-4.6",
    "acme-1": None,
    "us.anthropic.claude-3-haiku-20240307-v1:0": "claude-3-haiku",
}
_VALUES = ", ".join(f"({i}, '{n}', {'NULL' if k is None else repr(k)})" for i, (n, k) in enumerate(_NAMES.items()))


@query(f", v(n, name, key) AS (VALUES {_VALUES}) SELECT name, key, count(*) AS entries FROM e JOIN v ON event_id % {len(_NAMES)} = n GROUP BY name, key")
def model_resolution(spark, d):
    named = usage_entries(spark, d).withColumn("model", F.element_at(F.array(*(F.lit(n) for n in _NAMES)), (F.col("line_ord") % len(_NAMES) + 1).cast("int")))
    keys = pricing.resolve_models(named, rate_card.card(spark))
    return named.groupBy(F.col("model").alias("name")).agg(F.count("*").alias("entries")).join(keys, "name", "left").select("name", "key", "entries")


@query(
    """, n AS (SELECT model || CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN '-mega9' WHEN 2 THEN '-1999' ELSE '-x-y' END AS model, count(*) AS entries FROM e GROUP BY 1),
    v(model, source, input, write5m, read) AS (VALUES ('claude-sonnet-4', 'seed', 3.0, 3.75, 0.3), ('claude-sonnet-4-mega9', 'seed', 3.0, 3.75, 0.3), ('claude-sonnet-4-x-y', 'seed', 3.0, 3.75, 0.3),
      ('gpt-5.4', 'seed', 2.5, 2.5, 0.25), ('gpt-5.4-mega9', 'seed', 2.5, 2.5, 0.25), ('gpt-5.4-x-y', 'seed', 2.5, 2.5, 0.25), ('claude-opus-4-6', 'seed', 5.0, 6.25, 0.5), ('claude-opus-4-6-mega9', 'seed', 5.0, 6.25, 0.5), ('claude-opus-4-6-x-y', 'seed', 5.0, 6.25, 0.5),
      ('gpt-5.6-sol', 'seed', 5.0, 6.25, 0.5), ('gpt-5.6-sol-mega9', 'seed', 5.0, 6.25, 0.5), ('gpt-5.6-sol-1999', 'seed', 5.0, 6.25, 0.5), ('gpt-5.6-sol-x-y', 'seed', 5.0, 6.25, 0.5), ('glm-4.6', 'seed', 0.6, 0.0, 0.11), ('glm-4.6-mega9', 'seed', 0.6, 0.0, 0.11), ('glm-4.6-x-y', 'seed', 0.6, 0.0, 0.11),
      ('claude-sonnet-4-1999', 'family', 3.0, 3.75, 0.3), ('gpt-5.4-1999', 'family', 2.5, 2.5, 0.25), ('claude-opus-4-6-1999', 'family', 5.0, 6.25, 0.5), ('glm-4.6-1999', 'family', 0.6, 0.75, 0.11))
    SELECT model, source, input, write5m, read, entries FROM n JOIN v USING (model)"""
)
def family_fallback(spark, d):
    """The models of the events under names of their families."""
    more = F.element_at(F.array(*(F.lit(x) for x in ("", "-mega9", "-1999", "-x-y"))), (F.col("line_ord") % 4 + 1).cast("int"))
    named = usage_entries(spark, d).select(F.concat("model", more).alias("model"))
    rates = pricing.family_rates(named, rate_card.card(spark))
    counted = named.groupBy("model").agg(F.count("*").alias("entries"))
    return rates.join(counted, "model").select("model", "source", *(F.round(F.col(f"rate.{a}") * 1e6, 6).alias(b) for a, b in (("input", "input"), ("create", "write5m"), ("read", "read"))), "entries")


@query("SELECT event_id, greatest(input - cache_read, 0) AS fresh FROM e")
def cached_overlap(spark, d):
    return usage_entries(spark, d).select(F.col("line_ord").alias("event_id"), text.without_overlap(F.col("input"), F.col("cache_read")).alias("fresh"))


@query(", t AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 0 ELSE output END AS output, input, input * 2 AS total FROM e) SELECT event_id, CASE WHEN output = 0 THEN greatest(total - input - output, 0) ELSE output END AS output, CASE WHEN output = 0 THEN 0 ELSE greatest(total - input - output, 0) END AS extra FROM t")
def total_fallback(spark, d):
    e = usage_entries(spark, d).withColumn("output", F.when(F.col("line_ord") % 3 == 0, 0).otherwise(F.col("output")))
    output, extra = text.total_fallback(F.col("output"), F.col("extra"), F.col("input") + F.col("output"), F.col("input") * 2)
    return e.select(F.col("line_ord").alias("event_id"), output.alias("output"), extra.alias("extra"))


def _block_sql(what: str, by: str, entries: str = "e") -> str:
    return f"""RECURSIVE , s AS (SELECT *, row_number() OVER (PARTITION BY tool ORDER BY ts_ms, event_id) AS n FROM {entries}),
    f(tool, n, ts_ms, start) AS (
      SELECT tool, n, ts_ms, ts_ms - ts_ms % 3600000 FROM s WHERE n = 1
      UNION ALL SELECT s.tool, s.n, s.ts_ms, CASE WHEN s.ts_ms - f.start > 18000000 OR s.ts_ms - f.ts_ms > 18000000 THEN s.ts_ms - s.ts_ms % 3600000 ELSE f.start END FROM f JOIN s ON s.tool = f.tool AND s.n = f.n + 1),
    k AS (SELECT s.*, f.start FROM s JOIN f USING (tool, n)),
    b AS (SELECT tool, start AS block_start, start + 18000000 AS block_end, min(ts_ms) AS first_ms, max(ts_ms) AS last_ms, count(*) AS entries, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(input + output) AS BIGINT) AS fresh, {what} FROM k GROUP BY tool, start)
    {by}"""


_ACTIVE = f"({NOW} - last_ms < 18000000 AND {NOW} < block_end)"


@query(_block_sql("arg_min(limit_reset_ms, ts_ms) FILTER (WHERE limit_reset_ms IS NOT NULL) AS limit_reset_ms", f"SELECT tool, block_start, block_end, first_ms, last_ms, entries, tokens, limit_reset_ms, {_ACTIVE} AS active FROM b"))
def blocks(spark, d):
    found = B.blocks(usage_entries(spark, d).withColumn("cost", F.lit(0.0)), NOW)
    return found.select("tool", "block_start", "block_end", "first_ms", "last_ms", "entries", "tokens", "limit_reset_ms", "active")


_SESSIONS = f"{ENTRIES.strip()}, g AS (SELECT * REPLACE (tool || '/' || session_id AS tool) FROM e)"


@query(_block_sql("0 AS z", ", h AS (SELECT tool, last_ms, lead(first_ms) OVER (PARTITION BY tool ORDER BY first_ms) AS nxt FROM b) SELECT tool, 'gap-' || strftime(make_timestamp((last_ms + 18000000) * 1000), '%Y-%m-%dT%H:%M:%S.%gZ') AS gap_id, last_ms + 18000000 AS gap_start, nxt AS gap_end FROM h WHERE nxt - last_ms > 18000000", "g"), _SESSIONS)
def block_gaps(spark, d):
    # by tool and session: a tool alone has no pause of five hours
    e = usage_entries(spark, d).withColumns({"cost": F.lit(0.0), "tool": F.concat_ws("/", "tool", "session_id")})
    return B.gaps(B.blocks(e, NOW))


_RATES = "CASE WHEN last_ms > first_ms THEN {0} / ((last_ms - first_ms) / 60000.0) END"


@query(_block_sql("sum(cost) AS cost", f"SELECT tool, block_start, round({_RATES.format('tokens')}, 4) AS tokens_per_minute, round({_RATES.format('fresh')}, 4) AS fresh_per_minute, round({_RATES.format('cost')} * 60, 4) AS cost_per_hour FROM b", "c"), PRICED)
def burn_rate(spark, d):
    found = B.burn_rate(B.blocks(priced(spark, d), NOW))
    return found.select("tool", "block_start", *(F.round(c, 4).alias(c) for c in ("tokens_per_minute", "fresh_per_minute", "cost_per_hour")))


@query(_block_sql("sum(cost) AS cost", f", q AS (SELECT *, CAST(round((block_end - {NOW}) / 60000.0) AS BIGINT) AS left_min, {_RATES.format('tokens')} AS tpm, {_RATES.format('cost')} AS cpm FROM b WHERE {_ACTIVE}) SELECT tool, block_start, left_min AS remaining_minutes, CAST(round(tokens + tpm * left_min) AS BIGINT) AS projected_tokens, round(cost + cpm * left_min, 2) AS projected_cost FROM q WHERE tpm IS NOT NULL", "c"), PRICED)
def block_projection(spark, d):
    return B.projection(B.blocks(priced(spark, d), NOW), NOW).select("tool", "block_start", "remaining_minutes", "projected_tokens", "projected_cost")


@query(_block_sql("0 AS z", f", q AS (SELECT max(tokens) FILTER (WHERE NOT {_ACTIVE}) AS most FROM b) SELECT tool, block_start, CASE WHEN tokens > most * 0.9 THEN 'exceeds' WHEN tokens > most * 0.9 * 0.8 THEN 'warning' ELSE 'ok' END AS status FROM b, q"))
def token_limit_status(spark, d):
    found = B.blocks(usage_entries(spark, d).withColumn("cost", F.lit(0.0)), NOW)
    most = found.agg(F.max(F.when(~F.col("active"), F.col("tokens"))).alias("most"))
    return found.crossJoin(F.broadcast(most)).select("tool", "block_start", B.limit_status(F.col("tokens"), F.col("most") * 0.9).alias("status"))


@query(_block_sql("0 AS z", f"SELECT tool, block_start, tokens FROM b WHERE {_ACTIVE} OR block_start >= {NOW - 3 * 86400000}"))
def recent_blocks(spark, d):
    return B.recent(B.blocks(usage_entries(spark, d).withColumn("cost", F.lit(0.0)), NOW), NOW).select("tool", "block_start", "tokens")


@query(
    """, t AS (SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN 't' || (event_id // 6) END AS trace, CASE WHEN event_id % 4 <> 0 THEN 'r' || (event_id // 8) END AS response, event_id % 4 AS rank FROM e),
    u AS (SELECT trace, min(rank) AS b FROM t WHERE trace IS NOT NULL GROUP BY 1), v AS (SELECT response, min(rank) AS b FROM t WHERE response IS NOT NULL GROUP BY 1)
    SELECT event_id, rank FROM t LEFT JOIN u USING (trace) LEFT JOIN v USING (response) WHERE (u.b IS NULL OR rank <= u.b) AND (v.b IS NULL OR rank <= v.b)"""
)
def source_precedence(spark, d):
    i = F.col("line_ord")
    rows = usage_entries(spark, d).select(
        i.alias("event_id"), F.when(i % 3 != 0, F.concat(F.lit("t"), F.floor(i / 6).cast("string"))).alias("trace"), F.when(i % 4 != 0, F.concat(F.lit("r"), F.floor(i / 8).cast("string"))).alias("response"), (i % 4).alias("rank")
    )
    return dedup.best_source(rows, ["trace", "response"]).select("event_id", "rank")


@query(", a AS (SELECT event_id, session_id FROM e WHERE user_id % 40 < 25 AND event_id % 2 = 0) SELECT event_id, session_id FROM a UNION ALL SELECT event_id, session_id FROM e WHERE session_id NOT IN (SELECT session_id FROM a)")
def anti_join_fallback(spark, d):
    rows = usage_entries(spark, d).select(F.col("line_ord").alias("event_id"), "session_id", "user_id")
    preferred = rows.where("user_id % 40 < 25 and event_id % 2 = 0").select("event_id", "session_id")
    return dedup.fallback(rows, preferred, "session_id")


@query(
    """RECURSIVE , l AS (SELECT DISTINCT user_id AS id, CASE WHEN user_id % 7 = 0 THEN NULL WHEN user_id % 50 = 1 THEN user_id + 1 ELSE user_id - 1 END AS parent FROM e),
    up(id, node, path) AS (SELECT id, id, [id] FROM l UNION ALL SELECT up.id, l.parent, list_append(up.path, l.parent) FROM up JOIN l ON l.id = up.node JOIN l p ON p.id = l.parent WHERE NOT list_contains(up.path, l.parent))
    SELECT id, arg_max(node, len(path)) AS root FROM up GROUP BY id"""
)
def parent_attribution(spark, d):
    u = F.col("user_id")
    links = usage_entries(spark, d).select(u.alias("id"), F.when(u % 7 == 0, None).when(u % 50 == 1, u + 1).otherwise(u - 1).alias("parent")).distinct()
    return dedup.top_ancestor(links)


@query(", v(released, model) AS (VALUES ('2025-08-07','gpt-5'), ('2025-09-15','gpt-5-codex'), ('2025-11-13','gpt-5.1-codex'), ('2025-12-11','gpt-5.2-codex'), ('2026-02-05','gpt-5.3-codex'), ('2026-03-05','gpt-5.4'), ('2026-04-23','gpt-5.5')), x AS (SELECT event_id, CAST(CAST('2025-07-01' AS DATE) + CAST(event_id % 320 AS INTEGER) AS VARCHAR) AS day FROM e) SELECT event_id, coalesce((SELECT arg_max(model, released) FROM v WHERE released <= day), 'gpt-5') AS model FROM x")
def asof_model_ladder(spark, d):
    day = F.date_format(F.date_add(F.lit("2025-07-01").cast("date"), (F.col("line_ord") % 320).cast("int")), "yyyy-MM-dd")
    e = usage_entries(spark, d).select(F.col("line_ord").alias("event_id"), day.alias("usage_date"))
    return pricing.review_model(e, rate_card.ladder(spark)).select("event_id", "model")


@query(", s AS (SELECT p_partkey AS key, p_retailprice AS price, p_size AS size FROM part WHERE p_partkey % 3 <> 0), o AS (SELECT p_partkey AS key, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_retailprice * 2 END AS price, p_size + 1 AS size FROM part WHERE p_partkey % 2 = 0) SELECT key, coalesce(o.price, s.price) AS price, coalesce(o.size, s.size) AS size FROM s FULL JOIN o USING (key)")
def override_merge(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("key"), F.col("p_retailprice").alias("price"), F.col("p_size").alias("size"))
    over = p.where("key % 2 = 0").select("key", F.when(F.col("key") % 4 != 0, F.col("price") * 2).alias("price"), (F.col("size") + 1).alias("size"))
    return pricing.merge_overrides(p.where("key % 3 <> 0"), over)


@query("SELECT event_id, strftime(make_timestamp(ts_ms * 1000), '%Y-%m-%dT%H:%M:%S.%gZ') AS text, CASE WHEN event_id % 3 = 0 THEN NULL ELSE ts_ms END AS parsed FROM e")
def timestamp_parsing(spark, d):
    said = clock.rfc3339(F.col("ts_ms"))
    broken = F.when(F.col("line_ord") % 3 == 0, F.substring(said, 1, 10)).otherwise(said)
    return usage_entries(spark, d).select(F.col("line_ord").alias("event_id"), said.alias("text"), clock.parse_ms(broken).alias("parsed"))
