"""Queries by name, each with the SQL that gives the same rows, where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: The usage entries of `sources.events` in SQL.
ENTRIES = """
e AS (
  SELECT *, input + output + c5m + c1h + cache_read AS tokens FROM (
    SELECT event_id, user_id, event_type AS tool, epoch_us(ts) // 1000 AS ts_ms, strftime(ts, '%Y-%m-%d') AS usage_date,
      'p' || (user_id % 9) AS project, 's' || (user_id % 40) AS session_id, CAST(event_id // 3 AS VARCHAR) AS message_id,
      CASE WHEN event_id % 5 <> 0 THEN CAST(event_id % 2 AS VARCHAR) END AS request_id, event_id % 7 = 0 AS is_sidechain,
      '1.0.' || (event_id % 3) AS version,
      CASE event_id % 6 WHEN 0 THEN 'claude-sonnet-4' WHEN 1 THEN 'gpt-5.4' WHEN 2 THEN 'claude-opus-4-6' WHEN 3 THEN 'gpt-5.6-sol' WHEN 4 THEN 'glm-4.6' ELSE 'acme-unpriced-1' END AS model,
      CAST(floor(value * 1000) AS BIGINT) AS input, CAST(json_extract_string(props, '$.k') AS BIGINT) * 100 AS output,
      event_id % 3 * 1000 AS c5m, event_id % 2 * 500 AS c1h, CAST(json_extract_string(props, '$.k') AS BIGINT) * (event_id % 4) * 1000 AS cache_read,
      CASE WHEN event_id % 4 = 0 THEN 'fast' END AS speed, CASE WHEN event_id % 8 = 0 THEN round(value / 50, 4) END AS cost_usd,
      CASE WHEN event_id % 97 = 0 THEN epoch_us(ts) // 1000 + 3600000 END AS limit_reset_ms, 'd' || (user_id % 120) AS device_id
    FROM events))"""
#: Rates of its models for a token, and priced entries.
PRICED = (
    ENTRIES
    + """,
r(model, i, o, w, rd, ia, oa, wa, ra, threshold, fast) AS (VALUES
  ('claude-sonnet-4', 3e-6, 15e-6, 3.75e-6, 0.3e-6, 6e-6, 22.5e-6, 7.5e-6, 0.6e-6, NULL, 1.0),
  ('gpt-5.4', 2.5e-6, 15e-6, 2.5e-6, 0.25e-6, 5e-6, 22.5e-6, 5e-6, 0.5e-6, 272000, 2.0),
  ('claude-opus-4-6', 5e-6, 25e-6, 6.25e-6, 0.5e-6, NULL, NULL, NULL, NULL, NULL, 6.0),
  ('gpt-5.6-sol', 5e-6, 30e-6, 6.25e-6, 0.5e-6, 10e-6, 45e-6, 12.5e-6, 1e-6, 272000, 2.0),
  ('glm-4.6', 0.6e-6, 2.2e-6, 0.0, 0.11e-6, NULL, NULL, NULL, NULL, NULL, 1.0)),
j AS (SELECT e.*, i, o, w, rd, ia, oa, wa, ra, threshold, fast, r.model IS NOT NULL AS priced FROM e LEFT JOIN r USING (model)),
m AS (SELECT *,
  input * i + CASE WHEN input > 200000 AND ia IS NOT NULL THEN (input - 200000) * (ia - i) ELSE 0 END
  + output * o + CASE WHEN output > 200000 AND oa IS NOT NULL THEN (output - 200000) * (oa - o) ELSE 0 END
  + c5m * w + CASE WHEN c5m > 200000 AND wa IS NOT NULL THEN (c5m - 200000) * (wa - w) ELSE 0 END
  + c1h * 2 * i + CASE WHEN c1h > 200000 AND ia IS NOT NULL THEN (c1h - 200000) * 2 * (ia - i) ELSE 0 END
  + cache_read * rd + CASE WHEN cache_read > 200000 AND ra IS NOT NULL THEN (cache_read - 200000) * (ra - rd) ELSE 0 END AS marginal,
  CASE WHEN input > threshold THEN input * ia + output * oa + c5m * wa + c1h * 2 * ia + cache_read * ra
    ELSE input * i + output * o + c5m * w + c1h * 2 * i + cache_read * rd END AS whole FROM j),
p AS (SELECT *, CASE WHEN priced THEN (CASE WHEN threshold IS NOT NULL THEN whole ELSE marginal END) * (CASE WHEN speed = 'fast' THEN fast ELSE 1 END) ELSE 0 END AS calculated FROM m),
c AS (SELECT *, coalesce(cost_usd, calculated) AS cost, CASE WHEN tokens > 0 AND NOT priced AND cost_usd IS NULL THEN model END AS missing_model FROM p)"""
)
#: Sums of the report measures.
SUMS = "CAST(sum(input) AS BIGINT) AS input, CAST(sum(output) AS BIGINT) AS output, CAST(sum(c5m + c1h) AS BIGINT) AS cache_create, CAST(sum(cache_read) AS BIGINT) AS cache_read, round(sum(cost), 8) AS cost"


def query(sql: str | None = None, tables: str = ENTRIES):
    """Register a query under its function's name; `sql` follows WITH and `tables`."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = f"WITH {'RECURSIVE ' if 'RECURSIVE' in sql else ''}{tables.strip()} {sql.replace('RECURSIVE', '')}"
        return f

    return add
