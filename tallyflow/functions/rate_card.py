"""The built-in rate card: US dollars for a million tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Model, input, output, cache write, cache read.
RATES = """
claude-opus-4-5 5 25 6.25 0.5
claude-opus-4-6 5 25 6.25 0.5
claude-opus-4-7 5 25 6.25 0.5
claude-opus-4-8 5 25 6.25 0.5
claude-haiku-4-5 1 5 1.25 0.1
claude-opus-4 15 75 18.75 1.5
claude-sonnet-4-6 3 15 3.75 0.3
claude-sonnet-4 3 15 3.75 0.3
claude-3-5-haiku 0.8 4 1 0.08
claude-3-5-haiku-20241022 0.8 4 1 0.08
claude-3-opus 15 75 18.75 1.5
claude-3-sonnet 3 15 3.75 0.3
claude-3-haiku 0.25 1.25 0.3 0.03
gpt-5 1.25 10 1.25 0.125
gpt-5.1 1.25 10 1.25 0.125
gpt-5.1-codex 1.25 10 1.25 0.125
gpt-5.2 1.75 14 1.75 0.175
gpt-5.2-codex 1.75 14 1.75 0.175
gpt-5.3-codex 1.75 14 1.75 0.175
gpt-5.4 2.5 15 2.5 0.25
gpt-5.4-mini 0.75 4.5 0.75 0.075
gpt-5.4-nano 0.2 1.25 0.2 0.02
gpt-5.5 5 30 5 0.5
gpt-5.6-sol 5 30 6.25 0.5
gpt-5.6-terra 2.5 15 3.125 0.25
gpt-5.6-luna 1 6 1.25 0.1
grok-4.3 1.25 2.5 1.25 0.125
moonshot/kimi-k2.5 0.6 3 0.75 0.1
moonshot/kimi-k2.6 0.95 4 1.1875 0.16
glm-4.5 0.6 2.2 0 0.11
zai/glm-4.5 0.6 2.2 0 0.11
zai/glm-4.5-x 2.2 8.9 0 0.45
zai/glm-4.5-air 0.2 1.1 0 0.03
zai/glm-4.5-airx 1.1 4.5 0 0.22
zai/glm-4.5v 0.6 1.8 0 0.11
zai/glm-4-32b-0414-128k 0.1 0.1 0 0
zai/glm-4.5-flash 0 0 0 0
glm-4.6 0.6 2.2 0 0.11
glm-4.7 0.6 2.2 0 0.11
glm-5 1 3.2 0 0.2
glm-5-turbo 1.2 4 0 0.24
glm-5.1 1.4 4.4 0 0.26
"""
# Rates above a threshold of input tokens; `-` for none. Without a threshold of its own a model
# is priced marginally from 200,000 tokens on.
ABOVE = """
claude-sonnet-4 - 6 22.5 7.5 0.6
gpt-5.4 272000 5 22.5 5 0.5
gpt-5.4-pro 272000 60 270 - -
gpt-5.5 272000 10 45 10 1
gpt-5.5-pro 272000 60 270 - -
gpt-5.6-sol 272000 10 45 12.5 1
gpt-5.6-terra 272000 5 22.5 6.25 0.5
gpt-5.6-luna 272000 2 9 2.5 0.2
"""
# Price of a fast request over a standard one.
FAST = {"gpt-5.6-sol": 2.0, "gpt-5.6-terra": 2.0, "gpt-5.6-luna": 2.0, "gpt-5.5": 2.5, "gpt-5.4": 2.0, "gpt-5.3-codex": 2.0, "claude-opus-4-6": 6.0, "claude-opus-4-7": 6.0, "claude-opus-4-8": 2.0}
# Models whose cache read rate was not published but derived.
READ_DERIVED = {"grok-4.3"}
# Names that stand for another.
ALIASES = {"gpt-5.6": "gpt-5.6-sol", "gpt-5.3-spark": "gpt-5.3-codex-spark"}
# Context windows in tokens.
CONTEXT = """
gpt-5.4 1050000
gpt-5.5 1050000
gpt-5.6-sol 1050000
gpt-5.6-terra 1050000
gpt-5.6-luna 1050000
grok-4.3 1000000
claude-opus-4-8 1000000
claude-opus-4-7 1000000
claude-opus-4-6 1000000
claude-sonnet-4-6 1000000
moonshot/kimi-k2.5 262144
moonshot/kimi-k2.6 262144
claude-opus-4-5 200000
claude-haiku-4-5 200000
claude-opus-4 200000
claude-sonnet-4 200000
claude-3-5-haiku 200000
claude-3-5-haiku-20241022 200000
claude-3-opus 200000
claude-3-sonnet 200000
claude-3-haiku 200000
"""
# The name of an automatic review's model, and the model behind it by release date.
REVIEW = "codex-auto-review"
REVIEW_LADDER = """
2025-08-07 gpt-5
2025-09-15 gpt-5-codex
2025-11-13 gpt-5.1-codex
2025-12-11 gpt-5.2-codex
2026-02-05 gpt-5.3-codex
2026-03-05 gpt-5.4
2026-04-23 gpt-5.5
"""

SCHEMA = "key string, input double, output double, create double, read double, input_above double, output_above double, create_above double, read_above double, threshold bigint, read_explicit boolean, fast double, context bigint"


def _table(text: str) -> dict[str, list[float | None]]:
    return {a: [None if x == "-" else float(x) for x in rest] for a, *rest in (line.split() for line in text.split("\n") if line)}


def rows(overrides: dict[str, dict[str, float]] | None = None) -> list[tuple]:
    """The card's rows with the user's overrides: any of input, output, create, read, fast, context.

    A new input price moves the cache rates in proportion unless they are given too; a new model derives
    them: writes at 1.25, reads at 0.1 of the input price.
    """
    rates, above, context = _table(RATES), _table(ABOVE), _table(CONTEXT)
    fast, explicit = dict(FAST), {m: m not in READ_DERIVED for m in rates}
    for model, given in (overrides or {}).items():
        old = rates.get(model)
        price = given.get("input", old[0] if old else 0.0)
        scale = price / old[0] if old and old[0] else 1.0
        create, read = (old[2] * scale, old[3] * scale) if old else (1.25 * price, 0.1 * price)
        rates[model] = [price, given.get("output", old[1] if old else 0.0), given.get("create", create), given.get("read", read)]
        explicit[model] = "read" in given or explicit.get(model, False)
        if "fast" in given:
            fast[model] = given["fast"]
        if "context" in given:
            context[model] = [given["context"]]
    out = []
    for model, (price, output, create, read) in rates.items():
        threshold, *higher = above.get(model, [None] * 5)
        out.append((model, *(x / 1e6 if x is not None else None for x in (price, output, create, read, *higher)), int(threshold) if threshold else None, explicit[model], fast.get(model, 1.0), int(context[model][0]) if model in context else None))
    return out


def card(spark: SparkSession, overrides: dict[str, dict[str, float]] | None = None) -> DataFrame:
    return spark.createDataFrame(rows(overrides), SCHEMA)


def ladder(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([tuple(line.split()) for line in REVIEW_LADDER.split("\n") if line], "released string, model string")
