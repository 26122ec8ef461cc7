"""Tools by name, in roster order; more can be registered."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import documents, jsonl, sqlite

SOURCES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register_source(name: str, read: Callable[[SparkSession, str], DataFrame]) -> None:
    if name in SOURCES:
        raise ValueError(f"source {name!r} is registered already")
    SOURCES[name] = read


# The tools' names, in the order in which their entries come.
for _name in ("claude", "codex", "opencode", "amp", "droid", "codebuff", "hermes", "pi", "goose", "openclaw", "kilo", "copilot", "gemini", "kimi", "qwen", "zcode", "omp", "cline"):
    register_source(_name, next(getattr(m, _name) for m in (jsonl, sqlite, documents) if hasattr(m, _name)))


def load(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """All entries of the given tools, in roster order (tool_ord)."""
    names = [n for n in SOURCES if n in paths]
    parts = [SOURCES[n](spark, paths[n]).withColumn("tool_ord", F.lit(i)) for i, n in enumerate(names)]
    return reduce(DataFrame.unionByName, parts)
