"""A fixed reading of the `events` table as usage entries, for tests and benchmarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import clock
from ..schema import canonical

MODELS = ("claude-sonnet-4", "gpt-5.4", "claude-opus-4-6", "gpt-5.6-sol", "glm-4.6", "acme-unpriced-1")


def usage_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical entries with user_id; the order of arrival is line_ord, the event's id."""
    return as_entries(spark.read.parquet(f"{sf_dir}/events.parquet"))


def as_entries(e: DataFrame) -> DataFrame:
    """The reading itself, for a table or a stream of events."""
    i, k = F.col("event_id"), F.get_json_object("props", "$.k").cast("bigint")
    ts = F.unix_millis(F.col("ts").cast("timestamp"))
    rows = e.select(
        F.col("event_type").alias("tool"),
        ts.alias("ts_ms"),
        clock.local_date(ts).alias("usage_date"),
        F.concat(F.lit("p"), (F.col("user_id") % 9).cast("string")).alias("project"),
        F.concat(F.lit("s"), (F.col("user_id") % 40).cast("string")).alias("session_id"),
        F.floor(i / 3).cast("string").alias("message_id"),
        F.when(i % 5 != 0, (i % 2).cast("string")).alias("request_id"),
        F.col("user_id").cast("string").alias("raw_session_id"),
        (i % 7 == 0).alias("is_sidechain"),
        F.concat(F.lit("1.0."), (i % 3).cast("string")).alias("version"),
        F.element_at(F.array(*(F.lit(m) for m in MODELS)), (i % 6 + 1).cast("int")).alias("model"),
        F.floor(F.col("value") * 1000).cast("bigint").alias("input"),
        (k * 100).alias("output"),
        F.struct(((i % 3) * 1000).alias("c5m"), ((i % 2) * 500).alias("c1h")).alias("cache_split"),
        (k * (i % 4) * 1000).alias("cache_read"),
        F.when(i % 4 == 0, F.lit("fast")).alias("speed"),
        F.when(i % 8 == 0, F.round(F.col("value") / 50, 4)).alias("cost_usd"),
        F.when(i % 97 == 0, ts + clock.HOUR_MS).alias("limit_reset_ms"),
        i.alias("line_ord"),
    )
    return canonical(rows).withColumn("user_id", F.col("raw_session_id").cast("bigint"))


def devices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """120 devices of 60 users."""
    return spark.range(120).select(F.concat(F.lit("d"), F.col("id").cast("string")).alias("device_id"), (F.col("id") % 60).alias("user_id"))


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n = spark.read.parquet(f"{sf_dir}/customer.parquet"), spark.read.parquet(f"{sf_dir}/nation.parquet")
    return c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey).select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"), F.col("n_name").alias("city"))


def device_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries with the device they were reported from."""
    return usage_entries(spark, sf_dir).withColumn("device_id", F.concat(F.lit("d"), (F.col("user_id") % 120).cast("string")))
