"""Entries as a stream: the hourly cube with whole-day replacement, windowed counts, and a request limiter."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import clock
from ..operators import cube


def read_events(spark: SparkSession, path: str, schema, files_a_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)


class ReportTooLarge(ValueError):
    """A report has more rows or days than is allowed."""


def upsert_days(spark: SparkSession, path: str, limits: dict[str, int] | None = None):
    """A sink for reports (device_id, date, generated_at, cells): of each device-day the last report stays.

    The table is partitioned by date, and only dates that a batch reports are rewritten. A day without rows
    clears nothing, and a batch that runs again writes what it wrote before. A batch with a report beyond the
    `limits` (those of `cube.over_limits`) fails before anything is written.
    """
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)

    def sink(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            if batch.isEmpty():
                return
            bad = cube.over_limits(batch, "device_id", "generated_at", **(limits or {})).orderBy("device_id", "generated_at").head(1)
            if bad:
                raise ReportTooLarge(f"the report of {bad[0]['device_id']!r} at {bad[0]['generated_at']} has {bad[0]['fault']}: {bad[0]['days']} days, {bad[0]['rows']} rows")
            both = batch
            if fs.exists(there):
                stored = spark.read.schema(batch.schema).parquet(path)
                both = batch.unionByName(stored.join(batch.select("date").distinct(), "date", "left_semi").select(batch.columns))
            latest = cube.latest_report(both).dropDuplicates()
            # what is rewritten is read from the same table, so it is written beside it first
            aside = f"{path}-batch-{uuid.uuid4().hex}"
            latest.write.parquet(aside)
            spark.read.schema(batch.schema).parquet(aside).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(path)
            fs.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(aside), True)
        finally:
            batch.unpersist()

    return sink


def run_upsert(reports: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Takes all reports that are there now, then stops; a scheduler may run it every hour."""
    return reports.writeStream.foreachBatch(upsert_days(reports.sparkSession, path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def hourly_totals(entries: DataFrame, late: str = "1 hour") -> DataFrame:
    """Tokens by hour and tool; an hour is final once the watermark has passed it."""
    timed = entries.withColumn("at", clock.at(F.col("ts_ms")))
    return timed.withWatermark("at", late).groupBy(F.window("at", "1 hour").alias("w"), "tool").agg(F.count("*").alias("entries"), F.sum("input").alias("input"), F.sum("output").alias("output")).select((F.unix_millis("w.start")).alias("hour_ms"), "tool", "entries", "input", "output")


def limiter(requests: DataFrame, most: int = 60, window_ms: int = clock.HOUR_MS) -> DataFrame:
    """token, ts_ms, allowed: a window opens with the first request after the last one closed; state is a token's open window.

    A token's requests of one micro-batch are judged in order of time together, however many Arrow batches bring them.
    """

    def judge(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        opened, used = state.get if state.exists else (None, 0)
        asked = pd.concat([b for b in batches if len(b)]).sort_values("ts_ms")
        allowed = []
        for ts in asked["ts_ms"]:
            if opened is None or ts - opened >= window_ms:
                opened, used = int(ts), 0
            used += 1
            allowed.append(used <= most)
        state.update((opened, used))
        yield pd.DataFrame({"token": asked["token"], "ts_ms": asked["ts_ms"], "allowed": allowed})

    return requests.groupBy("token").applyInPandasWithState(judge, "token string, ts_ms long, allowed boolean", "opened long, used long", "append", GroupStateTimeout.NoTimeout)
