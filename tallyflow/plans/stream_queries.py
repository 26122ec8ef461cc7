"""Streams that take all there is and stop: their results equal those of the batch queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cube
from ..session import work_folder
from ..sources.events import as_entries
from ..streaming import hourly
from ..streaming.blocks import stream_blocks as closed_blocks
from .cube_queries import HOURLY
from .registry import query
from .usage_queries import _block_sql


def _stream(spark, d):
    # a pattern, because a stream takes a plain path for a folder
    return hourly.read_events(spark, f"{d}/event[s].parquet", spark.read.parquet(f"{d}/events.parquet").schema)


def _finish(frame, folder: str, spark):
    frame.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out")


@query("SELECT device_id, date, hour, tool, model, CAST(sum(input) AS BIGINT) AS input, CAST(sum(output) AS BIGINT) AS output, CAST(sum(cache_read) AS BIGINT) AS cache_read, CAST(sum(cache_5m) AS BIGINT) AS cache_5m, CAST(sum(cache_1h) AS BIGINT) AS cache_1h FROM h GROUP BY ALL", HOURLY)
def stream_hourly(spark, d):
    folder = work_folder(spark, "stream-hourly")
    rows = as_entries(_stream(spark, d)).withColumn("device_id", F.concat(F.lit("d"), (F.col("user_id") % 120).cast("string")))

    def sink(batch, number):
        reports = cube.cells(batch, "device_id").withColumn("generated_at", F.lit(int(number)).cast("bigint"))
        hourly.upsert_days(spark, f"{folder}/cube")(reports, number)

    rows.writeStream.foreachBatch(sink).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    stored = spark.read.parquet(f"{folder}/cube")
    return stored.select("device_id", F.col("date").cast("string").alias("date"), "hour", "tool", "model", *cube.COUNTERS)


@query("SELECT ts_ms - ts_ms % 3600000 AS hour_ms, tool, count(*) AS entries, CAST(sum(input) AS BIGINT) AS input, CAST(sum(output) AS BIGINT) AS output FROM e GROUP BY 1, 2 HAVING ts_ms - ts_ms % 3600000 + 3600000 <= (SELECT max(ts_ms) - 3600000 FROM e)")
def stream_windowed(spark, d):
    return _finish(hourly.hourly_totals(as_entries(_stream(spark, d))), work_folder(spark, "stream-windowed"), spark)


@query(
    """RECURSIVE , s AS (SELECT tool AS token, ts_ms, row_number() OVER (PARTITION BY tool ORDER BY ts_ms, event_id) AS n FROM e),
    f(token, n, ts_ms, open, used) AS (SELECT token, n, ts_ms, ts_ms, CAST(1 AS BIGINT) FROM s WHERE n = 1
      UNION ALL SELECT s.token, s.n, s.ts_ms, CASE WHEN s.ts_ms - open >= 3600000 THEN s.ts_ms ELSE open END, CASE WHEN s.ts_ms - open >= 3600000 THEN 1 ELSE used + 1 END FROM f JOIN s ON s.token = f.token AND s.n = f.n + 1)
    SELECT token, ts_ms, used <= 2 AS allowed FROM f"""
)
def stream_limiter(spark, d):
    asked = as_entries(_stream(spark, d)).select(F.col("tool").alias("token"), "ts_ms")
    return _finish(hourly.limiter(asked, 2), work_folder(spark, "stream-limiter"), spark)


@query(_block_sql("0 AS z", "SELECT tool, block_start, block_end, first_ms, last_ms, entries, tokens FROM b WHERE block_end + 3600000 <= (SELECT max(ts_ms) FROM e) - 21600000"))
def stream_blocks(spark, d):
    return _finish(closed_blocks(as_entries(_stream(spark, d))), work_folder(spark, "stream-blocks"), spark).withColumnRenamed("by", "tool")
