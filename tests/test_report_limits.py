"""Reports beyond a limit fail as a batch and leave the table as it was."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallyflow.operators import cube
from tallyflow.streaming import hourly

KIND = "device_id string, date string, hour int, tool string, model string, generated_at long"


def report(spark, device, days, rows_a_day, at=1):
    first = dt.date(2025, 1, 1)
    rows = [(device, (first + dt.timedelta(days=d)).isoformat(), n % 24, "t", f"m{n // 24}", at) for d in range(days) for n in range(rows_a_day)]
    return spark.createDataFrame(rows, KIND).withColumns({c: F.lit(1).cast("long") for c in cube.COUNTERS})


def test_the_limits_are_those_of_the_rules(spark):
    at_most = spark.range(cube.MAX_DAYS).crossJoin(spark.range(363).withColumnRenamed("id", "n")).select(F.lit("d").alias("device_id"), F.date_format(F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int")), "yyyy-MM-dd").alias("date"), F.lit(1).alias("generated_at"))
    assert cube.over_limits(at_most, "device_id", "generated_at").collect() == []
    more = at_most.unionByName(at_most.limit(351))
    assert [(r["rows"], r["fault"]) for r in cube.over_limits(more, "device_id", "generated_at").collect()] == [(200_001, "more than 200000 rows")]
    day = spark.range(24 * 64).select(F.lit("d").alias("device_id"), F.lit("2020-01-01").alias("date"), F.lit(1).alias("generated_at"))
    assert cube.over_limits(day, "device_id", "generated_at").collect() == []
    assert cube.over_limits(day.unionByName(day.limit(1)), "device_id", "generated_at").first()["fault"] == "more than 1536 rows a day"
    long = spark.range(551).select(F.lit("d").alias("device_id"), F.date_format(F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int")), "yyyy-MM-dd").alias("date"), F.lit(1).alias("generated_at"))
    assert cube.over_limits(long, "device_id", "generated_at").first()["fault"] == "more than 550 days"


@pytest.mark.parametrize(("days", "rows", "said"), [(5, 2, "more than 4 days"), (2, 30, "more than 24 rows a day"), (4, 20, "more than 60 rows")])
def test_a_batch_beyond_a_limit_leaves_the_table(spark, tmp_path, days, rows, said):
    path = f"{tmp_path}/cube"
    sink = hourly.upsert_days(spark, path, {"days": 4, "rows_a_day": 24, "rows": 60})
    sink(report(spark, "a", 3, 20), 0)
    before = sorted(map(tuple, spark.read.parquet(path).collect()))
    with pytest.raises(hourly.ReportTooLarge, match=said):
        sink(report(spark, "a", 1, 1, at=2).unionByName(report(spark, "b", days, rows, at=2)), 1)
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == before and len(before) == 60
    # two reports of one device are judged one by one
    sink(report(spark, "c", 4, 15, at=3).unionByName(report(spark, "c", 4, 15, at=4)), 2)
    assert spark.read.parquet(path).where("device_id = 'c'").count() == 60
