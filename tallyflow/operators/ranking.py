"""Row numbers over a whole table, without bringing it to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import Scratch


def row_numbers(rows: DataFrame, name: str, *order: Column) -> DataFrame:
    """`rows` with their place in the order, from 1: ranges of the order are numbered apart, and each starts after the rows of those before.

    The ranges are written once, so that counts and numbers see the same ones.
    """
    part = f"_{name}_part"
    placed = Scratch(rows.sparkSession, "row-numbers").keep(rows.repartitionByRange(*order).withColumn(part, F.spark_partition_id()), name)
    starts, before = [], 0
    for r in sorted(placed.groupBy(part).count().collect()):  # one row a partition
        starts.append((r[part], before))
        before += r["count"]
    starts = rows.sparkSession.createDataFrame(starts, f"{part} int, _before long")
    local = F.row_number().over(Window.partitionBy(part).orderBy(*order))
    return placed.join(F.broadcast(starts), part).withColumn(name, F.col("_before") + local).drop(part, "_before")
