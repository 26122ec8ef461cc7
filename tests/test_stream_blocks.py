"""Blocks of a stream: equal to those of the batch operator, whatever order brings the entries."""

import random

from pyspark.sql import functions as F

from tallyflow.functions import clock
from tallyflow.operators import blocks as B
from tallyflow.schema import canonical
from tallyflow.streaming.blocks import stream_blocks

START = 1_772_359_200_000


def test_shuffled_micro_batches_give_the_blocks_of_the_table(spark, tmp_path):
    rng = random.Random(6)
    rows, at = [], START
    for k in range(600):
        at += rng.choice([1000, 60_000, 1_800_000, 3_600_000, 5 * 3_600_000, 9 * 3_600_000]) if k % 3 else 0
        rows.append((rng.choice(["a", "b", None]), at // clock.HOUR_MS * clock.HOUR_MS if rng.random() < 0.2 else at, rng.randrange(1, 50)))
    rows += [("a", START + 200 * clock.HOUR_MS, 1), ("a", START + 205 * clock.HOUR_MS, 2), ("a", START + 205 * clock.HOUR_MS + 1, 3)]
    rows.sort(key=lambda r: r[1])
    # every row comes at most 40 places from where its time would have it
    order = sorted(range(len(rows)), key=lambda i: i + rng.randrange(40))
    late = max(max((rows[a][1] - rows[b][1] for b in order[k + 1 :]), default=0) for k, a in enumerate(order))
    entries = canonical(spark.createDataFrame(rows, "tool string, ts_ms long, input long"))
    for n in range(0, len(order), 90):
        part = [rows[i] for i in order[n : n + 90]]
        canonical(spark.createDataFrame(part, "tool string, ts_ms long, input long")).coalesce(1).write.parquet(f"{tmp_path}/in/n{n:05}")
    canonical(spark.createDataFrame([("z", rows[-1][1] + late + 20 * clock.HOUR_MS, 1)], "tool string, ts_ms long, input long")).coalesce(1).write.parquet(f"{tmp_path}/in/n99999")
    stream = spark.readStream.schema(entries.schema).option("maxFilesPerTrigger", 2).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    found = stream_blocks(stream, late=f"{late // 1000 + 1} seconds")
    query = found.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    got = sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    batch = B.blocks(entries.withColumns({"cost": F.lit(0.0), "tool": F.coalesce("tool", F.lit(""))}), START)
    want = sorted(tuple(r) for r in batch.select("tool", "block_start", "block_end", "first_ms", "last_ms", "entries", "tokens").collect())
    assert got == want and len(got) > 30 and order != sorted(order)
    state = query.lastProgress["stateOperators"][0]
    assert state["numRowsTotal"] <= 4  # the last entry's point and its timer
