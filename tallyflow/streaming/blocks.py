"""Billing blocks of a stream: a block's state is kept until no entry can belong to it any more.

Entries may come in any order within the watermark's delay. They are first added up to points, as in the batch
operator: those exactly on a multiple of the common part of an hour and the block length, and those between it
and the next. A point is folded into the open block once the watermark has passed it, so points are folded in
order of time whatever order brought them; the block is put out when the watermark passes its end. An entry
that comes more than a block's length after the one before also comes more than that after the block's start,
so the end alone closes a block. State is the open block and the points of the delay, then nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import clock
from ..functions.money import tokens

#: Where the state of such operators has to be kept.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
RESULT = "by string, block_start long, block_end long, first_ms long, last_ms long, entries long, tokens long"
_OPEN = ("start", "first", "last", "entries", "tokens")


class _Blocks(StatefulProcessor):
    def __init__(self, length: int):
        self.length, self.step = length, math.gcd(clock.HOUR_MS, length)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.points = handle.getMapState("points", "at long", "first long, last long, entries long, tokens long")
        self.open = handle.getValueState("open", ", ".join(f"{c} long" for c in _OPEN))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            slot = batch["ts_ms"] // self.step * self.step
            # a point's key: twice its slot, and one more for what lies between it and the next
            at = 2 * (slot // self.step) + (batch["ts_ms"] != slot)
            found = batch.groupby(at).agg(first=("ts_ms", "min"), last=("ts_ms", "max"), entries=("ts_ms", "size"), tokens=("tokens", "sum"))
            for at, *new in found.itertuples():
                old = self.points.getValue((at,)) if self.points.containsKey((at,)) else None
                if old is not None:
                    new = [min(old[0], new[0]), max(old[1], new[1]), old[2] + new[2], old[3] + new[3]]
                else:
                    self.handle.registerTimer(int((at // 2 + 1) * self.step))
                self.points.updateValue((int(at),), tuple(int(x) for x in new))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = timerValues.getCurrentWatermarkInMs()
        block, out = self.open.get() if self.open.exists() else None, []
        due = sorted((at[0], tuple(p)) for at, p in self.points.iterator() if (at[0] // 2 + 1) * self.step <= until)
        for at, (first, last, entries, total) in due:
            self.points.removeKey((at,))
            if block is None or first - block[0] > self.length:
                out += [] if block is None else [block]
                start = first // clock.HOUR_MS * clock.HOUR_MS
                block = (start, first, last, entries, total)
                self.handle.registerTimer(start + self.length + self.step)
            else:
                block = (block[0], block[1], last, block[3] + entries, block[4] + total)
        if block is not None and block[0] + self.length + self.step <= until:
            out, block = [*out, block], None
        if block is None:
            self.open.clear()
        else:
            self.open.update(tuple(int(x) for x in block))
        if out:
            rows = pd.DataFrame(out, columns=list(_OPEN))
            yield pd.DataFrame({"by": key[0], "block_start": rows["start"], "block_end": rows["start"] + self.length, "first_ms": rows["first"], "last_ms": rows["last"], "entries": rows["entries"], "tokens": rows["tokens"]})


def stream_blocks(entries: DataFrame, hours: float = 5, by: str = "tool", late: str = "6 hours") -> DataFrame:
    """Closed blocks of a stream of entries, as they close: by, block_start, block_end, first_ms, last_ms, entries, tokens.

    Entries later than the watermark's delay are dropped; those without `by` are a block line of their own. The
    session keeps state in the store that this operator needs from here on.
    """
    entries.sparkSession.conf.set(*STORE)
    timed = entries.select(F.coalesce(F.col(by).cast("string"), F.lit("")).alias("by"), clock.at(F.col("ts_ms")).alias("at"), "ts_ms", tokens().alias("tokens")).withWatermark("at", late)
    return timed.groupBy("by").transformWithStateInPandas(_Blocks(int(hours * clock.HOUR_MS)), RESULT, "append", "EventTime")
