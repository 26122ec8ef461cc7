"""URL filters: a sort-merge range join of page urls with host and path rules.

A host becomes its labels in reverse, each followed by a dot: `a.example.net` is `net.example.a.`. A rule's
key is then a prefix of the key of its host and of every subdomain, that is, an interval of keys, and
intervals nest or are disjoint. Pages are range-partitioned by (key, page id), so a hot host spreads over
tasks; each rule goes to the partitions its interval meets. One sweep over a sorted partition keeps the
rules whose intervals are open on a stack, and picks the longest whose path starts the page's path.

Defined results: a null url or one without `://` has empty host and path and fits no rule; of equally long
rules the one with the longer host wins, then block; repeated pages are judged row by row; an empty rule
table leaves every page to the default verdict; whole urls of any length are judged; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch, shuffle_partitions

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, _URL, 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


class _Stack:
    """Rules whose key is a prefix of the current key; by key, path length and path."""

    def __init__(self):
        self.open: list[tuple[str, dict[int, dict[str, tuple[str, str]]]]] = []

    def move(self, key: str) -> None:
        while self.open and not key.startswith(self.open[-1][0]):
            self.open.pop()

    def push(self, key: str, path: str, rule: str, verdict: str) -> None:
        self.move(key)
        if not self.open or self.open[-1][0] != key:
            self.open.append((key, {}))
        paths = self.open[-1][1].setdefault(len(path), {})
        if verdict == "block" or path not in paths:
            paths[path] = (rule, verdict)

    def longest(self, key: str, path: str) -> tuple[str | None, str | None]:
        self.move(key)
        best, size = (None, None), (-1, -1)
        for at, by_length in self.open:
            for n, paths in by_length.items():
                if (len(at) + n, len(at)) > size and (found := paths.get(path[:n])):
                    best, size = found, (len(at) + n, len(at))
        return best


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Per page: page_id, host, path, rule, verdict. `rules` has host, path and verdict (allow or block)."""
    spark = pages.sparkSession
    scratch = Scratch(spark, "url-filter")
    parts = shuffle_partitions(spark)
    url = F.col(url_col)
    keyed = pages.select(F.col(id_col).cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    keyed = keyed.withColumn("key", host_key(F.col("host"))).repartitionByRange(parts, "key", "page_id")
    keyed = scratch.keep(keyed.withColumn("pid", F.spark_partition_id()), "pages")
    # One row a partition: the bounds of its keys.
    bounds = sorted((r["low"], r["high"], r["pid"]) for r in keyed.groupBy("pid").agg(F.min("key").alias("low"), F.max("key").alias("high")).collect())
    lows, highs, pids = [b[0].encode() for b in bounds], [b[1].encode() for b in bounds], [b[2] for b in bounds]

    def spread(batches):
        for batch in batches:
            at, to = [], []
            for i, key in enumerate(batch["key"].to_pylist()):
                low = key.encode()
                for k in range(bisect_left(highs, low), bisect_right(lows, low[:-1] + b"/")):
                    if highs[k] >= low and lows[k] < low[:-1] + b"/":
                        at.append(i)
                        to.append(pids[k])
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(at, pa.int64())) for c in batch.columns), pa.array(to, pa.int32())], names=[*batch.schema.names, "pid"])

    rules = rules.select(F.coalesce("host", F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), F.coalesce("verdict", F.lit(default)).alias("verdict"))
    rules = rules.withColumn("key", host_key(F.col("host")))
    rules = rules.select("key", "host", "path", "verdict").mapInArrow(spread, "key string, host string, path string, verdict string, pid int")
    merged = keyed.select("pid", "key", F.lit(1).alias("kind"), "page_id", "host", "path", F.lit(None).cast("string").alias("verdict")).unionByName(
        rules.select("pid", "key", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("page_id"), "host", "path", "verdict")
    )

    def sweep(batches):
        stack, pid = _Stack(), None
        for batch in batches:
            out = []
            for p, key, kind, page, host, path, verdict in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if p != pid:
                    stack, pid = _Stack(), p
                if kind == 0:
                    stack.push(key, path, host + path, verdict)
                else:
                    rule, said = stack.longest(key, path)
                    out.append((page, host, path, rule, said or default))
            kinds = [pa.int64(), *[pa.string()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 5, kinds, strict=True)], names=["page_id", "host", "path", "rule", "verdict"])

    swept = merged.repartition(parts, "pid").sortWithinPartitions("pid", "key", "kind", "page_id")
    return swept.mapInArrow(sweep, "page_id long, host string, path string, rule string, verdict string")
