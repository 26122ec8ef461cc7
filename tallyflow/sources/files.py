"""Log files as rows: whole JSON documents, or lines with their place in the file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import clock, text


def documents(spark: SparkSession, path: str, glob: str = "*.json") -> DataFrame:
    """file, modified_ms, value: one row a file; missing files are no error."""
    read = spark.read.option("ignoreMissingFiles", "true").text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=glob)
    return read.select(F.col("_metadata.file_path").alias("file"), F.unix_millis(F.col("_metadata.file_modification_time")).alias("modified_ms"), "value")


#: A table of so many splits at most is sent to every task: some 200 bytes each, 10 MB in all.
SENT_SPLITS = 50_000


def lines(spark: SparkSession, path: str, glob: str = "*.jsonl", marker: str | None = None) -> DataFrame:
    """file, modified_ms, line_ord, line; with a marker, only lines that hold it, before anything is parsed. Empty lines go.

    Files are split like any text, so one huge log is many tasks. A line's number is its place in its split and
    the lines of the splits before it: a first pass counts the lines of each split and reads nothing else of
    them, the second numbers and filters. Row numbers and filters stand in one projection that is not
    deterministic, so that no filter reaches the scan, and both passes deal the files out alike.
    """
    read = spark.read.option("ignoreMissingFiles", "true").option("lineSep", "\n").text(path, recursiveFileLookup=True, pathGlobFilter=glob)
    meta = {name: F.col(f"_metadata.{name}") for name in ("file_path", "file_block_start", "file_modification_time")}
    rows = read.select(meta["file_path"].alias("file"), meta["file_block_start"].alias("_at"), F.unix_millis(meta["file_modification_time"]).alias("modified_ms"), F.monotonically_increasing_id().alias("_n"), "value")
    splits = rows.groupBy("file", "_at").agg(F.min("_n").alias("_first"), F.count("*").alias("_lines"))
    earlier = Window.partitionBy("file").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("file", "_at", (F.coalesce(F.sum("_lines").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"))
    wanted = rows.where(F.contains("value", F.lit(marker))) if marker else rows
    numbered = wanted.join(F.broadcast(splits) if _most_splits(read) <= SENT_SPLITS else splits, ["file", "_at"])
    return numbered.select("file", "modified_ms", (F.col("_n") + F.col("_shift")).alias("line_ord"), F.rtrim("value", F.lit("\r")).alias("line")).where("line <> ''")


def _most_splits(read: DataFrame) -> int:
    """A bound on the splits of the files, from their number and size alone."""
    conf = read.sparkSession.conf
    whole = int(str(read._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    most = int(read.sparkSession._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(conf.get("spark.sql.files.maxPartitionBytes").lower()))
    return len(read.inputFiles()) + whole // max(1, most) + 2 * read.sparkSession.sparkContext.defaultParallelism


def computed_once(value: Column) -> Column:
    """For a column of its own: computed once a row, while filters on a plain column would each compute it again below."""
    return F.explode(F.array(value))


def part(file: Column, back: int) -> Column:
    """A segment of a path, counted from its end, the name itself 1."""
    return F.element_at(F.split(file, "/"), -back)


def stem(file: Column) -> Column:
    return F.regexp_replace(part(file, 1), r"\.[^.]*$", "")


def after(file: Column, folder: str) -> Column:
    """The segment behind the first folder of that name."""
    return F.nullif(F.regexp_extract(file, f"/{folder}/([^/]+)/", 1), F.lit(""))


def filled(value: Column) -> Column:
    """Null for an empty text."""
    return F.when(F.trim(value) != "", value)


def first(*values: Column) -> Column:
    return F.coalesce(*values)


def counters(rows: DataFrame, input: Column, output: Column, create: Column, read: Column, extra: Column | None = None, total: Column | None = None) -> DataFrame:
    """`rows` with the counters; tokens that only a total counts go to output or extra; rows without any token go."""
    i, o, c, r, e = (text.count(x if x is not None else F.lit(0)) for x in (input, output, create, read, extra))
    o2, e2 = text.total_fallback(o, e, i + o + c + r + e, total if total is not None else F.lit(0))
    out = rows.withColumns({"input": i, "output": o2, "cache_flat": c, "cache_read": r, "extra": e2})
    return out.where(F.col("input") + F.col("output") + F.col("cache_flat") + F.col("cache_read") + F.col("extra") > 0)


def dated(rows: DataFrame, tz: str = "UTC") -> DataFrame:
    return rows.withColumn("usage_date", clock.local_date(F.col("ts_ms"), tz)).withColumn("file_ord", F.col("file"))
