"""Which folders and files there are to read, found without opening a file."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .files import lines


def _path(spark: SparkSession, path: str):
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return there, there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def is_folder(spark: SparkSession, path: str) -> bool:
    there, fs = _path(spark, path)
    return fs.exists(there) and fs.getFileStatus(there).isDirectory()


def folders(spark: SparkSession, said: str | None, defaults: list[str], within: str = "") -> list[str]:
    """The folders of a comma-separated list, of `defaults` where nothing is said: those that exist (and have the folder `within`, or are it), each once, in order.

    A list that is given but names no such folder is an error; without one, none is an empty result.
    """
    wished = [p.strip().rstrip("/") or p.strip() for p in said.split(",")] if said is not None else defaults
    wished = [p.removesuffix(f"/{within}") if within else p for p in wished if p]
    found = [p for p in dict.fromkeys(wished) if is_folder(spark, f"{p}/{within}" if within else p)]
    if said is not None and not found:
        raise ValueError(f"no folder with logs in {said!r}")
    return found


def _files(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """file, bytes, modified_ms. No column has the content, so no file is opened."""
    there, fs = _path(spark, path)
    whole = fs.makeQualified(there).toUri().getRawPath()
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).option("ignoreMissingFiles", "true").load(path)
    file = F.col("_metadata.file_path")
    relative = F.substring(file, F.locate(whole, file) + len(whole.rstrip("/")) + 1, F.length(file))
    return found.select(file.alias("file"), relative.alias("relative"), F.col("length").alias("bytes"), F.unix_millis("modificationTime").alias("modified_ms"))


def listing(spark: SparkSession, sources: list[tuple[str, str]], glob: str = "*.jsonl") -> DataFrame:
    """source, home, relative, file, bytes, modified_ms of the files under (home, folder) pairs; of files of one home with the same relative path only that of the first source."""
    each = [_files(spark, path, glob).withColumns({"source": F.lit(k), "home": F.lit(home)}) for k, (home, path) in enumerate(sources)]
    first = Window.partitionBy("home", "relative").orderBy("source", "file")
    kept = reduce(DataFrame.unionByName, each).withColumn("_n", F.row_number().over(first)).where("_n = 1")
    return kept.select("source", "home", "relative", "file", "bytes", "modified_ms")


def has_data(spark: SparkSession, path: str, glob: str = "*.jsonl") -> bool:
    """Whether there is any file to read, whatever is in it and whatever window is asked for."""
    return is_folder(spark, path) and bool(_files(spark, path, glob).select("file").head(1))


def source_lines(spark: SparkSession, sources: list[tuple[str, str]], glob: str = "*.jsonl", marker: str | None = None) -> DataFrame:
    """Lines of the listed files, with source and home: what an earlier source has of a home is not read again from a later one."""
    files = listing(spark, sources, glob).select("source", "home", "file")
    each = [lines(spark, path, glob, marker).withColumn("source", F.lit(k)) for k, (_, path) in enumerate(sources)]
    return reduce(DataFrame.unionByName, each).join(files, ["source", "file"])


def project_folder(spark: SparkSession, path: str, project: str) -> str | None:
    """The folder of a project below `path` or its `projects`; None where there is none."""
    tried = (f"{path.rstrip('/')}/projects/{project}", f"{path.rstrip('/')}/{project}" if path.rstrip("/").endswith("/projects") else None)
    return next((p for p in tried if p and is_folder(spark, p)), None)
