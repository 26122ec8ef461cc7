"""Session settings that all jobs of this package share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def session(name: str = "tallyflow", **settings: str) -> SparkSession:
    """A session in UTC with adaptive execution; further settings by keyword, dots written as two underscores."""
    builder = SparkSession.builder.appName(name)
    for key, value in ({"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true"} | {k.replace("__", "."): v for k, v in settings.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder that all executors share, in spark.checkpoint.dir; one of our own only where that is unset."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="spark-")
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"
