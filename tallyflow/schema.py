"""The canonical table of usage entries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: name, type, value where a source has none
FIELDS = (
    ("tool", "string", None),
    ("ts_ms", "bigint", None),
    ("usage_date", "string", None),
    ("project", "string", None),
    ("session_id", "string", None),
    ("raw_session_id", "string", None),
    ("project_path", "string", None),
    ("message_id", "string", None),
    ("request_id", "string", None),
    ("is_sidechain", "boolean", False),
    ("version", "string", None),
    ("model", "string", None),
    ("input", "bigint", 0),
    ("output", "bigint", 0),
    ("cache_flat", "bigint", 0),
    ("cache_split", "struct<c5m:bigint,c1h:bigint>", None),
    ("cache_read", "bigint", 0),
    ("extra", "bigint", 0),
    ("speed", "string", None),
    ("cost_usd", "double", None),
    ("credits", "double", None),
    ("message_count", "bigint", None),
    ("limit_reset_ms", "bigint", None),
    ("file_ord", "string", None),
    ("line_ord", "bigint", 0),
    ("sub_ord", "int", 0),
)

SCHEMA = ", ".join(f"{name} {kind}" for name, kind, _ in FIELDS)


def canonical(rows: DataFrame) -> DataFrame:
    """`rows` with all canonical columns, in order; missing ones take their default, counters are never null."""
    have = set(rows.columns)
    out = []
    for name, kind, default in FIELDS:
        column = F.col(name) if name in have else F.lit(default)
        if default is not None:
            column = F.coalesce(column.cast(kind), F.lit(default).cast(kind))
        out.append(column.cast(kind).alias(name))
    return rows.select(*out)
