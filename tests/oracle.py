"""Compare a query's rows with those of its SQL, as multisets over columns sorted by name."""

from __future__ import annotations

import datetime as dt
from collections import Counter
from decimal import Decimal
from pathlib import Path

import duckdb


def plain(value):
    if isinstance(value, Decimal):
        return float(value)
    if isinstance(value, float):
        return round(value, 6)
    if isinstance(value, bytes | bytearray):
        return bytes(value)
    return value.isoformat() if isinstance(value, dt.date | dt.datetime) else value


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for path in Path(sf_dir).glob("*.parquet"):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}{'/*.parquet' if path.is_dir() else ''}'")
    return con


def difference(df, con, sql: str) -> str:
    """What differs, or nothing."""
    found = con.sql(sql)
    names = sorted(df.columns)
    if names != sorted(found.columns):
        return f"columns {names} and {sorted(found.columns)}"
    at = [found.columns.index(c) for c in names]
    mine = Counter(tuple(plain(r[c]) for c in names) for r in df.collect())
    other = Counter(tuple(plain(r[i]) for i in at) for r in found.fetchall())
    if mine == other:
        return ""
    return f"{sum(mine.values())} and {sum(other.values())} rows; only here {list((mine - other).items())[:3]}; only there {list((other - mine).items())[:3]}"
