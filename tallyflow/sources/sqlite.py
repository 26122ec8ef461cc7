"""SQLite databases through a Python data source: one partition a database file; and the tools that keep one."""

from __future__ import annotations

import contextlib
import glob
import os
import sqlite3
import urllib.parse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual

from ..functions import clock, text
from ..operators.dedup import fallback, first_wins, top_ancestor
from ..schema import canonical
from .documents import messages
from .documents import opencode as message_files
from .files import computed_once, counters, dated, filled, first


_HEADER = b"SQLite format 3\0"


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


def _databases(path: str) -> list[str]:
    """A file; of a folder all files that begin as databases do; else the files that match the pattern."""
    if os.path.isdir(path):
        return sorted(p for p in glob.glob(f"{glob.escape(path)}/**", recursive=True, include_hidden=True) if os.path.isfile(p) and _is_database(p))
    found = sorted(p for p in glob.glob(path, recursive=True) if os.path.isfile(p))
    if not found and not glob.has_magic(path):
        raise FileNotFoundError(path)
    return found


def _is_database(path: str) -> bool:
    with open(path, "rb") as f:
        return f.read(len(_HEADER)) == _HEADER


#: SQL of the filters that databases take over, by Spark's filter.
_OPERATORS = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
#: Times of at least so much are milliseconds, as any since 1973.
_MILLIS = 100_000_000_000


class _Reader(DataSourceReader):
    """Filters on the columns go into the databases; Spark is left those on file and line_ord, and of other forms."""

    def __init__(self, schema, options):
        self.query, self.of = options["query"], options["of"]
        self.key, self.clock, self.other = options.get("key"), options.get("clock"), options.get("other")
        self.columns = [f.name for f in schema.fields][2:]
        self.conditions: list[tuple[str, str, list]] = []
        self.paths = _databases(options["path"].removeprefix("file://"))

    def pushFilters(self, filters):
        for f in filters:
            name = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if name not in self.columns:
                yield f
            elif type(f) in _OPERATORS and isinstance(f.value, int | str):
                self.conditions.append((name, f"{_OPERATORS[type(f)]} ?", [f.value]))
            elif isinstance(f, In) and all(isinstance(v, int | str) for v in f.value):
                self.conditions.append((name, f"IN ({', '.join('?' * len(f.value))})", list(f.value)))
            elif isinstance(f, IsNull | IsNotNull):
                self.conditions.append((name, "IS NULL" if isinstance(f, IsNull) else "IS NOT NULL", []))
            else:
                yield f

    def partitions(self):
        return [_File(p) for p in self.paths]

    def statement(self, db: sqlite3.Connection) -> tuple[str, list]:
        """The query and its values for a database. Where its clock column is in milliseconds, times are compared there, by ids, so that an index answers without reading whole rows."""
        query, clocked = self.query, False
        if self.clock:
            if self.clock in {row[1] for row in db.execute(f"PRAGMA table_info({self.of})")}:
                clocked = (db.execute(f"SELECT max({self.clock}) FROM (SELECT {self.clock} FROM {self.of} WHERE typeof({self.clock}) = 'integer' LIMIT 8)").fetchone()[0] or 0) >= _MILLIS
            query = query.replace("{clock}", self.clock if clocked else self.other)
        timed = [c for c in self.conditions if clocked and c[0] == "created"]
        where = [f"{name} {test}" for name, test, _ in self.conditions if not (clocked and name == "created")]
        values = [v for name, _, vs in self.conditions if not (clocked and name == "created") for v in vs]
        if timed:
            where.append(f"{self.key[0]} IN (SELECT {self.key[1]} FROM {self.of} WHERE {' AND '.join(f'{self.clock} {test}' for _, test, _ in timed)})")
            values += [v for _, _, vs in timed for v in vs]
        return f"WITH entries({', '.join(self.columns)}) AS ({query}) SELECT * FROM entries" + (f" WHERE {' AND '.join(where)}" if where else ""), values

    def read(self, partition):
        if partition is None:
            return
        with contextlib.closing(sqlite3.connect(f"file:{urllib.parse.quote(partition.path)}?mode=ro", uri=True)) as db:
            # a database of another tool has no such table; any other failure is an error
            if db.execute("SELECT 1 FROM sqlite_master WHERE type IN ('table', 'view') AND name = ?", (self.of,)).fetchone():
                for n, row in enumerate(db.execute(*self.statement(db))):
                    yield (partition.path, n, *row)


class Sqlite(DataSource):
    """Options: path (a file, a folder or a glob), query, of (the table it reads); and for a query with {clock} in it: clock (the column it stands for), other (what does where the column is missing or not in milliseconds), key (the id in the result, and in the table).

    The schema begins with file string, line_ord bigint; line_ord is the order of the rows that are read.
    """

    @classmethod
    def name(cls):
        return "tallyflow_sqlite"

    def schema(self):
        raise ValueError("a schema is needed")

    def reader(self, schema):
        options = dict(self.options)
        if "key" in options:
            options["key"] = options["key"].split(",")
        return _Reader(schema, options)


def table(spark: SparkSession, path: str, query: str, schema: str, **options: str) -> DataFrame:
    """Rows of the query over each database that has the table the query reads from first. Filters on its columns are run by the databases, for which this switches on Spark's setting."""
    spark.dataSource.register(Sqlite)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    of = query.partition(" FROM ")[2].split()[0]
    return spark.read.format("tallyflow_sqlite").schema(f"file string, line_ord bigint, {schema}").options(path=path, query=query, of=of, **options).load()


def stored_messages(spark: SparkSession, path: str, since_ms: int | None = None, until_ms: int | None = None) -> DataFrame:
    """Messages of a tool's database, those created from since_ms on and before until_ms: file, line_ord, key, session, data, created."""
    said = "CAST(json_extract(CASE WHEN json_valid(data) THEN data END, '$.time.created') AS INTEGER)"
    rows = table(spark, path, "SELECT id, session_id, data, {clock} FROM message", "key string, session string, data string, created bigint", clock="time_created", other=said, key="key,id")
    if since_ms is not None:
        rows = rows.where(F.col("created") >= since_ms)
    if until_ms is not None:
        rows = rows.where(F.col("created") < until_ms)
    return rows


def _between(rows: DataFrame, since_ms: int | None, until_ms: int | None) -> DataFrame:
    rows = rows if since_ms is None else rows.where(F.col("ts_ms") >= since_ms)
    return rows if until_ms is None else rows.where(F.col("ts_ms") < until_ms)


def kilo(spark: SparkSession, path: str, tz: str = "UTC", since_ms: int | None = None, until_ms: int | None = None) -> DataFrame:
    return _between(messages(stored_messages(spark, path, since_ms, until_ms), "kilo", tz), since_ms, until_ms)


def opencode(spark: SparkSession, path: str, tz: str = "UTC", since_ms: int | None = None, until_ms: int | None = None) -> DataFrame:
    """Messages of the database in the folder, if there is one, and the message files that it does not have. A window narrows what is read of the database; its ids cover files whatever their time."""
    local = path.removeprefix("file://")
    databases = os.path.isdir(local) and bool(_databases(local))
    stored = stored_messages(spark, path, since_ms, until_ms) if databases else None
    covered = table(spark, path, "SELECT id FROM message", "key string") if databases else None
    return _between(message_files(spark, path, stored, tz, covered), since_ms, until_ms)


def goose(spark: SparkSession, path: str, tz: str = "UTC") -> DataFrame:
    """Session totals: accumulated counters, else plain ones; what only the total counts is reasoning."""
    columns = ("total", "input", "output", "accumulated_total", "accumulated_input", "accumulated_output")
    rows = table(spark, path, f"SELECT id, model_config_json, provider_name, CAST(created_at AS TEXT), {', '.join(c + '_tokens' for c in columns)} FROM sessions WHERE TRIM(model_config_json) != ''", "id string, config string, provider string, created string, " + ", ".join(f"{c} bigint" for c in columns))
    some = lambda c: F.coalesce(F.nullif(F.greatest(f"accumulated_{c}", F.lit(0)), F.lit(0)), F.nullif(F.greatest(c, F.lit(0)), F.lit(0)), F.lit(0))
    known = some("input") + some("output")
    rows = rows.withColumns({"model": filled(F.get_json_object("config", "$.model_name")), "known": known, "all": some("total")}).where("model is not null")
    rows = counters(rows, some("input"), some("output"), F.lit(0), F.lit(0), text.without_overlap(F.col("all"), F.col("known")))
    written = F.when(F.col("created").rlike(r"^\d+$"), clock.seconds_or_millis(F.col("created").cast("bigint"))).otherwise(F.unix_millis(F.try_to_timestamp("created")))
    rows = rows.withColumns({"tool": F.lit("goose"), "project": F.lit("goose"), "session_id": F.col("id"), "ts_ms": written}).where("ts_ms is not null")
    return canonical(dated(first_wins(rows, ["session_id"], ("file", "line_ord")), tz))


def hermes(spark: SparkSession, path: str, tz: str = "UTC") -> DataFrame:
    """Session totals with an actual or estimated cost; a cost of 0 counts as none."""
    columns = ("input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens", "reasoning_tokens")
    rows = table(spark, path, f"SELECT id, model, started_at, message_count, {', '.join(columns)}, actual_cost_usd, estimated_cost_usd FROM sessions", "id string, model_name string, started double, messages bigint, " + ", ".join(f"{c} bigint" for c in columns) + ", actual double, estimated double")
    rows = counters(rows, F.col("input_tokens"), F.col("output_tokens"), F.col("cache_write_tokens"), F.col("cache_read_tokens"), F.col("reasoning_tokens"))
    ms = F.when(F.col("started") <= 1e12, F.col("started") * 1000).otherwise(F.col("started")).cast("bigint")
    cost = first(F.when(F.col("actual") > 0, F.col("actual")), F.when(F.col("estimated") > 0, F.col("estimated")))
    rows = rows.withColumns({"tool": F.lit("hermes"), "project": F.lit("hermes"), "session_id": F.col("id"), "ts_ms": ms, "model": F.coalesce(filled(F.col("model_name")), F.lit("unknown")), "cost_usd": cost, "message_count": F.col("messages")})
    return canonical(dated(first_wins(rows, ["session_id"], ("file", "line_ord")), tz))


def zcode(spark: SparkSession, path: str, tz: str = "UTC") -> DataFrame:
    """Model calls, and the messages of sessions without any; both belong to the topmost parent session."""
    calls = table(spark, path, "SELECT id, session_id, model_id, started_at, input_tokens, output_tokens, reasoning_tokens, cache_creation_input_tokens, cache_read_input_tokens FROM model_usage", "id string, session string, model string, ts_ms bigint, i bigint, o bigint, reasoning bigint, c bigint, r bigint")
    said = table(spark, path, "SELECT id, session_id, time_created, data FROM message", "id string, session string, ts_ms bigint, data string").withColumn("d", computed_once(F.from_json("data", "modelID string, tokens struct<input:bigint,output:bigint,reasoning:bigint,cache:struct<read:bigint,write:bigint>>"))).where("d.tokens is not null")
    said = said.select("file", "line_ord", "id", "session", F.col("d.modelID").alias("model"), "ts_ms", F.col("d.tokens.input").alias("i"), F.col("d.tokens.output").alias("o"), F.col("d.tokens.reasoning").alias("reasoning"), F.col("d.tokens.cache.write").alias("c"), F.col("d.tokens.cache.read").alias("r"))
    rows = fallback(said, calls, "session")
    links = table(spark, path, "SELECT id, parent_id FROM session", "id string, parent string").select("id", "parent").distinct()
    rows = rows.join(top_ancestor(links).withColumnRenamed("id", "session"), "session", "left")
    cached = text.count(F.col("r")) + text.count(F.col("c"))
    rows = counters(rows, text.without_overlap(text.count(F.col("i")), cached), F.col("o"), F.col("c"), F.col("r"), F.col("reasoning"))
    rows = rows.withColumns({"tool": F.lit("zcode"), "project": F.lit("zcode"), "session_id": F.coalesce("root", "session"), "raw_session_id": F.col("session"), "message_id": F.col("id"), "ts_ms": clock.seconds_or_millis(F.col("ts_ms"))})
    return canonical(dated(first_wins(rows, ["message_id"], ("file", "line_ord")), tz))
