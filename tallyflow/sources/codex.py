"""Codex logs: session events with running totals, and the entries of headless runs.

A line is classified by its text before it is parsed: session events name their type, headless entries hold
usage. Session events are read strictly, a field of a wrong type rejects the line; in headless entries such a
field counts as missing. Both are one table of events from there on, in the order of the lines.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import clock, text
from ..functions import variants as V
from ..operators.dedup import carry_forward
from ..operators.pricing import review_fallback
from ..schema import canonical
from ..scratch import Scratch
from .files import dated, filled, lines

PLACE = ("file", "line_ord")
COUNTS = ("input", "cached", "output", "reasoning", "total")
# The spellings of each counter, in the order in which they are looked for.
SPELLINGS = {
    "input": ("input_tokens", "prompt_tokens", "input"),
    "cached": ("cached_input_tokens", "cache_read_input_tokens", "cached_tokens"),
    "output": ("output_tokens", "completion_tokens", "output"),
    "reasoning": ("reasoning_output_tokens", "reasoning_tokens"),
    "total": ("total_tokens",),
}
# What a recorded service tier stands for.
TIERS = {"default": "standard", "standard": "standard", "fast": "fast", "priority": "fast"}
#: Milliseconds between usage entries of a burst that a fork wrote when it copied its parent's.
BURST_MS = 1000
_REPLAY_KEYS = tuple(f"_raw_{c}" for c in COUNTS)


def _named(line: Column, kind: str) -> Column:
    return line.rlike(rf'"type"\s*:\s*"{kind}"')


def _form(line: Column) -> Column:
    """session, headless or meta (the first line of a session's log); null for lines without usage."""
    session = _named(line, "turn_context") | (_named(line, "event_msg") & (_named(line, "token_count") | _named(line, "thread_settings_applied")))
    headless = line.contains('"usage":') | line.contains('"input_tokens":') | line.contains('"prompt_tokens":')
    return F.when(session, "session").when((F.col("line_ord") == 0) & _named(line, "session_meta"), "meta").when(headless, "headless")


def _struct(fields: dict[str, str]) -> str:
    return "struct<" + ",".join(f"{k}:{v}" for k, v in fields.items()) + ">"


_USAGE = _struct({name: "variant" for names in SPELLINGS.values() for name in names})
_MODEL = {"model": "variant", "model_name": "variant", "metadata": "struct<model:variant>"}
_TIMES = {"timestamp": "variant", "created_at": "variant", "createdAt": "variant"}
_INFO = _struct({"last_token_usage": _USAGE, "total_token_usage": _USAGE} | _MODEL)
_SOURCE = "struct<subagent:struct<thread_spawn:struct<parent_thread_id:variant>>>"
_PAYLOAD = _struct({"type": "variant", "id": "variant", "forked_from_id": "variant", "source": _SOURCE, "thread_settings": "struct<service_tier:variant>", "info": _INFO} | _MODEL)
_RESULT = _struct({"usage": _USAGE} | _TIMES | _MODEL)
#: Where a headless entry may hold its fields, besides in itself, and before the others.
HOLDERS = ("data", "result", "response")
_LINE = _struct({"type": "variant", "payload": _PAYLOAD, "usage": _USAGE} | _TIMES | _MODEL | dict.fromkeys(HOLDERS, _RESULT))


def _found(usage: Column) -> Column:
    """What is found of each counter in a usage object; null where there is none."""
    return F.when(usage.isNotNull(), F.struct(*(V.counter([usage[name] for name in names]).alias(c) for c, names in SPELLINGS.items())))


def _counts(found: Column) -> Column:
    """The counters; without a total it is input and output."""
    i, k, o, r, t = (F.coalesce(found[c]["n"], F.lit(0)) for c in COUNTS)
    return F.when(found.isNotNull(), F.struct(i.alias("input"), k.alias("cached"), o.alias("output"), r.alias("reasoning"), F.when(t > 0, t).otherwise(i + o).alias("total")))


def _bad(found: Column) -> Column:
    return F.coalesce(reduce(lambda a, b: a | b, (F.coalesce(found[c]["bad"], F.lit(False)) for c in COUNTS)), F.lit(False))


def _time(value: Column) -> Column:
    """Milliseconds of a timestamp text, or of a number of seconds up to 10^10, of milliseconds beyond."""
    number = V.whole(value)
    return F.coalesce(clock.parse_ms(F.trim(V.string(value))), F.when(number <= 10_000_000_000, number * 1000).otherwise(number))


def _models(holder: Column) -> list[Column]:
    return [holder["model"], holder["model_name"], holder["metadata"]["model"]]


def _model(fields: list[Column]) -> Column:
    return F.coalesce(*(filled(F.trim(V.string(f))) for f in fields))


def _wrong(fields: list[Column]) -> Column:
    return F.exists(F.array(*fields), V.no_string)


def _parsed(rows: DataFrame) -> DataFrame:
    """What the lines say, in small columns; `bad` where a field of a session event has a wrong type."""
    e, session = F.col("e"), F.col("form") == "session"
    p, info, tier = e["payload"], e["payload"]["info"], e["payload"]["thread_settings"]["service_tier"]
    holders = [e, *(e[h] for h in HOLDERS)]
    given = lambda field: F.nullif(V.string(field), F.lit(""))
    parent = F.coalesce(given(p["forked_from_id"]), given(p["source"]["subagent"]["thread_spawn"]["parent_thread_id"]))
    return rows.select(
        "file", "line_ord", "modified_ms", "form", V.string(e["type"]).alias("event"), V.string(p["type"]).alias("kind"), _time(e["timestamp"]).alias("ts_ms"),
        _model(_models(p)).alias("said"), _model(_models(info)).alias("info"), V.string(tier).alias("set"), V.string(p["id"]).alias("session"), parent.alias("parent"),
        F.when(session, _found(info["last_token_usage"])).alias("_last"), F.when(session, _found(info["total_token_usage"])).alias("_total"),
        (_wrong([e["type"], p["type"], tier, *_models(p), *_models(info)]) | (V.no_string(e["timestamp"]) & V.whole(e["timestamp"]).isNull())).alias("bad"),
        F.when(~session, F.array(*(_found(h["usage"]) for h in holders))).alias("_each"),
        F.when(~session, F.coalesce(*(_time(h[name]) for h in holders for name in _TIMES))).alias("any_ms"), F.when(~session, F.coalesce(*(_model(_models(h)) for h in holders))).alias("any_model"),
    )


def _session_events(parsed: DataFrame) -> DataFrame:
    rows = parsed.where((F.col("form") == "session") & ~F.col("bad") & ~_bad(F.col("_last")) & ~_bad(F.col("_total")))
    timed = F.coalesce((F.col("event") == "event_msg") & F.col("ts_ms").isNotNull(), F.lit(False))
    count = timed & F.coalesce(F.col("kind") == "token_count", F.lit(False))
    known = F.element_at(F.create_map(*(F.lit(x) for pair in TIERS.items() for x in pair)), F.col("set"))
    return rows.select(
        "file", "line_ord", F.lit(False).alias("headless"), count.alias("is_count"), "ts_ms", _counts(F.col("_last")).alias("last"), _counts(F.col("_total")).alias("total"),
        F.when(count | (F.col("event") == "turn_context"), F.coalesce("said", F.when(count, F.col("info")))).alias("model"),
        F.when(timed & (F.col("kind") == "thread_settings_applied") & F.col("set").isNotNull(), F.coalesce(known, F.lit("cleared"))).alias("tier"),
    )


def _headless_events(parsed: DataFrame) -> DataFrame:
    """Entries of headless runs with any usage; a field of a wrong type counts as missing."""
    rows = parsed.where("form = 'headless'").withColumn("last", _counts(F.get(F.filter("_each", lambda f: f.isNotNull() & ~_bad(f)), F.lit(0))))
    some = reduce(lambda a, b: a | b, (F.col(f"last.{c}") > 0 for c in COUNTS))
    return rows.where(some).select("file", "line_ord", F.lit(True).alias("headless"), F.lit(True).alias("is_count"), F.coalesce("any_ms", "modified_ms").alias("ts_ms"), "last", F.when(F.lit(False), F.col("last")).alias("total"), F.col("any_model").alias("model"), F.lit(None).cast("string").alias("tier"))


def codex(spark: SparkSession, path: str, tz: str = "UTC", glob: str = "*.jsonl") -> DataFrame:
    """Usage events: the last usage if the running total moved, else what the total gained; headless entries count whole.

    Model and tier are carried on within a file. Forked sessions lose the usage they replay from their parents,
    whatever timestamps it was given. Of equal events (time, model, five counters) the first stays, with the
    strongest tier that any of them has: standard, then fast.

    The logs are parsed once: this writes what lines with usage say, and the events before replays are dropped,
    to the shared folder, as several rules read them.
    """
    scratch = Scratch(spark, "codex")
    rows = lines(spark, path, glob).withColumn("form", _form(F.col("line"))).where("form is not null").withColumn("e", F.from_json("line", _LINE))
    parsed = scratch.keep(_parsed(rows), "lines")
    forks, heads = _forks(parsed), _heads(parsed)
    events = _session_events(parsed).unionByName(_headless_events(parsed))
    before = Window.partitionBy("file").orderBy("line_ord").rowsBetween(Window.unboundedPreceding, -1)
    events = events.withColumn("total", F.when(F.col("is_count"), F.col("total"))).withColumn("was", F.last("total", ignorenulls=True).over(before))
    moved = F.col("total").isNull() | F.col("was").isNull() | (F.col("total") != F.col("was"))
    gained = F.struct(*(F.greatest(F.col(f"total.{c}") - F.coalesce(F.col(f"was.{c}"), F.lit(0)), F.lit(0)).alias(c) for c in COUNTS))
    used = F.coalesce(F.when(moved, F.col("last")), F.when(F.col("total").isNotNull(), gained))
    events = events.withColumn("u", F.when(F.col("is_count"), used))
    counts = F.coalesce(F.col("is_count") & (F.col("headless") | (F.col("u.input") + F.col("u.cached") + F.col("u.output") + F.col("u.reasoning") > 0)), F.lit(False))
    events = events.withColumn("is_use", counts).withColumn("model", F.when(F.col("is_use") | ~F.col("is_count"), F.col("model")))
    events = carry_forward(carry_forward(events, "model", ["file"], PLACE), "tier", ["file"], PLACE).where("is_use")
    cached = F.least(F.col("u.cached"), F.col("u.input"))
    out = events.withColumns(
        {
            "tool": F.lit("codex"), "model": review_fallback(F.coalesce("model", F.lit("gpt-5")), clock.local_date(F.col("ts_ms"))), "session_id": F.regexp_replace(F.regexp_extract("file", r"/sessions/(.*)$", 1), r"\.[^./]*$", ""),
            "input": text.without_overlap(F.col("u.input"), cached), "output": F.col("u.output"), "cache_read": cached, "tier": F.when(~F.col("headless") & (F.col("tier") != "cleared"), F.col("tier")),
        }
    )
    out = scratch.keep(out.drop("last", "total", "was", "is_count", "is_use"), "events")
    return canonical(dated(_once(_without_replays(out, forks, heads)), tz).withColumn("project", F.lit("codex")))


def _once(events: DataFrame) -> DataFrame:
    """The first of equal events, with the strongest tier of all of them as its speed."""
    same = Window.partitionBy("ts_ms", "model", "input", "cache_read", "output", "u.reasoning", "u.total")
    rank = F.min(F.when(F.col("tier") == "standard", 1).when(F.col("tier") == "fast", 2)).over(same)
    kept = events.withColumns({"_rank": rank, "_n": F.row_number().over(same.orderBy(*PLACE))}).where("_n = 1")
    return kept.withColumn("speed", F.when(F.col("_rank") == 1, F.lit("standard")).when(F.col("_rank") == 2, F.lit("fast"))).drop("_rank", "_n")


def _forks(parsed: DataFrame) -> DataFrame:
    """file, forked_ms and parent_file of each forked session; no parent_file where the parent's log is not there. A session is named by the first line of its first file."""
    meta = parsed.where("form = 'meta'").select("file", "session", "parent", F.col("ts_ms").alias("forked_ms"))
    files = meta.where("session is not null").groupBy(F.col("session").alias("parent")).agg(F.min("file").alias("parent_file"))
    forks = meta.where("parent is not null").join(files, "parent", "left")
    return forks.select("file", "forked_ms", F.when(F.col("parent_file") != F.col("file"), F.col("parent_file")).alias("parent_file"))


def _heads(parsed: DataFrame) -> DataFrame:
    """file and burst_ms, the time of the first usage event, of files whose second one came within a second."""
    order = Window.partitionBy("file").orderBy("line_ord")
    used = parsed.where("form = 'session' and event = 'event_msg' and kind = 'token_count' and (_last is not null or _total is not null)")
    first = used.select("file", "line_ord", F.col("ts_ms").alias("burst_ms")).where("burst_ms is not null")
    first = first.withColumns({"_n": F.row_number().over(order), "_gap": F.lead("burst_ms").over(order) - F.col("burst_ms")})
    return first.where((F.col("_n") == 1) & F.col("_gap").between(0, BURST_MS)).select("file", "burst_ms")


def _without_replays(events: DataFrame, forks: DataFrame, heads: DataFrame) -> DataFrame:
    """Usage events without what forked sessions repeat: the leading events that equal the parent's before the fork; where not even the first does, the burst that the log begins with."""
    order = Window.partitionBy("file").orderBy("line_ord")
    events = events.withColumns({f"_raw_{c}": F.col(f"u.{c}") for c in COUNTS} | {"pos": F.row_number().over(order), "_until": F.max("ts_ms").over(order)})
    prefix = forks.select(F.col("file").alias("session"), "forked_ms", F.col("parent_file").alias("file")).join(events.select("file", "pos", "_until", *_REPLAY_KEYS), "file")
    prefix = prefix.where("forked_ms is null or _until <= forked_ms").select("session", "pos", *_REPLAY_KEYS)
    forked = events.join(forks.select("file", F.lit(True).alias("_fork")), "file", "left")
    left = without_replay(forked.withColumns({"session": F.col("file"), "parent": F.when(F.col("_fork"), F.col("file"))}), prefix, _REPLAY_KEYS)
    left = left.join(heads, "file", "left").withColumn("_whole", F.min("pos").over(Window.partitionBy("file")) == 1)
    gap = F.col("ts_ms") - F.coalesce(F.lag("ts_ms").over(order), F.col("burst_ms"))
    burst = F.coalesce(F.col("_fork") & F.col("_whole") & gap.between(0, BURST_MS), F.lit(False))
    left = left.withColumn("_burst", burst.cast("int")).withColumn("_burst", F.min("_burst").over(order))
    return left.where("_burst = 0").select(*(c for c in events.columns if c not in ("pos", "_until", *_REPLAY_KEYS)))


def without_replay(child: DataFrame, parent: DataFrame, keys: tuple[str, ...] = ("input", "output", "cache_read")) -> DataFrame:
    """A forked session's events (pos, keys, ...) without the leading ones that equal its parent's at the same place."""
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    both = child.join(parent.select(F.col("session").alias("parent"), "pos", *(F.col(k).alias(f"_{k}") for k in keys), F.lit(True).alias("_there")), ["parent", "pos"], "left")
    run = F.min(F.coalesce(same & F.col("_there"), F.lit(False)).cast("int")).over(Window.partitionBy("session").orderBy("pos"))
    return both.withColumn("_run", run).where("_run = 0").drop("_run", "_there", *(f"_{k}" for k in keys))
