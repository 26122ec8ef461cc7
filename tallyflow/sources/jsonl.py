"""Sources that write JSON lines: claude, codex (in its own module), pi, omp, openclaw, copilot, gemini, kimi, qwen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import clock, text, variants
from ..operators.dedup import best_source, carry_forward, first_wins
from ..schema import canonical
from .codex import codex, without_replay
from .discover import project_folder
from .files import after, computed_once, counters, dated, documents, filled, first, lines, part, stem

__all__ = ["claude", "codex", "copilot", "gemini", "kimi", "omp", "openclaw", "pi", "qwen", "without_replay"]

PLACE = ("file", "line_ord")

_CLAUDE_USAGE = "struct<input_tokens:bigint,output_tokens:bigint,cache_creation_input_tokens:bigint,cache_read_input_tokens:bigint,speed:string,cache_creation:struct<ephemeral_5m_input_tokens:bigint,ephemeral_1h_input_tokens:bigint>,iterations:array<struct<type:string,model:string,input_tokens:bigint,output_tokens:bigint,cache_creation_input_tokens:bigint,cache_read_input_tokens:bigint>>>"
_CLAUDE_MESSAGE = f"struct<id:string,model:string,usage:{_CLAUDE_USAGE}>"
_CLAUDE = f"timestamp string, sessionId string, version string, requestId string, costUSD double, isSidechain boolean, isApiErrorMessage boolean, message {_CLAUDE_MESSAGE}"
_CLAUDE_PROGRESS = f"data struct<message:struct<timestamp:string,sessionId:string,version:string,requestId:string,costUSD:double,isSidechain:boolean,isApiErrorMessage:boolean,message:{_CLAUDE_MESSAGE}>>"
# The same fields by their own JSON types, without the iterations, which are judged one by one.
_CLAUDE_TYPES = "timestamp:variant,sessionId:variant,version:variant,requestId:variant,costUSD:variant,isSidechain:variant,isApiErrorMessage:variant,message:struct<id:variant,model:variant,usage:struct<input_tokens:variant,output_tokens:variant,cache_creation_input_tokens:variant,cache_read_input_tokens:variant,speed:variant,cache_creation:struct<ephemeral_5m_input_tokens:variant,ephemeral_1h_input_tokens:variant>>>"
# Fields whose `null` makes a line invalid, wherever it stands in the text.
_NO_NULL = "id|cwd|model|speed|costUSD|version|sessionId|requestId|isApiErrorMessage|cache_read_input_tokens|cache_creation_input_tokens"


def _claude_session(file: Column) -> Column:
    """The file's stem right below a project, the folder above `subagents`, else the folder."""
    below = F.size(F.split(F.regexp_extract(file, r"/projects/(.*)$", 1), "/"))
    return F.when(part(file, 2) == "subagents", part(file, 3)).when(below == 2, stem(file)).otherwise(part(file, 2))


def _claude_wrong_types(t: Column) -> Column:
    """Whether a field has another type than it should: text, count, number or flag."""
    m, u, split = t["message"], t["message"]["usage"], t["message"]["usage"]["cache_creation"]
    texts = [t["timestamp"], t["sessionId"], t["version"], t["requestId"], m["id"], m["model"], u["speed"]]
    counts = [*(u[f"{c}_tokens"] for c in ("input", "output", "cache_creation_input", "cache_read_input")), *(split[f"ephemeral_{c}_input_tokens"] for c in ("5m", "1h"))]
    return F.exists(F.array(*texts), variants.no_string) | F.exists(F.array(*counts), variants.no_count) | variants.no_number(t["costUSD"]) | F.exists(F.array(t["isSidechain"], t["isApiErrorMessage"]), variants.no_flag)


def claude(spark: SparkSession, path: str, daily: bool = False, tz: str = "UTC", glob: str = "*.jsonl", project: str | None = None) -> DataFrame:
    """Lines with usage; `daily` also reads agent-progress lines. Advisor iterations become rows of their own. A field of a wrong type rejects its line. Of a `project` only its own folder is listed and read."""
    if project is not None:
        folder = project_folder(spark, path, project)
        return claude(spark, folder or path, daily, tz, glob).where(F.col("project") == project)
    rows = lines(spark, path, glob, '"usage":{').where(~F.col("line").rlike(f'"({_NO_NULL})":null'))
    rows = rows.withColumn("e", computed_once(F.from_json("line", _CLAUDE))).withColumn("t", computed_once(F.from_json("line", f"struct<{_CLAUDE_TYPES}>")))
    if daily:
        direct = F.col("e.message.usage").isNotNull()
        rows = rows.withColumn("_e", computed_once(F.when(~direct, F.from_json("line", _CLAUDE_PROGRESS)))).withColumn("_t", computed_once(F.when(~direct, F.from_json("line", f"struct<data:struct<message:struct<{_CLAUDE_TYPES}>>>"))))
        rows = rows.withColumn("e", computed_once(F.when(direct, F.col("e")).otherwise(F.col("_e.data.message")))).withColumn("t", computed_once(F.when(direct, F.col("t")).otherwise(F.col("_t.data.message")))).drop("_e", "_t")
    rows = rows.where(~_claude_wrong_types(F.col("t")))
    m, u = F.col("e.message"), F.col("e.message.usage")
    fine = clock.parse_ms(F.col("e.timestamp")).isNotNull() & u["input_tokens"].isNotNull() & u["output_tokens"].isNotNull()
    for c in ("input_tokens", "output_tokens", "cache_creation_input_tokens", "cache_read_input_tokens"):
        fine = fine & (F.coalesce(u[c], F.lit(0)) >= 0)
    for c in (F.col("e.sessionId"), F.col("e.requestId"), m["id"], m["model"]):
        fine = fine & (F.coalesce(c, F.lit("-")) != "")
    fine = fine & (F.coalesce(F.col("e.version"), F.lit("0.0.0")).rlike(r"^[0-9]+\.[0-9]+\.[0-9]")) & (F.coalesce(u["speed"], F.lit("fast")).isin("fast", "standard"))
    rows = rows.where(F.coalesce(fine, F.lit(False)))
    split = F.when(u["cache_creation"].isNotNull(), F.struct(F.coalesce(u["cache_creation"]["ephemeral_5m_input_tokens"], F.lit(0)).alias("c5m"), F.coalesce(u["cache_creation"]["ephemeral_1h_input_tokens"], F.lit(0)).alias("c1h")))
    own = F.struct(
        F.lit(0).alias("n"), m["id"].alias("id"), text.display_model(m["model"], u["speed"]).alias("model"), u["input_tokens"].alias("i"), u["output_tokens"].alias("o"),
        F.coalesce(u["cache_creation_input_tokens"], F.lit(0)).alias("c"), split.alias("split"), F.coalesce(u["cache_read_input_tokens"], F.lit(0)).alias("r"), u["speed"].alias("speed"), F.col("e.costUSD").alias("cost"),
    )
    advisors = F.filter(F.coalesce(u["iterations"], F.array()), lambda x: x["type"] == "advisor_message")
    whole = F.forall(advisors, lambda x: x["model"].isNotNull() & x["input_tokens"].isNotNull() & x["output_tokens"].isNotNull())
    none = F.lit(None)
    advice = F.transform(
        advisors,
        lambda x, n: F.struct(
            (n + 1).alias("n"), F.concat(m["id"], F.lit(":advisor:"), n.cast("string")).alias("id"), x["model"].alias("model"), x["input_tokens"].alias("i"), x["output_tokens"].alias("o"),
            F.coalesce(x["cache_creation_input_tokens"], F.lit(0)).alias("c"), none.cast("struct<c5m:bigint,c1h:bigint>").alias("split"), F.coalesce(x["cache_read_input_tokens"], F.lit(0)).alias("r"), none.cast("string").alias("speed"), none.cast("double").alias("cost"),
        ),
    )
    out = rows.withColumn("x", F.explode(F.concat(F.array(own), F.when(whole, advice).otherwise(F.array().cast(f"array<{_struct_of()}>")))))
    reset = F.lit(None).cast("bigint") if daily else F.when(F.col("e.isApiErrorMessage"), text.reset_ms(F.col("line")))
    return canonical(
        dated(
            out.withColumns(
                {
                    "tool": F.lit("claude"), "ts_ms": clock.parse_ms(F.col("e.timestamp")), "project": after(F.col("file"), "projects"), "session_id": _claude_session(F.col("file")), "raw_session_id": F.col("e.sessionId"),
                    "project_path": after(F.col("file"), "projects"), "message_id": F.col("x.id"), "request_id": F.col("e.requestId"), "is_sidechain": F.col("e.isSidechain"), "version": F.col("e.version"), "model": F.col("x.model"),
                    "input": F.col("x.i"), "output": F.col("x.o"), "cache_flat": F.col("x.c"), "cache_split": F.col("x.split"), "cache_read": F.col("x.r"), "speed": F.col("x.speed"), "cost_usd": F.col("x.cost"),
                    "limit_reset_ms": reset, "sub_ord": F.col("x.n"),
                }
            ),
            tz,
        )
    )


def _struct_of() -> str:
    return "struct<n:int,id:string,model:string,i:bigint,o:bigint,c:bigint,split:struct<c5m:bigint,c1h:bigint>,r:bigint,speed:string,cost:double>"


_PI = "type string, id string, timestamp string, message struct<role:string,model:string,usage:struct<input:bigint,output:bigint,cacheRead:bigint,cacheWrite:bigint,totalTokens:bigint,cost:struct<total:double>>>"


def pi(spark: SparkSession, path: str, tool: str = "pi", tz: str = "UTC") -> DataFrame:
    """Assistant messages with usage; the same dialect is written by omp, whose side files belong to the folder's session."""
    rows = lines(spark, path, marker='"usage"').withColumn("e", computed_once(F.from_json("line", _PI)))
    rows = rows.where((F.coalesce("e.type", F.lit("message")) == "message") & (F.col("e.message.role") == "assistant") & F.col("e.message.usage").isNotNull())
    rows = rows.withColumn("ts_ms", clock.parse_ms(F.col("e.timestamp"))).where("ts_ms is not null")
    u = F.col("e.message.usage")
    rows = counters(rows, u["input"], u["output"], u["cacheWrite"], u["cacheRead"], None, u["totalTokens"])
    own = F.regexp_replace(stem(F.col("file")), r"^[^_]*_", "")
    folder = F.regexp_extract(part(F.col("file"), 2), r"^\d{4}-\d\d-\d\dT[^_]*_(.+)$", 1)
    out = rows.withColumns(
        {
            "tool": F.lit(tool), "model": F.concat(F.lit(f"[{tool}] "), F.coalesce(filled(F.col("e.message.model")), F.lit("unknown"))), "cost_usd": u["cost"]["total"],
            "project": after(F.col("file"), "sessions"), "session_id": F.when(folder != "", folder).otherwise(own) if tool == "omp" else own, "message_id": F.col("e.id"),
        }
    )
    identity = ["session_id", "ts_ms", "model", "input", "output", "cache_flat", "cache_read", "_cost"]
    once = first_wins(out.withColumn("_cost", F.coalesce(F.col("cost_usd").cast("string"), F.lit("-"))), identity, PLACE)
    return canonical(dated(once, tz))


def omp(spark: SparkSession, path: str, tz: str = "UTC") -> DataFrame:
    return pi(spark, path, "omp", tz)


_CLAW = "type string, customType string, modelId string, model string, provider string, timestamp string, data struct<modelId:string,model:string,provider:string>, message struct<role:string,modelId:string,model:string,provider:string,timestamp:string,usage:struct<input:bigint,output:bigint,cacheRead:bigint,cacheWrite:bigint,totalTokens:bigint,cost:struct<total:double>>>"


def _time(value: Column) -> Column:
    """A timestamp text, or a number of milliseconds or seconds as text."""
    return F.coalesce(clock.parse_ms(value), clock.seconds_or_millis(text.any_count(value)))


def openclaw(spark: SparkSession, path: str, tz: str = "UTC") -> DataFrame:
    """Assistant messages; the model is the message's, else the last that a change or snapshot named."""
    rows = lines(spark, path).withColumn("e", computed_once(F.from_json("line", _CLAW)))
    change = F.coalesce((F.col("e.type") == "model_change") | ((F.col("e.type") == "custom") & (F.col("e.customType") == "model-snapshot")), F.lit(False))
    source = F.when(F.col("e.data").isNotNull(), F.col("e.data")).otherwise(F.struct("e.modelId", "e.model", "e.provider"))
    rows = carry_forward(rows.withColumn("current", F.when(change, first(source["modelId"], source["model"]))), "current", ["file"], PLACE)
    rows = rows.where((F.col("e.type") == "message") & (F.col("e.message.role") == "assistant") & F.col("e.message.usage").isNotNull())
    m, u = F.col("e.message"), F.col("e.message.usage")
    rows = counters(rows, u["input"], u["output"], u["cacheWrite"], u["cacheRead"], None, u["totalTokens"])
    out = rows.withColumns(
        {
            "tool": F.lit("openclaw"), "ts_ms": first(_time(m["timestamp"]), _time(F.col("e.timestamp")), F.col("modified_ms")), "project": F.lit("openclaw"), "session_id": F.regexp_replace(stem(F.col("file")), r"\.jsonl.*$", ""),
            "model": F.concat(F.lit("[openclaw] "), first(m["modelId"], m["model"], F.col("current"), F.lit("unknown"))), "cost_usd": u["cost"]["total"],
        }
    )
    identity = ["session_id", "ts_ms", "model", "input", "output", "cache_flat", "cache_read", "_cost"]
    return canonical(dated(first_wins(out.withColumn("_cost", F.coalesce(F.col("cost_usd").cast("string"), F.lit("-"))), identity, PLACE), tz))


def copilot(spark: SparkSession, path: str, tz: str = "UTC") -> DataFrame:
    """Telemetry of four kinds; a usage that a better kind reports for the same trace or response is dropped."""
    rows = lines(spark, path, marker='"attributes"').withColumn("e", computed_once(F.from_json("line", "type string, traceId string, spanId string, name string, timestamp string, endTime array<bigint>, hrTime array<bigint>, startTime array<bigint>, body string, _body string, attributes map<string,string>")))
    a = lambda *names: first(*(filled(F.element_at("e.attributes", n)) for n in names)) if len(names) > 1 else filled(F.element_at("e.attributes", names[0]))
    n = lambda *names: F.coalesce(text.any_count(a(*names)), F.lit(0))
    chat = (F.col("e.type") == "span") & ((a("gen_ai.operation.name") == "chat") | F.startswith("e.name", F.lit("chat ")))
    inference = a("event.name") == "gen_ai.client.inference.operation.details"
    turn = a("event.name") == "copilot_chat.agent.turn"
    summary = (F.col("e.type") == "span") & ((a("gen_ai.operation.name") == "invoke_agent") | F.startswith("e.name", F.lit("invoke_agent")))
    rows = rows.withColumn("rank", F.when(chat, 0).when(inference, 1).when(turn, 2).when(summary, 3)).where("rank is not null")
    instant = lambda x: F.when(F.size(x) == 2, F.element_at(x, 1) * 1000 + F.floor(F.element_at(x, 2) / 1_000_000))
    read, given = n("gen_ai.usage.cache_read.input_tokens"), n("gen_ai.usage.input_tokens")
    rows = counters(
        rows, text.without_overlap(given, read), n("gen_ai.usage.output_tokens"), n("gen_ai.usage.cache_write.input_tokens", "gen_ai.usage.cache_creation.input_tokens"), read,
        n("gen_ai.usage.reasoning.output_tokens", "gen_ai.usage.reasoning_tokens"), n("gen_ai.usage.total_tokens", "gen_ai.usage.total.token_count"),
    )
    trace = Window.partitionBy(F.coalesce("e.traceId", F.concat("file", F.lit("#"), "line_ord")))
    model, session = a("gen_ai.response.model", "gen_ai.request.model"), a("gen_ai.conversation.id", "copilot_chat.session_id", "session.id")
    out = rows.withColumns(
        {
            "tool": F.lit("copilot"), "project": F.lit("copilot"), "trace": F.col("e.traceId"), "response": a("gen_ai.response.id"),
            "ts_ms": first(instant(F.col("e.endTime")), instant(F.col("e.hrTime")), instant(F.col("e.startTime")), _time(F.col("e.timestamp")), F.col("modified_ms")).cast("bigint"),
            "model": first(model, F.first(model, ignorenulls=True).over(trace), F.lit("unknown")), "session_id": first(session, F.first(session, ignorenulls=True).over(trace), F.col("e.traceId"), F.lit("unknown-session")),
        }
    )
    return canonical(dated(best_source(out, ["trace", "response"]), tz))


_GEMINI_TOKENS = "input double, prompt double, input_tokens double, prompt_tokens double, output double, candidates double, output_tokens double, candidates_tokens double, cached double, cached_tokens double, thoughts double, reasoning double, thoughts_tokens double, reasoning_tokens double, tool double, tool_tokens double, total double, total_tokens double"
_GT = f"struct<{_GEMINI_TOKENS.replace(' double', ':double').replace(', ', ',')}>"


_GEMINI_NAMES = [x.split()[0] for x in _GEMINI_TOKENS.split(", ")]


def _gemini_counts(t: Column) -> dict[str, Column]:
    pick = lambda *names: F.coalesce(*(t[n] for n in names))
    whole = lambda c: F.greatest(F.floor(F.coalesce(c, F.lit(0.0))), F.lit(0)).cast("bigint")
    return {
        "i": whole(pick("input", "prompt", "input_tokens", "prompt_tokens")), "o": whole(pick("output", "candidates", "output_tokens", "candidates_tokens")), "c": whole(pick("cached", "cached_tokens")),
        "th": whole(pick("thoughts", "reasoning", "thoughts_tokens", "reasoning_tokens")), "tl": whole(pick("tool", "tool_tokens")), "tt": pick("total", "total_tokens").cast("bigint"),
    }


def gemini(spark: SparkSession, path: str, tz: str = "UTC") -> DataFrame:
    """Session documents and lines: messages of type gemini, replaced by id, and statistics by model."""
    message = f"type:string,id:string,model:string,timestamp:string,created_at:string,tokens:{_GT}"
    stats = f"struct<models:map<string,struct<tokens:{_GT}>>,{_GT[7:-1]}>"
    log = lines(spark, path, "*.jsonl").withColumn("e", computed_once(F.from_json("line", f"{message.replace(':', ' ', 6).replace(',', ', ', 5)}, sessionId string, session_id string, stats {stats}")))
    log = log.withColumns({"session": first(filled(F.col("e.sessionId")), filled(F.col("e.session_id"))), "hint": filled(F.col("e.model"))})
    log = carry_forward(carry_forward(log, "session", ["file"], PLACE), "hint", ["file"], PLACE)
    log = log.select("file", "modified_ms", "line_ord", F.lit(0).alias("sub_ord"), "session", "hint", F.struct("e.type", "e.id", "e.model", "e.timestamp", "e.created_at", "e.tokens").alias("m"), F.col("e.stats").alias("stats"), F.col("e.timestamp").alias("at"))
    doc = documents(spark, path, "*.json").withColumn("e", computed_once(F.from_json("value", f"sessionId string, session_id string, model string, timestamp string, messages array<struct<{message}>>, stats {stats}")))
    doc = doc.select("file", "modified_ms", first(filled(F.col("e.sessionId")), filled(F.col("e.session_id"))).alias("session"), filled(F.col("e.model")).alias("hint"), F.col("e.stats").alias("stats"), F.col("e.timestamp").alias("at"), F.posexplode_outer("e.messages").alias("p", "m"))
    doc = doc.select("file", "modified_ms", F.coalesce("p", F.lit(0)).cast("bigint").alias("line_ord"), F.lit(0).alias("sub_ord"), "session", "hint", "m", F.when(F.coalesce("p", F.lit(0)) == 0, F.col("stats")).alias("stats"), "at")
    both = log.unionByName(doc).withColumn("session", F.coalesce("session", stem(F.col("file"))))
    direct = both.where("m.type = 'gemini' and m.tokens is not null").withColumn("model", first(filled(F.col("m.model")), F.col("hint")))
    direct = direct.select("file", "line_ord", "sub_ord", "session", "model", F.col("m.id").alias("message_id"), first(clock.parse_ms(F.col("m.timestamp")), clock.parse_ms(F.col("m.created_at")), F.col("modified_ms")).alias("ts_ms"), F.col("m.tokens").alias("t"), F.lit(True).alias("by_total"))
    direct = first_wins(direct, ["file", "message_id"], PLACE, last=True)
    totals = both.where("stats.models is not null and coalesce(m.type, '') <> 'gemini'").select("file", "line_ord", "session", F.coalesce(clock.parse_ms(F.col("at")), F.col("modified_ms")).alias("ts_ms"), F.posexplode(F.array_sort(F.map_entries("stats.models"))).alias("sub_ord", "x"))
    totals = totals.select("file", "line_ord", "sub_ord", "session", F.col("x.key").alias("model"), F.lit(None).cast("string").alias("message_id"), "ts_ms", F.col("x.value.tokens").alias("t"), F.lit(False).alias("by_total")).where("t is not null")
    plain = both.where("stats is not null and stats.models is null and coalesce(m.type, '') <> 'gemini'").select("file", "line_ord", F.lit(0).alias("sub_ord"), "session", F.coalesce("hint", F.lit("unknown")).alias("model"), F.lit(None).cast("string").alias("message_id"), F.coalesce(clock.parse_ms(F.col("at")), F.col("modified_ms")).alias("ts_ms"), F.struct(*(F.col(f"stats.{n}") for n in _GEMINI_NAMES)).alias("t"), F.lit(False).alias("by_total"))
    rows = direct.unionByName(totals).unionByName(plain).where("trim(model) <> ''").withColumns(_gemini_counts(F.col("t")))
    sums = F.col("i") + F.col("o") + F.col("th") + F.col("tl")
    inclusive = ~F.col("by_total") | ((F.col("c") > 0) & F.coalesce((F.col("tt") == sums) & (F.col("tt") != sums + F.col("c")), F.lit(False)))
    fresh = F.when(inclusive, text.without_overlap(F.col("i"), F.col("c"))).otherwise(F.col("i")) + F.col("tl")
    rows = counters(rows, fresh, F.col("o"), F.lit(0), F.col("c"), F.col("th"), F.coalesce("tt", F.lit(0)))
    return canonical(dated(rows.withColumns({"tool": F.lit("gemini"), "project": F.lit("gemini"), "session_id": F.col("session")}), tz))


_KIMI_COUNTS = "struct<inputOther:bigint,output:bigint,inputCacheCreation:bigint,inputCacheRead:bigint>"
_KIMI_OLD = "struct<input_other:bigint,output:bigint,input_cache_creation:bigint,input_cache_read:bigint,total:bigint>"


def kimi(spark: SparkSession, path: str, default: str = "kimi-for-coding", tz: str = "UTC") -> DataFrame:
    """Usage records of a turn, and the older status updates."""
    rows = lines(spark, path, "wire.jsonl").withColumn("e", computed_once(F.from_json("line", f"type string, usageScope string, model string, time bigint, timestamp double, usage {_KIMI_COUNTS}, message struct<type:string,payload:struct<token_usage:{_KIMI_OLD},message_id:string>>")))
    new = F.coalesce((F.col("e.type") == "usage.record") & (F.col("e.usageScope") == "turn"), F.lit(False))
    old = F.coalesce((F.coalesce("e.type", F.lit("")) != "usage.record") & (F.col("e.message.type") == "StatusUpdate"), F.lit(False))
    rows = rows.where(new | old).withColumn("is_new", new)
    u, w = F.col("e.usage"), F.col("e.message.payload.token_usage")
    pick = lambda a, b: F.when(F.col("is_new"), u[a]).otherwise(w[b])
    rows = counters(rows, pick("inputOther", "input_other"), pick("output", "output"), pick("inputCacheCreation", "input_cache_creation"), pick("inputCacheRead", "input_cache_read"), None, F.when(~F.col("is_new"), w["total"]))
    session = F.when(part(F.col("file"), 3) == "agents", part(F.col("file"), 4)).otherwise(part(F.col("file"), 2))
    out = rows.withColumns(
        {
            "tool": F.lit("kimi"), "project": F.lit("kimi"), "session_id": session, "message_id": F.col("e.message.payload.message_id"),
            "ts_ms": F.coalesce(F.when(F.col("is_new"), F.col("e.time")).otherwise((F.col("e.timestamp") * 1000).cast("bigint")), F.col("modified_ms")),
            "model": F.coalesce(F.when(F.col("is_new"), F.regexp_replace("e.model", "^kimi-code/", "")), F.lit(default)),
        }
    )
    return canonical(dated(first_wins(out, ["session_id", "ts_ms", "model", "input", "output", "cache_flat", "cache_read"], PLACE), tz))


def qwen(spark: SparkSession, path: str, default: str = "unknown", tz: str = "UTC") -> DataFrame:
    """Assistant lines with usage metadata; thoughts are extra tokens, and cached input is not subtracted."""
    counts = "struct<promptTokenCount:bigint,candidatesTokenCount:bigint,thoughtsTokenCount:bigint,cachedContentTokenCount:bigint,totalTokenCount:bigint>"
    rows = lines(spark, path, marker='"usageMetadata"').withColumn("e", computed_once(F.from_json("line", f"type string, sessionId string, model string, timestamp string, uuid string, usageMetadata {counts}")))
    rows = rows.where("e.type = 'assistant' and e.usageMetadata is not null")
    u = F.col("e.usageMetadata")
    rows = counters(rows, u["promptTokenCount"], u["candidatesTokenCount"], F.lit(0), u["cachedContentTokenCount"], u["thoughtsTokenCount"], u["totalTokenCount"])
    project = F.coalesce(after(F.col("file"), "projects"), F.lit("unknown"))
    out = rows.withColumns(
        {
            "tool": F.lit("qwen"), "project": F.lit("qwen"), "project_path": project, "session_id": first(filled(F.col("e.sessionId")), F.concat(project, F.lit("-"), stem(F.col("file")))),
            "ts_ms": F.coalesce(clock.parse_ms(F.col("e.timestamp")), F.col("modified_ms")), "model": first(filled(F.col("e.model")), F.lit(default)),
        }
    )
    return canonical(dated(first_wins(out, ["session_id", "ts_ms", "model", "input", "output", "cache_read", "extra"], PLACE), tz))
