"""Sources that write one JSON document a session or message: amp, opencode, droid, codebuff, cline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import clock, text
from ..operators.dedup import carry_forward, first_wins
from ..schema import canonical
from .files import after, computed_once, counters, dated, documents, filled, first, lines, part, stem

_AMP = (
    "id string, usageLedger struct<events:array<struct<id:string,timestamp:string,model:string,toMessageId:bigint,credits:double,tokens:struct<input:bigint,output:bigint,total:bigint>>>>, "
    "messages array<struct<role:string,messageId:bigint,timestamp:string,model:string,usage:struct<model:string,timestamp:string,inputTokens:bigint,outputTokens:bigint,cacheCreationInputTokens:bigint,cacheReadInputTokens:bigint,totalTokens:bigint,credits:double>>>"
)


def amp(spark: SparkSession, path: str, tz: str = "UTC") -> DataFrame:
    """Ledger events, with cache counters of the message they belong to; messages only where there is no ledger."""
    threads = documents(spark, path).withColumn("e", computed_once(F.from_json("value", _AMP))).where("e.id <> ''")
    has = F.col("e.usageLedger.events").isNotNull()
    message = threads.select("file", F.posexplode("e.messages").alias("line_ord", "m"), F.col("e.id").alias("thread"), has.alias("has"))
    cache = message.where("m.messageId is not null and m.usage is not null").select("file", F.col("m.messageId").alias("to"), F.col("m.usage.cacheCreationInputTokens").alias("create"), F.col("m.usage.cacheReadInputTokens").alias("read"), "line_ord")
    cache = first_wins(cache, ["file", "to"], ("line_ord",), last=True).drop("line_ord")
    ledger = threads.where(has).select("file", F.posexplode("e.usageLedger.events").alias("line_ord", "v"), F.col("e.id").alias("thread")).where("v.tokens is not null")
    ledger = ledger.withColumn("to", F.col("v.toMessageId")).join(cache, ["file", "to"], "left")
    a = ledger.select("file", "line_ord", "thread", F.col("v.timestamp").alias("at"), filled(F.col("v.model")).alias("model"), F.col("v.tokens.input").alias("i"), F.col("v.tokens.output").alias("o"), F.col("create").alias("c"), F.col("read").alias("r"), F.col("v.tokens.total").alias("t"), F.col("v.id").alias("message_id"), F.col("v.credits").alias("credits"))
    u = F.col("m.usage")
    b = message.where(~F.col("has") & (F.col("m.role") == "assistant") & u.isNotNull())
    b = b.select("file", "line_ord", "thread", first(filled(u["timestamp"]), F.col("m.timestamp")).alias("at"), first(filled(u["model"]), filled(F.col("m.model"))).alias("model"), u["inputTokens"].alias("i"), u["outputTokens"].alias("o"), u["cacheCreationInputTokens"].alias("c"), u["cacheReadInputTokens"].alias("r"), u["totalTokens"].alias("t"), F.col("m.messageId").cast("string").alias("message_id"), u["credits"].alias("credits"))
    rows = a.unionByName(b).withColumn("ts_ms", clock.parse_ms(F.col("at"))).where("ts_ms is not null and model is not null")
    rows = counters(rows, F.col("i"), F.col("o"), F.col("c"), F.col("r"), None, F.col("t"))
    return canonical(dated(rows.withColumns({"tool": F.lit("amp"), "project": F.lit("amp"), "session_id": F.col("thread")}), tz))


MESSAGE = "id string, sessionID string, role string, providerID string, modelID string, time struct<created:bigint>, tokens struct<input:bigint,output:bigint,reasoning:bigint,total:bigint,cache:struct<read:bigint,write:bigint>>, cost double"
# Opencode names that stand for another, and the model families whose versions it writes without hyphens.
OPENCODE_ALIASES = {"gemini-3-pro-high": "gemini-3-pro-preview", "k2p6": "kimi-k2.6"}
OPENCODE_FAMILIES = "claude-(?:haiku|opus|sonnet)-"


def opencode_model(name):
    """In those families 4.5 and 45 are 4-5; some names stand for another."""
    dotted, packed = rf"^({OPENCODE_FAMILIES}\d*)\.(\d)", rf"^({OPENCODE_FAMILIES}\d)(\d)"
    out = F.when(name.rlike(dotted), F.regexp_replace(name, dotted, "$1-$2")).otherwise(F.regexp_replace(name, packed, "$1-$2"))
    for a, b in OPENCODE_ALIASES.items():
        out = F.when(out == a, F.lit(b)).otherwise(out)
    return out


def messages(rows: DataFrame, tool: str, tz: str = "UTC") -> DataFrame:
    """Assistant messages of the shared message format: file, line_ord, key (the row's id), data (JSON)."""
    rows = rows.withColumn("e", computed_once(F.from_json("data", MESSAGE)))
    rows = rows.where("e.tokens is not null and e.modelID <> '' and e.providerID <> '' and coalesce(e.role, 'assistant') = 'assistant'")
    t = F.col("e.tokens")
    rows = counters(rows, t["input"], t["output"], t["cache"]["write"], t["cache"]["read"], t["reasoning"], t["total"])
    own = {"tool": F.lit(tool), "project": F.lit(tool), "session_id": first(F.col("e.sessionID"), F.col("session")), "message_id": first(F.col("e.id"), F.col("key")), "ts_ms": clock.seconds_or_millis(F.col("e.time.created"), inclusive=False), "model": opencode_model(F.col("e.modelID")) if tool == "opencode" else F.col("e.modelID"), "cost_usd": F.when(F.col("e.cost") > 0, F.col("e.cost")) if tool == "opencode" else F.col("e.cost")}
    return canonical(dated(first_wins(rows.withColumns(own), ["message_id"], ("file", "line_ord")), tz))


def opencode(spark: SparkSession, path: str, stored: DataFrame | None = None, tz: str = "UTC", covered: DataFrame | None = None) -> DataFrame:
    """Message files; `stored` are the rows of its database (file, line_ord, key, session, data), which come first; `covered` the keys of all of them, if these are more."""
    files = documents(spark, path).select("file", F.lit(0).cast("bigint").alias("line_ord"), stem(F.col("file")).alias("key"), part(F.col("file"), 2).alias("session"), F.col("value").alias("data"))
    if stored is not None:
        files = stored.select(files.columns).unionByName(files.join((stored if covered is None else covered).select("key").distinct(), "key", "left_anti").select(files.columns))
    return messages(files, "opencode", tz)


def droid(spark: SparkSession, path: str, tz: str = "UTC") -> DataFrame:
    """Settings snapshots: the newest of each session; the model may stand in the session's log beside them."""
    rows = documents(spark, path, "*.settings.json").withColumn("e", computed_once(F.from_json("value", "model string, providerLock string, providerLockTimestamp string, tokenUsage struct<inputTokens:bigint,outputTokens:bigint,cacheCreationTokens:bigint,cacheReadTokens:bigint,thinkingTokens:bigint,totalTokens:bigint>")))
    rows = rows.where("e.tokenUsage is not null").withColumns({"session_id": F.regexp_replace(part(F.col("file"), 1), r"\.settings\.json$", ""), "line_ord": F.lit(0).cast("bigint")})
    log = lines(spark, path, marker="odel").withColumns({"session_id": stem(F.col("file")), "said": first(filled(F.get_json_object("line", "$.model")), filled(F.nullif(F.regexp_extract("line", r"Model: ([^\s\"\\\[]+)", 1), F.lit(""))))})
    log = log.where("said is not null").groupBy("session_id").agg(F.min_by("said", F.struct("file", "line_ord")).alias("said"))
    u, e = F.col("e.tokenUsage"), F.col("e")
    rows = counters(rows.join(log, "session_id", "left"), u["inputTokens"], u["outputTokens"], u["cacheCreationTokens"], u["cacheReadTokens"], u["thinkingTokens"], u["totalTokens"])
    fallback = F.when(e["providerLock"].isin("anthropic", "openai", "google", "xai"), F.concat(F.element_at(F.create_map(*(F.lit(x) for x in ("anthropic", "claude", "openai", "gpt", "google", "gemini", "xai", "grok"))), e["providerLock"]), F.lit("-unknown"))).otherwise(F.lit("unknown"))
    rows = rows.withColumns({"tool": F.lit("droid"), "project": F.lit("droid"), "ts_ms": F.coalesce(clock.parse_ms(e["providerLockTimestamp"]), F.col("modified_ms")), "model": text.droid_model(first(filled(e["model"]), F.col("said"), fallback))})
    return canonical(dated(first_wins(rows, ["session_id"], ("ts_ms", "file"), last=True), tz))


_BUFF_USAGE = "struct<inputTokens:bigint,input_tokens:bigint,promptTokens:bigint,prompt_tokens:bigint,outputTokens:bigint,output_tokens:bigint,completionTokens:bigint,completion_tokens:bigint,cacheCreationInputTokens:bigint,cache_creation_input_tokens:bigint,cacheCreationTokens:bigint,cache_creation_tokens:bigint,cachedTokensCreated:bigint,cached_tokens_created:bigint,cacheReadInputTokens:bigint,cache_read_input_tokens:bigint,promptTokensDetails:struct<cachedTokens:bigint>,prompt_tokens_details:struct<cached_tokens:bigint>,totalTokens:bigint,total_tokens:bigint,total:bigint>"
_BUFF = f"array<struct<id:string,role:string,variant:string,timestamp:string,credits:double,metadata:struct<model:string,usage:{_BUFF_USAGE},codebuff:struct<usage:{_BUFF_USAGE}>,runState:struct<sessionState:struct<mainAgentState:struct<messageHistory:array<struct<role:string,providerOptions:struct<codebuff:struct<model:string,usage:{_BUFF_USAGE}>>>>>>>>>>"


def codebuff(spark: SparkSession, path: str, tz: str = "UTC") -> DataFrame:
    """Chat messages: usage from the message, then codebuff's own, then the run's history from its end."""
    rows = documents(spark, path, "chat-messages.json").select("file", "modified_ms", F.posexplode(F.from_json("value", _BUFF)).alias("line_ord", "m"))
    rows = rows.where("coalesce(m.variant, m.role) in ('assistant', 'ai', 'agent')")
    history = F.reverse(F.coalesce(F.transform("m.metadata.runState.sessionState.mainAgentState.messageHistory", lambda h: h["providerOptions"]["codebuff"]["usage"]), F.array().cast(f"array<{_BUFF_USAGE}>")))
    tried = F.concat(F.array(F.col("m.metadata.usage"), F.col("m.metadata.codebuff.usage")), history)
    safe = lambda c: F.coalesce(c, F.lit(0))
    pick = lambda *names: F.get(F.filter(F.transform(tried, lambda u: F.coalesce(*(u[n] for n in names))), lambda x: x.isNotNull()), F.lit(0))
    read = F.get(F.filter(F.transform(tried, lambda u: F.greatest(F.coalesce(u["cacheReadInputTokens"], u["cache_read_input_tokens"]), u["promptTokensDetails"]["cachedTokens"], u["prompt_tokens_details"]["cached_tokens"])), lambda x: x.isNotNull()), F.lit(0))
    create = pick("cacheCreationInputTokens", "cache_creation_input_tokens", "cacheCreationTokens", "cache_creation_tokens", "cachedTokensCreated", "cached_tokens_created")
    rows = counters(rows, safe(pick("inputTokens", "input_tokens", "promptTokens", "prompt_tokens")), safe(pick("outputTokens", "output_tokens", "completionTokens", "completion_tokens")), safe(create), safe(read), None, pick("totalTokens", "total_tokens", "total"))
    chat = clock.parse_ms(F.regexp_replace(part(F.col("file"), 2), r"T(\d\d)-(\d\d)-(\d\d)", "T$1:$2:$3"))
    rows = rows.withColumns(
        {
            "tool": F.lit("codebuff"), "project": after(F.col("file"), "projects"), "session_id": F.concat_ws("/", part(F.col("file"), 6), after(F.col("file"), "projects"), part(F.col("file"), 2)),
            "ts_ms": first(clock.parse_ms(F.col("m.timestamp")), chat, F.col("modified_ms")), "model": F.coalesce(filled(F.col("m.metadata.model")), F.lit("codebuff-unknown")), "credits": F.col("m.credits"), "message_id": F.col("m.id"),
        }
    )
    return canonical(dated(first_wins(rows, ["session_id", "message_id"], ("file", "line_ord"), last=True), tz))


def cline(spark: SparkSession, path: str, tz: str = "UTC") -> DataFrame:
    """Message files with the manifest beside them; model and provider stay until a message names others."""
    sent = documents(spark, path, "*.messages.json").select("file", "modified_ms", F.from_json("value", "sessionId string, messages array<struct<id:string,role:string,ts:bigint,modelInfo:struct<id:string,provider:string>,metrics:struct<inputTokens:bigint,outputTokens:bigint,cacheReadTokens:bigint,cacheWriteTokens:bigint,cost:string>>>").alias("e"))
    about = documents(spark, path, "*.json").where(~F.col("file").endswith(".messages.json")).select(F.regexp_replace("file", r"\.json$", ".messages.json").alias("file"), F.from_json("value", "session_id string, cwd string, workspace_root string, model string, provider string").alias("about"))
    rows = sent.join(about, "file", "left").select("file", "modified_ms", "about", F.col("e.sessionId").alias("sid"), F.posexplode("e.messages").alias("line_ord", "m"))
    rows = carry_forward(rows.withColumn("model", filled(F.col("m.modelInfo.id"))), "model", ["file"], ("line_ord",))
    w = F.col("m.metrics")
    cost = F.when(w["cost"].rlike(r"^\d+(\.\d+)?([eE][+-]?\d+)?$"), w["cost"].cast("double"))
    rows = rows.where((F.col("m.role") == "assistant") & w.isNotNull()).withColumns(
        {
            "tool": F.lit("cline"), "project": F.lit("cline"), "session_id": first(F.col("sid"), F.col("about.session_id"), stem(F.col("file"))), "project_path": first(filled(F.col("about.workspace_root")), F.col("about.cwd")), "message_id": F.col("m.id"),
            "ts_ms": F.coalesce("m.ts", "modified_ms"), "model": first(F.col("model"), F.col("about.model"), F.lit("unknown")), "cost_usd": cost, "input": text.without_overlap(text.count(w["inputTokens"]), text.count(w["cacheReadTokens"]) + text.count(w["cacheWriteTokens"])),
            "output": text.count(w["outputTokens"]), "cache_flat": text.count(w["cacheWriteTokens"]), "cache_read": text.count(w["cacheReadTokens"]),
        }
    )
    rows = rows.where("input + output + cache_flat + cache_read > 0 or cost_usd > 0")
    return canonical(dated(first_wins(rows, ["session_id", "message_id"], ("file", "line_ord")), tz))
