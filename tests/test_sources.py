"""Log sources on small samples of our own."""

import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from tallyflow.operators.dedup import dedup_daily, dedup_generic
from tallyflow.sources import documents, jsonl, registry, sqlite

AT = "2026-03-0{}T10:00:0{}.000Z"


def put(path, *records, raw=()):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join([json.dumps(r, separators=(",", ":")) for r in records] + list(raw)) + "\n")


def doc(path, value):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps(value))


def totals(df):
    r = df.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("input", "output", "cache_flat", "cache_read", "extra")), F.count("*").alias("n")).first()
    return tuple(r)


def claude_line(i, mid, rid, usage, **more):
    return {"timestamp": AT.format(1 + i // 5, i % 5), "version": "1.0.3", "requestId": rid, "message": {"id": mid, "model": "claude-sonnet-4", "usage": {"input_tokens": 1, "output_tokens": 1} | usage}} | more


def test_claude(spark, tmp_path):
    chat = tmp_path / "projects/demo/ses/chat.jsonl"
    put(
        chat,
        claude_line(0, "a", "r1", {"input_tokens": 100, "cache_creation_input_tokens": 7}),
        claude_line(1, "a", "r1", {"input_tokens": 120, "cache_creation": {"ephemeral_5m_input_tokens": 3, "ephemeral_1h_input_tokens": 4}, "speed": "fast"}),
        claude_line(2, "b", "r2", {"iterations": [{"type": "advisor_message", "model": "m", "input_tokens": 5, "output_tokens": 6}, {"type": "other"}, {"type": "advisor_message", "model": "m", "input_tokens": 7, "output_tokens": 8}]}),
        claude_line(3, "c", "r3", {"iterations": [{"type": "advisor_message", "model": "m"}]}),
        claude_line(4, "d", "r4", {}, version="x"),
        claude_line(5, "e", "r5", {}, costUSD=None),
        claude_line(6, "f", "r6", {"input_tokens": -1}),
        {"data": {"message": claude_line(7, "g", "r7", {"input_tokens": 1000})}},
        claude_line(8, "", "r8", {}),
        {**claude_line(9, "h", "r9", {}), "isApiErrorMessage": True, "note": "Claude AI usage limit reached, come back|1790000000"},
        raw=["not json", '{"message":{"usage": {"input_tokens":1}}}'],
    )
    rows = jsonl.claude(spark, str(tmp_path)).collect()
    assert sorted(r["message_id"] for r in rows) == ["a", "a", "b", "b:advisor:0", "b:advisor:1", "c", "h"]
    by = {r["message_id"]: r for r in rows}
    assert by["h"]["limit_reset_ms"] == 1790000000000 and by["a"]["project"] == "demo" and by["b"]["session_id"] == "ses"
    fast = next(r for r in rows if r["input"] == 120)
    assert fast["model"] == "claude-sonnet-4-fast" and fast["cache_split"]["c1h"] == 4
    daily = {r["message_id"] for r in jsonl.claude(spark, str(tmp_path), daily=True).collect()}
    assert daily == {"a", "b", "b:advisor:0", "b:advisor:1", "c", "g", "h"}
    assert [r["input"] for r in dedup_generic(jsonl.claude(spark, str(tmp_path))).where("message_id = 'a'").collect()] == [120]
    assert [r["input"] for r in dedup_daily(jsonl.claude(spark, str(tmp_path), daily=True)).where("message_id = 'a'").collect()] == [120]


def test_codex(spark, tmp_path):
    def count(i, last, total, **info):
        u = lambda x: dict(zip(("input_tokens", "cached_input_tokens", "output_tokens"), x, strict=True))
        return {"timestamp": AT.format(1, i), "type": "event_msg", "payload": {"type": "token_count", "info": ({"last_token_usage": u(last)} if last else {}) | ({"total_token_usage": u(total)} if total else {}) | info}}

    put(
        tmp_path / "sessions/p/one.jsonl",
        {"timestamp": AT.format(1, 0), "type": "turn_context", "payload": {"model": "gpt-5.2-codex"}},
        count(1, (100, 30, 10), (100, 30, 10)),
        count(2, (100, 30, 10), (100, 30, 10)),
        count(3, None, (150, 40, 15)),
        count(4, (5, 9, 1), None, model="codex-auto-review"),
    )
    rows = jsonl.codex(spark, str(tmp_path)).orderBy("ts_ms").collect()
    assert [(r["model"], r["input"], r["cache_read"], r["output"]) for r in rows] == [("gpt-5.2-codex", 70, 30, 10), ("gpt-5.2-codex", 40, 10, 5), ("gpt-5.3-codex", 0, 5, 1)]
    assert {r["session_id"] for r in rows} == {"p/one"}


def test_forked_sessions_lose_what_they_replay(spark):
    parent = spark.createDataFrame([("p", None, k, v) for k, v in enumerate([1, 2, 3, 4])], "session string, parent string, pos int, input int")
    child = spark.createDataFrame([("c", "p", k, v) for k, v in enumerate([1, 2, 9, 4])] + [("d", "gone", 0, 1)], "session string, parent string, pos int, input int")
    left = jsonl.without_replay(child, parent, ("input",)).orderBy("session", "pos").collect()
    assert [(r["session"], r["input"]) for r in left] == [("c", 9), ("c", 4), ("d", 1)]


def test_pi_and_omp(spark, tmp_path):
    line = lambda i, **usage: {"type": "message", "id": f"m{i}", "timestamp": AT.format(1, i), "message": {"role": "assistant", "model": "gpt-5", "usage": usage}}
    path = tmp_path / "sessions/proj/2026-03-01T10-00-00-000Z_main"
    put(path / "Side.jsonl", line(1, input=10, output=5, cacheRead=1, cacheWrite=2, totalTokens=18, cost={"total": 0.5}), line(1, input=10, output=5, cacheRead=1, cacheWrite=2, totalTokens=18, cost={"total": 0.5}), line(2, input=100, output=0, totalTokens=300), line(3, input=0, output=0), {"type": "message", "message": {"role": "user"}})
    assert totals(jsonl.pi(spark, str(tmp_path))) == (110, 205, 2, 1, 0, 2)
    assert {r["session_id"] for r in jsonl.omp(spark, str(tmp_path)).collect()} == {"main"}
    assert {r["model"] for r in jsonl.pi(spark, str(tmp_path)).collect()} == {"[pi] gpt-5"}


def test_openclaw_carries_the_model(spark, tmp_path):
    message = lambda i, **m: {"type": "message", "timestamp": AT.format(1, i), "message": {"role": "assistant", "usage": {"input": 1, "output": 2}} | m}
    put(tmp_path / "s1.jsonl", message(0), {"type": "model_change", "modelId": "m1", "provider": "p"}, message(1), {"type": "custom", "customType": "model-snapshot", "data": {"model": "m2"}}, message(2), message(3, model="own"))
    rows = jsonl.openclaw(spark, str(tmp_path)).orderBy("ts_ms").collect()
    assert [r["model"] for r in rows] == [f"[openclaw] {m}" for m in ("unknown", "m1", "m2", "own")]


def test_copilot_prefers_better_telemetry(spark, tmp_path):
    span = lambda op, trace, resp, i, **more: {"type": "span", "traceId": trace, "name": f"{op} x", "endTime": [1775934200 + i, 0], "attributes": {"gen_ai.operation.name": op, "gen_ai.response.model": "gpt-5.4", "gen_ai.response.id": resp, "gen_ai.usage.input_tokens": 10 * i, "gen_ai.usage.output_tokens": i} | more}
    put(
        tmp_path / "otel.jsonl",
        span("invoke_agent", "t1", "r1", 9),
        span("chat", "t1", "r1", 1, **{"gen_ai.usage.cache_read.input_tokens": 4}),
        {"hrTime": [1775934200, 0], "attributes": {"event.name": "gen_ai.client.inference.operation.details", "gen_ai.response.id": "r1", "gen_ai.usage.input_tokens": 5}},
        {"timestamp": "1775934265000", "attributes": {"event.name": "copilot_chat.agent.turn", "session.id": "s", "gen_ai.usage.total_tokens": 77}},
        span("invoke_agent", "t2", "r2", 2),
        {"type": "metric", "attributes": {}},
    )
    rows = jsonl.copilot(spark, str(tmp_path))
    assert totals(rows) == (6 + 20, 1 + 77 + 2, 0, 4, 0, 3)
    assert {r["session_id"] for r in rows.collect()} == {"t1", "s", "t2"}


def test_gemini(spark, tmp_path):
    g = lambda i, mid, **tokens: {"type": "gemini", "id": mid, "model": "gemini-3", "timestamp": AT.format(1, i), "tokens": tokens}
    put(tmp_path / "log.jsonl", {"sessionId": "s1"}, g(1, "a", input=100, output=10, cached=40, total=110), g(2, "a", input=100, output=20, cached=40, total=120), g(3, "b", input=100, output=10, cached=40, total=150))
    doc(tmp_path / "doc.json", {"sessionId": "s2", "timestamp": AT.format(2, 0), "stats": {"models": {"gemini-3": {"tokens": {"prompt": 50, "candidates": 5, "cached": 20, "thoughts": 3, "total": 58}}}}})
    doc(tmp_path / "plain.json", {"sessionId": "s3", "model": "gemini-2", "stats": {"input": 9, "output": 1}})
    rows = jsonl.gemini(spark, str(tmp_path))
    assert sorted((r["session_id"], r["input"], r["output"], r["cache_read"], r["extra"]) for r in rows.collect()) == [("s1", 60, 20, 40, 0), ("s1", 100, 10, 40, 0), ("s2", 30, 5, 20, 3), ("s3", 9, 1, 0, 0)]


def test_kimi_and_qwen(spark, tmp_path):
    put(
        tmp_path / "kimi/sessions/s9/wire.jsonl",
        {"type": "usage.record", "usageScope": "turn", "time": 1775934200000, "model": "kimi-code/k2", "usage": {"inputOther": 5, "output": 6, "inputCacheRead": 7}},
        {"type": "usage.record", "usageScope": "session", "usage": {"inputOther": 500}},
        {"timestamp": 1775934201.5, "message": {"type": "StatusUpdate", "payload": {"token_usage": {"input_other": 1, "output": 0, "total": 10}, "message_id": "m"}}},
    )
    assert totals(jsonl.kimi(spark, str(tmp_path / "kimi"))) == (6, 15, 0, 7, 0, 2)
    put(tmp_path / "qwen/projects/pp/chat.jsonl", {"type": "assistant", "timestamp": AT.format(1, 1), "usageMetadata": {"promptTokenCount": 10, "candidatesTokenCount": 4, "thoughtsTokenCount": 3, "cachedContentTokenCount": 2, "totalTokenCount": 20}}, {"type": "user"})
    assert totals(jsonl.qwen(spark, str(tmp_path / "qwen"))) == (10, 4, 0, 2, 4, 1)


def test_documents(spark, tmp_path):
    doc(tmp_path / "amp/a.json", {"id": "t1", "messages": [{"role": "assistant", "messageId": 1, "usage": {"cacheCreationInputTokens": 3, "cacheReadInputTokens": 4}}], "usageLedger": {"events": [{"id": "e", "timestamp": AT.format(1, 1), "model": "m", "toMessageId": 1, "credits": 2.5, "tokens": {"input": 10, "output": 0, "total": 30}}]}})
    doc(tmp_path / "amp/b.json", {"id": "t2", "messages": [{"role": "assistant", "messageId": 7, "usage": {"model": "m", "timestamp": AT.format(1, 2), "inputTokens": 5, "outputTokens": 6, "totalTokens": 15}}]})
    assert totals(documents.amp(spark, str(tmp_path / "amp"))) == (15, 19, 3, 4, 4, 2)
    doc(tmp_path / "droid/s1.settings.json", {"model": "Claude-Sonnet-4-[Anthropic]", "providerLockTimestamp": AT.format(1, 1), "tokenUsage": {"inputTokens": 1, "outputTokens": 2, "thinkingTokens": 3}})
    assert [(r["model"], r["extra"]) for r in documents.droid(spark, str(tmp_path / "droid")).collect()] == [("claude-sonnet-4", 3)]
    chat = tmp_path / "chan/projects/pp/chats/2026-03-01T03-04-05.000Z/chat-messages.json"
    history = [{"providerOptions": {"codebuff": {"usage": {"outputTokens": n}}}} for n in (1, 8)]
    doc(chat, [{"role": "user"}, {"id": "a", "role": "assistant", "credits": 1.5, "metadata": {"model": "m", "usage": {"inputTokens": 4}, "runState": {"sessionState": {"mainAgentState": {"messageHistory": history}}}}}, {"id": "a", "role": "assistant", "metadata": {"usage": {"totalTokens": 9}}}])
    rows = documents.codebuff(spark, str(tmp_path / "chan")).collect()
    assert [(r["input"], r["output"], r["ts_ms"]) for r in rows] == [(0, 9, 1772334245000)]
    doc(tmp_path / "cline/x/x.messages.json", {"sessionId": "s", "messages": [{"id": "1", "role": "assistant", "ts": 1775934200000, "modelInfo": {"id": "m"}, "metrics": {"inputTokens": 100, "outputTokens": 4, "cacheReadTokens": 20, "cacheWriteTokens": 10, "cost": "0.5"}}, {"id": "2", "role": "assistant", "ts": 1775934201000, "metrics": {"cost": 0.25}}]})
    doc(tmp_path / "cline/x/x.json", {"workspace_root": "/w"})
    rows = documents.cline(spark, str(tmp_path / "cline")).orderBy("ts_ms").collect()
    assert [(r["input"], r["cost_usd"], r["model"], r["project_path"]) for r in rows] == [(70, 0.5, "m", "/w"), (0, 0.25, "m", "/w")]
    message = lambda i: {"id": f"m{i}", "sessionID": "s", "role": "assistant", "providerID": "anthropic", "modelID": "claude-sonnet-4.5", "time": {"created": 1775934200000}, "tokens": {"input": i, "output": 1, "cache": {"read": 2, "write": 3}}, "cost": 0}
    for i in (1, 2):
        doc(tmp_path / f"oc/s/m{i}.json", message(i))
    rows = documents.opencode(spark, str(tmp_path / "oc"), spark.createDataFrame([("db", 0, "m1", "s", json.dumps(message(1000)))], "file string, line_ord bigint, key string, session string, data string")).collect()
    assert sorted((r["input"], r["model"], r["cost_usd"]) for r in rows) == [(2, "claude-sonnet-4-5", None), (1000, "claude-sonnet-4-5", None)]


def test_sqlite(spark, tmp_path):
    with sqlite3.connect(tmp_path / "z.db") as db:
        db.execute("CREATE TABLE session(id, parent_id, directory)")
        db.execute("CREATE TABLE model_usage(id, session_id, model_id, started_at, input_tokens, output_tokens, reasoning_tokens, cache_creation_input_tokens, cache_read_input_tokens)")
        db.execute("CREATE TABLE message(id, session_id, time_created, data)")
        db.executemany("INSERT INTO session VALUES(?,?,'/')", [("a", None), ("b", "a"), ("c", "b"), ("x", "y"), ("y", "x"), ("z", "gone")])
        db.executemany("INSERT INTO model_usage VALUES(?,?,'m',1775934200000,100,5,0,10,20)", [("u1", "c"), ("u2", "x"), ("u3", "z")])
        said = json.dumps({"modelID": "m", "tokens": {"input": 9, "output": 1, "cache": {"read": 0, "write": 0}}})
        db.executemany("INSERT INTO message VALUES(?,?,1775934200000,?)", [("m1", "c", said), ("m2", "b", said)])
    rows = sqlite.zcode(spark, f"{tmp_path}/*.db").collect()
    assert sorted((r["session_id"], r["input"]) for r in rows) == [("a", 9), ("a", 70), ("y", 70), ("z", 70)]
    with sqlite3.connect(tmp_path / "g.sqlite") as db:
        db.execute("CREATE TABLE sessions(id, model_config_json, provider_name, created_at, total_tokens, input_tokens, output_tokens, accumulated_total_tokens, accumulated_input_tokens, accumulated_output_tokens)")
        db.executemany("INSERT INTO sessions VALUES(?,?,'p','2026-03-01 10:00:00',?,?,?,?,?,?)", [("s1", '{"model_name":"m"}', 10, 4, 5, 100, 60, 30), ("s2", '{"model_name":"m"}', 10, 4, 5, None, 0, -1), ("s3", " ", 1, 1, 1, 1, 1, 1)])
    assert totals(sqlite.goose(spark, f"{tmp_path}/*.sqlite")) == (64, 35, 0, 0, 11, 2)
    with sqlite3.connect(tmp_path / "h.state") as db:
        db.execute("CREATE TABLE sessions(id, model, started_at, message_count, input_tokens, output_tokens, cache_read_tokens, cache_write_tokens, reasoning_tokens, actual_cost_usd, estimated_cost_usd)")
        db.executemany("INSERT INTO sessions VALUES(?,?,1775934200.5,3,1,2,3,4,5,?,?)", [("s1", "m", 0, 0.5), ("s2", None, 0.25, 1)])
    rows = sqlite.hermes(spark, f"{tmp_path}/*.state").collect()
    assert sorted((r["session_id"], r["cost_usd"], r["ts_ms"], r["message_count"]) for r in rows) == [("s1", 0.5, 1775934200500, 3), ("s2", 0.25, 1775934200500, 3)]
    assert sqlite.kilo(spark, f"{tmp_path}/none*").collect() == []


def test_sqlite_folders_and_failures(spark, tmp_path):
    said = json.dumps({"role": "assistant", "modelID": "m", "providerID": "p", "time": {"created": 1775934200000}, "tokens": {"input": 9, "output": 1}})
    (tmp_path / "a dir?/deep").mkdir(parents=True)
    with sqlite3.connect(tmp_path / "a dir?/deep/kilo.db") as db:
        db.execute("CREATE TABLE message(id, session_id, data)")
        db.execute("INSERT INTO message VALUES('m1', 's1', ?)", (said,))
    with sqlite3.connect(tmp_path / "a dir?/other.db") as db:
        db.execute("CREATE TABLE settings(id)")
    (tmp_path / "a dir?/notes.txt").write_text("no database")
    rows = registry.load(spark, {"kilo": str(tmp_path / "a dir?")}).collect()
    assert [(r["session_id"], r["input"], r["output"]) for r in rows] == [("s1", 9, 1)]
    with pytest.raises(Exception, match="nowhere"):
        sqlite.kilo(spark, f"{tmp_path}/nowhere").collect()
    with sqlite3.connect(tmp_path / "odd.db") as db:
        db.execute("CREATE TABLE message(id)")
        db.execute("INSERT INTO message VALUES('m1')")
    with pytest.raises(Exception, match="no such column"):
        sqlite.kilo(spark, f"{tmp_path}/odd.db").collect()


def test_registry(spark, tmp_path):
    put(tmp_path / "pi/sessions/p/x_s.jsonl", {"id": "1", "timestamp": AT.format(1, 1), "message": {"role": "assistant", "usage": {"input": 3}}})
    doc(tmp_path / "amp/a.json", {"id": "t", "messages": []})
    rows = registry.load(spark, {"pi": str(tmp_path / "pi"), "amp": str(tmp_path / "amp")})
    assert [(r["tool"], r["input"]) for r in rows.collect()] == [("pi", 3)]
    assert len(registry.SOURCES) == 18
    with pytest.raises(ValueError):
        registry.register_source("pi", lambda s, p: None)


def codex_log(path, sid, at, counts, parent=None, seconds=None):
    """A session whose usage entries have the given counts, at `at` plus their seconds."""
    stamp = lambda s: f"2026-03-01T{at}:{s // 60:02}:{s % 60:02}.000Z"
    used = lambda n, s: {"timestamp": stamp(s), "type": "event_msg", "payload": {"type": "token_count", "info": {"last_token_usage": {"input_tokens": n, "output_tokens": 1}}}}
    seconds = seconds or [60 * (k + 1) for k in range(len(counts))]
    put(path, {"timestamp": stamp(0), "type": "session_meta", "payload": {"id": sid} | (parent or {})}, *(used(n, s) for n, s in zip(counts, seconds, strict=True)))


def test_codex_forks_lose_their_replays(spark, tmp_path):
    fork = {"forked_from_id": "p"}
    folder = tmp_path / "sessions"
    # Forked at 11: the parent's 40 came later, so the child's own 40 stays, and so does a 10 behind it.
    codex_log(folder / "parent.jsonl", "p", "10", [10, 20, 30, 40], seconds=[60, 120, 180, 3599])
    codex_log(folder / "child.jsonl", "c", "11", [10, 20, 30, 41, 10], fork)
    codex_log(folder / "spawned.jsonl", "s", "12", [10, 22], {"source": {"subagent": {"thread_spawn": {"parent_thread_id": "p"}}}})
    codex_log(folder / "early.jsonl", "e", "13", [5, 10, 20], fork)
    codex_log(folder / "orphan.jsonl", "o", "14", [1, 2, 3, 4], {"forked_from_id": "gone"}, [1, 2, 3, 60])
    codex_log(folder / "calm.jsonl", "q", "15", [6, 7], {"forked_from_id": "gone"})
    codex_log(folder / "own.jsonl", "z", "16", [8, 9], {"forked_from_id": "z"}, [1, 2])
    codex_log(folder / "plain.jsonl", "n", "17", [10, 20], {"source": "cli"}, [1, 2])
    got = {}
    for r in jsonl.codex(spark, str(tmp_path)).orderBy("session_id", "ts_ms").collect():
        got.setdefault(r["session_id"], []).append(r["input"])
    assert got == {"parent": [10, 20, 30, 40], "child": [41, 10], "spawned": [22], "early": [5, 10, 20], "orphan": [4], "calm": [6, 7], "plain": [10, 20]}


def test_codex_replays_end_at_the_fork(spark, tmp_path):
    folder = tmp_path / "sessions"
    codex_log(folder / "parent.jsonl", "p", "10", [10, 20, 30], seconds=[60, 120, 3000])
    at = "2026-03-01T10:30:00.000Z"
    used = lambda n, k: {"timestamp": f"2026-03-01T10:4{k}:00.000Z", "type": "event_msg", "payload": {"type": "token_count", "info": {"last_token_usage": {"input_tokens": n, "output_tokens": 1}}}}
    put(folder / "child.jsonl", {"timestamp": at, "type": "session_meta", "payload": {"id": "c", "forked_from_id": "p"}}, used(10, 0), used(20, 1), used(30, 2))
    rows = jsonl.codex(spark, str(tmp_path)).where("session_id = 'child'").collect()
    assert [r["input"] for r in rows] == [30]


def test_a_large_log_is_split_and_numbered_as_one(spark, tmp_path):
    from tallyflow.sources.files import documents as whole
    from tallyflow.sources.files import lines

    (tmp_path / "deep").mkdir()
    for name, n in (("a.jsonl", 3000), ("deep/b.jsonl", 7), ("deep/c.jsonl", 900)):
        (tmp_path / name).write_text("".join(f"{name} {i} é{'x' * (i % 50)}{chr(13) if i % 9 == 0 else ''}\n" if i % 5 else "\n" for i in range(n)) + "no end")
    was = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
        spark.conf.set("spark.sql.files.openCostInBytes", "16")
        read = lines(spark, str(tmp_path))
        got = {(r["file"].rpartition("/")[2], r["line_ord"], r["line"]) for r in read.collect()}
        rows = whole(spark, str(tmp_path), "*.jsonl").collect()
        want = {(r["file"].rpartition("/")[2], n, line.rstrip("\r")) for r in rows for n, line in enumerate(r["value"].split("\n")) if line.rstrip("\r")}
        assert got == want and read.rdd.getNumPartitions() > 10
        one = lines(spark, str(tmp_path), marker="9 é")
        assert {(r["file"].rpartition("/")[2], r["line_ord"], r["line"]) for r in one.where("file like '%a.jsonl'").collect()} == {x for x in want if "9 é" in x[2] and x[0] == "a.jsonl"}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was[0])
        spark.conf.set("spark.sql.files.openCostInBytes", was[1])


def test_codex_headless_entries_tiers_and_types(spark, tmp_path):
    used = lambda i, usage, **more: {"timestamp": AT.format(1, i), "type": "event_msg", "payload": {"type": "token_count", "info": {"last_token_usage": usage}} | more}
    tier = lambda i, **settings: {"timestamp": AT.format(1, i), "type": "event_msg", "payload": {"type": "thread_settings_applied", "thread_settings": settings}}
    put(
        tmp_path / "sessions/types.jsonl",
        {"type": "turn_context", "payload": {"model": "one"}},
        used(0, {"input_tokens": "100", "output_tokens": " 7 "}),
        used(1, {"input_tokens": 1.0, "prompt_tokens": 50, "output_tokens": True}),
        used(2, {"input_tokens": -3, "output_tokens": 4}),
        used(3, {"input_tokens": {"a": 1}, "output_tokens": 4}),
        used(4, {"input_tokens": 9}, model=5),
        used(5, {"reasoning_tokens": 3}),
        {"timestamp": True, "type": "event_msg", "payload": {"type": "token_count", "info": {"last_token_usage": {"input_tokens": 1}}}},
        {"timestamp": 1772359206, "type": "event_msg", "payload": {"type": "token_count", "model": " ", "model_name": "two", "info": {"last_token_usage": {"input": 6}}}},
        used(7, {"input_tokens": 0}, model="unused"),
        used(8, {"input_tokens": 8}),
        raw=['{ "timestamp": "2026-03-01T10:00:09.000Z", "type" : "event_msg", "payload": { "type" : "token_count", "info": {"last_token_usage": {"input_tokens": 11}, "last_token_usage": {"input_tokens": 12}}}}'],
    )
    rows = jsonl.codex(spark, str(tmp_path)).orderBy("ts_ms").collect()
    assert [(r["model"], r["input"], r["output"]) for r in rows] == [("one", 100, 7), ("one", 50, 0), ("one", 0, 4), ("one", 0, 0), ("two", 6, 0), ("two", 8, 0), ("two", 12, 0)]

    put(
        tmp_path / "exec/sessions/run.jsonl",
        {"created_at": 1772359200, "usage": {"prompt_tokens": 5, "cached_tokens": 9, "completion_tokens": 2}, "model": 7, "data": {"model_name": "three"}},
        {"type": "turn.completed", "result": {"timestamp": AT.format(2, 1), "usage": {"input_tokens": 4, "output_tokens": 1}, "metadata": {"model": "four"}}},
        {"type": "x", "usage": [1], "response": {"createdAt": AT.format(2, 2), "usage": {"input": 3}}},
        {"usage": {"input_tokens": 0, "output_tokens": 0}, "data": {"usage": {"input_tokens": 99}}},
        {"usage": {"total_tokens": 30}, "timestamp": AT.format(2, 3)},
    )
    rows = jsonl.codex(spark, str(tmp_path / "exec")).orderBy("ts_ms").collect()
    assert [(r["model"], r["input"], r["cache_read"], r["output"]) for r in rows] == [("three", 0, 5, 2), ("four", 4, 0, 1), ("four", 3, 0, 0), ("four", 0, 0, 0)]

    same = {"input_tokens": 10, "output_tokens": 1}
    put(tmp_path / "t/sessions/a.jsonl", tier(0, service_tier="priority"), used(1, same), tier(2, other=1), used(3, same), tier(4, service_tier="odd"), used(5, same))
    put(tmp_path / "t/sessions/b.jsonl", used(1, same), used(1, same | {"total_tokens": 12}), tier(2, service_tier="default"), used(3, same), used(5, same))
    rows = jsonl.codex(spark, str(tmp_path / "t")).orderBy("session_id", "ts_ms").collect()
    assert [(r["session_id"], r["ts_ms"] % 10_000, r["speed"]) for r in rows] == [("a", 1000, "fast"), ("a", 3000, "standard"), ("a", 5000, "standard"), ("b", 1000, None)]


def _message_db(path, clock, n=200):
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE message(id, session_id, data" + (", time_created)" if clock else ")"))
        for k in range(n):
            at = 1775934200000 + k * 1000
            said = json.dumps({"role": "assistant", "modelID": "m", "providerID": "p", "time": {"created": at}, "tokens": {"input": k + 1, "output": 1}})
            db.execute(f"INSERT INTO message VALUES({', '.join('?' * (4 if clock else 3))})", (f"{path.stem}{k}", "s", said, at // (1000 if clock == "seconds" else 1))[: 4 if clock else 3])


@pytest.mark.parametrize("clock", ["millis", "seconds", None])
def test_sqlite_filters_run_in_the_database(spark, tmp_path, clock):
    _message_db(tmp_path / "a.db", clock)
    since, until = 1775934200000 + 50_000, 1775934200000 + 60_000
    stored = sqlite.stored_messages(spark, str(tmp_path), since, until)
    plan = stored._jdf.queryExecution().executedPlan().toString()
    assert "BatchScan tallyflow_sqlite" in plan and "Filter (" not in plan and "Filter " not in plan
    assert [r["key"] for r in stored.orderBy("created").collect()] == [f"a{k}" for k in range(50, 60)]
    some = sqlite.stored_messages(spark, str(tmp_path)).where("key in ('a3', 'a4', 'a5') and key <= 'a4' and session is not null")
    assert [r["key"] for r in some.orderBy("key").collect()] == ["a3", "a4"]
    assert [r["input"] for r in sqlite.kilo(spark, str(tmp_path), since_ms=since, until_ms=until).orderBy("ts_ms").collect()] == list(range(51, 61))


def test_sqlite_reads_only_the_rows_of_the_window(tmp_path):
    from pyspark.sql.datasource import GreaterThanOrEqual, LessThan, StringStartsWith
    from pyspark.sql.types import StructType

    _message_db(tmp_path / "a.db", "millis")
    schema = StructType.fromDDL("file string, line_ord bigint, key string, session string, data string, created bigint")
    reader = sqlite._Reader(schema, {"path": str(tmp_path), "query": "SELECT id, session_id, data, {clock} FROM message", "of": "message", "clock": "time_created", "other": "0", "key": ["key", "id"]})
    filters = [GreaterThanOrEqual(("created",), 1775934200000 + 190_000), LessThan(("line_ord",), 5), StringStartsWith(("key",), "a")]
    assert list(reader.pushFilters(filters)) == filters[1:]
    with sqlite3.connect(tmp_path / "a.db") as db:
        said, values = reader.statement(db)
    assert "key IN (SELECT id FROM message WHERE time_created >= ?)" in said and values == [1775934200000 + 190_000]
    assert len(list(reader.read(reader.partitions()[0]))) == 10


def test_opencode_reads_its_database_before_its_files(spark, tmp_path):
    _message_db(tmp_path / "opencode.db", "millis", 5)
    for name, tokens in (("opencode2", 1000), ("other", 7)):
        doc(tmp_path / f"storage/message/s/{name}.json", {"id": name, "sessionID": "s", "role": "assistant", "providerID": "p", "modelID": "m", "time": {"created": 1775934200000 + 2000}, "tokens": {"input": tokens, "output": 1}})
    rows = registry.load(spark, {"opencode": str(tmp_path)}).collect()
    assert sorted(r["input"] for r in rows) == [1, 2, 3, 4, 5, 7]
    narrow = sqlite.opencode(spark, str(tmp_path), since_ms=1775934200000 + 2000, until_ms=1775934200000 + 4000).collect()
    assert sorted(r["input"] for r in narrow) == [3, 4, 7]
    (tmp_path / "opencode.db").unlink()
    assert sorted(r["input"] for r in registry.load(spark, {"opencode": str(tmp_path)}).collect()) == [7, 1000]


def test_claude_rejects_wrong_types_and_parses_once(spark, tmp_path):
    bad = [
        claude_line(0, "a", "r", {"input_tokens": "5"}), claude_line(0, "b", "r", {"output_tokens": 1.0}), claude_line(0, "c", "r", {"cache_read_input_tokens": -1}), claude_line(0, "d", "r", {"speed": 1}), claude_line(0, 5, "r", {}),
        claude_line(0, "f", 7, {}), claude_line(0, "g", "r", {}, costUSD="0.5"), claude_line(0, "h", "r", {}, isSidechain="yes"), claude_line(0, "i", "r", {}, sessionId=1), claude_line(0, "j", "r", {"cache_creation": {"ephemeral_5m_input_tokens": "3"}}), claude_line(0, "k", "r", {"input_tokens": [1]}),
    ]
    good = [claude_line(0, "x", "r", {"cache_creation_input_tokens": 3}, costUSD=1, isSidechain=True), claude_line(0, "y", "s", {}, costUSD=0.25, sessionId="s", isSidechain=None, other={"a": [1]})]
    put(tmp_path / "projects/p/s/chat.jsonl", *bad, *good, {"data": {"message": claude_line(1, "z", "t", {})}}, {"data": {"message": claude_line(1, "w", "t", {"input_tokens": "1"})}})
    read = jsonl.claude(spark, str(tmp_path))
    assert sorted(r["message_id"] for r in read.collect()) == ["x", "y"]
    assert sorted(r["message_id"] for r in jsonl.claude(spark, str(tmp_path), daily=True).collect()) == ["x", "y", "z"]
    assert read._jdf.queryExecution().optimizedPlan().toString().count("from_json(") == 2
