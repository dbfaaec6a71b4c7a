"""Log dialects on small records, with rows counted by hand."""

import json
import sqlite3

import pytest

from tallyspark.sources import codex, dialects, logs


def records(spark, *rows, modified=1_700_000_000_000):
    """rows: (path, value); lines of one path keep their order; values that aren't text are written as JSON."""
    return spark.createDataFrame([(p, i, modified, v if isinstance(v, str) else json.dumps(v)) for i, (p, v) in enumerate(rows)], "path string, line long, modified long, value string")


def facts(found, *more):
    return sorted((tuple(r) for r in found.select("model", "provider", "session_id", "ts_ms", "input", "output", "cache_read", "cache_write", "reasoning", *more).collect()), key=str)


def test_qwen(spark):
    u = {"promptTokenCount": 10, "candidatesTokenCount": 5, "thoughtsTokenCount": 2, "cachedContentTokenCount": 4}
    p = "/h/.qwen/projects/work/chats/s1.jsonl"
    found = dialects.qwen(records(spark, (p, {"type": "assistant", "model": "qwen3", "timestamp": "2024-01-01T00:00:00Z", "usageMetadata": u}), (p, "broken"), (p, {"type": "user", "usageMetadata": u}), (p, {"type": "assistant", "sessionId": "z", "usageMetadata": {"promptTokenCount": -3, "candidatesTokenCount": 1}}), (p, {"type": "assistant", "usageMetadata": {}})))
    assert facts(found, "dedup_key", "workspace") == [("qwen3", "qwen", "work-s1", 1704067200000, 10, 5, 4, 0, 2, "qwen:work-s1:0", "work"), ("unknown", "qwen", "z", 1700000000000, 0, 1, 0, 0, 0, "qwen:z:1", "work")]


def test_reasonix(spark):
    row = {"ts": 1704067200, "model": "deepseek/chat", "prompt": 100, "completion": 20, "reasoning": 30, "cache_hit": 60, "total": 120, "requests": 3}
    found = dialects.reasonix(records(spark, ("/s/a.jsonl", row), ("/s/a.jsonl", row | {"cache_miss": 7}), ("/s/a.jsonl", row | {"turn": True}), ("/s/a.jsonl", row | {"model": " "}), ("/s/a.jsonl", row | {"ts": "no"}), ("/s/a.jsonl", row | {"total": 0, "requests": 0})))
    assert facts(found, "message_count") == [("chat", "deepseek", "reasonix-stats:/s/a.jsonl", 1704067200000, 40, 0, 60, 0, 20, 3), ("chat", "deepseek", "reasonix-stats:/s/a.jsonl", 1704067200000, 7, 0, 60, 0, 20, 3)]


def test_junie(spark):
    p = "/j/session-240101-000000-x/events.jsonl"
    use = lambda *u, **k: {"kind": "SessionEvent", "event": {"agentEvent": {"kind": "LlmResponseMetadataEvent", "agent": {"name": "coder"}, "modelUsage": list(u)}}} | k
    one = {"model": "gpt-5", "inputTokens": 5, "outputTokens": "6", "cost": 0, "time": 1000}
    found = dialects.junie(records(spark, (p, {"kind": "UserPromptEvent"}), (p, use(one, {"model": "claude-x", "input": 1}, timestampMs=1704067205000)), (p, use(one, timestampMs=1704067205000)), (p, use({"model": "m", "cost": 2.5}))))
    got = sorted(found.select("model", "provider", "ts_ms", "input", "output", "cost", "cost_source", "duration_ms", "agent", "is_turn_start").collect())
    assert [tuple(r) for r in got] == [
        ("claude-x", "anthropic", 1704067205000, 1, 0, 0.0, "unknown", None, "coder", False),
        ("gpt-5", "openai", 1704067204000, 5, 6, 0.0, "reported", 1000, "coder", True),
        ("m", "junie", 1704067200000, 0, 0, 2.5, "reported", None, "coder", False),
    ]


def test_gjc(spark):
    msg = lambda **k: {"type": "message", "id": "m1", "timestamp": "2024-01-01T00:00:00Z", "message": {"role": "assistant", "model": "claude-opus", "usage": {"input": 3, "output": 4, "cacheRead": 5, "cacheWrite": 6, "cost": {"total": 0.5}}} | k}
    p = "/g/f.jsonl"
    found = dialects.gjc(records(spark, (p, msg()), (p, {"type": "session", "id": "S", "cwd": "C:\\w\\\\p\\"}), (p, msg(provider="acme", timestamp=1704067201000, source="9router")), (p, msg(role="user"))))
    got = sorted(map(tuple, found.select("client", "provider", "session_id", "ts_ms", "cost", "cost_source", "workspace", "dedup_key").collect()), key=str)
    assert got == [("9router", "acme", "S", 1704067201000, 0.5, "reported", "C:/w/p", "S:m1"), ("gjc", "anthropic", "f", 1704067200000, 0.5, "reported", None, "f:m1")]


def test_opencodereview(spark):
    p = "/o/r1.jsonl"
    row = {"type": "llm_response", "model": "gpt-5", "timestamp": 1704067205, "duration_ms": 2000, "usage": {"prompt_tokens": 9, "completion_tokens": 1}}
    found = dialects.opencodereview(records(spark, (p, {"type": "session_start", "cwd": "/w/x/"}), (p, row), (p, row), (p, {k: v for k, v in row.items() if k != "timestamp"}), (p, row | {"usage": {}})))
    assert facts(found, "workspace") == [("gpt-5", "openai", "r1", 1700000000000, 9, 1, 0, 0, 0, "/w/x"), ("gpt-5", "openai", "r1", 1704067203000, 9, 1, 0, 0, 0, "/w/x")]


def test_antigravity(spark):
    p, row = "/a/x.jsonl", {"type": "usage", "sessionId": "s", "timestamp": 1704067200000, "input": "7", "reasoning": 2, "responseId": "r"}
    found = dialects.antigravity(records(spark, (p, row), (p, {"type": "session_meta", "modelId": "gemini-3"}), (p, row | {"providerId": "vertex"}), (p, row | {"input": 0, "reasoning": 0}), (p, row | {"timestamp": 0})))
    assert facts(found, "dedup_key") == [("gemini-3", "anthropic", "s", 1704067200000, 7, 0, 0, 0, 2, "r"), ("unknown", "antigravity", "s", 1704067200000, 7, 0, 0, 0, 2, "r")]


def test_pi_family(spark):
    p = "/p/f.jsonl"
    rows = [(p, {"type": "session", "id": "S", "cwd": "/w"}), (p, {"type": "message", "id": "a", "timestamp": "2024-01-01T00:00:00Z", "message": {"role": "assistant", "model": "glm-5", "usage": {"input": 1, "output": 9, "reasoning": 4}}})]
    for dialect, client in ((dialects.senpi, "senpi"), (dialects.kimchi, "kimchi")):
        found = dialect(records(spark, *rows))
        assert facts(found, "client", "workspace") == [("glm-5", "zai", "S", 1704067200000, 1, 9, 0, 0, 0, client, "/w")]


def test_mux(spark):
    doc = {"byModel": {"anthropic:claude-x": {"input": {"tokens": 5, "cost_usd": 0.25}, "cached": {"tokens": 2}, "output": {"tokens": -1}}, "plain": {"reasoning": {"tokens": 3}}, "none": {}}, "lastRequest": {"timestamp": 1704067200000}}
    found = dialects.mux(records(spark, ("/m/ws9/session-usage.json", doc), ("/m/bad/session-usage.json", "{")))
    assert facts(found, "cost", "dedup_key") == [("claude-x", "anthropic", "ws9", 1704067200000, 5, 0, 2, 0, 0, 0.25, "mux:ws9:anthropic:claude-x"), ("plain", "", "ws9", 1704067200000, 0, 0, 0, 0, 3, 0.0, "mux:ws9:plain")]


def test_trae(spark):
    row = {"session_id": "s", "usage_time": 1704067200, "model_name": "GPT-5.2 Codex", "mode": "Builder", "dollar_float": 0.1, "extra_info": {"input_token": 4}}
    found = dialects.trae(records(spark, ("/t/a.json", [row, row | {"model_name": "", "session_id": "u"}, row | {"extra_info": {}}, row | {"usage_time": 0}, row | {"session_id": ""}])))
    assert facts(found, "cost") == [("gpt-5.2-codex", "openai", "s", 1704067200000, 4, 0, 0, 0, 0, 0.1), ("trae-builder", "trae", "u", 1704067200000, 4, 0, 0, 0, 0, 0.1)]


def test_warp(spark):
    spaces = {"syncedAt": "2024-01-01T00:00:00Z", "usage": {"requestsUsed": 9, "spendCents": 9}, "workspaces": [{"id": " Te am! ", "requestsUsed": 3, "spendCents": 250}, {"id": "idle"}]}
    found = dialects.warp(records(spark, ("/w/usage.json", spaces), ("/w/usage-b.json", spaces | {"workspaces": []}), ("/w/usage-c.json", spaces | {"syncedAt": None})))
    assert sorted(map(tuple, found.select("session_id", "cost", "message_count", "input").collect())) == [("warp-aggregate-account", 0.09, 9, 0), ("warp-aggregate-te-am", 2.5, 3, 0)]


def test_augment(spark):
    node = lambda n: {"token_usage": {"input_tokens": n, "output_tokens": 1 if n else 0}}
    turn = {"completed": True, "finishedAt": "2024-01-01T00:00:00Z", "exchange": {"request_id": "r", "response_nodes": [node(1), node(8), node(0), {}]}}
    doc = {"sessionId": "S", "agentState": {"modelId": "claude-y"}, "chatHistory": [turn, turn | {"completed": False}, {"completed": True, "sequenceId": 4, "exchange": {"model_id": "gpt-5", "response_nodes": [node(2)]}}, {"completed": True, "exchange": {"response_nodes": []}}]}
    found = dialects.augment(records(spark, ("/a/f.json", doc)))
    assert facts(found, "dedup_key") == [("claude-y", "anthropic", "S", 1704067200000, 8, 1, 0, 0, 0, "augment:S:req:r"), ("gpt-5", "openai", "S", 1700000000000, 2, 1, 0, 0, 0, "augment:S:seq:4")]


def test_task_logs(spark):
    body = json.dumps({"tokensIn": 5, "tokensOut": "6", "cacheReads": 1, "cost": 0.5, "apiProtocol": "anthropic"})
    ui = [{"type": "say", "say": "api_req_started", "ts": 1704067200000, "text": body}, {"type": "say", "say": "text", "ts": 1, "text": body}, {"type": "say", "say": "api_req_started", "text": body}]
    history = [{"content": "<environment_details><model>old</model></environment_details> <model>not here</model> <environment_details>\n<model> new </model><name>N</name></environment_details>"}]
    both = records(spark, ("/r/tasks/t1/ui_messages.json", ui), ("/r/tasks/t1/api_conversation_history.json", history), ("/r/tasks/t2/ui_messages.json", ui))
    for dialect, client in ((dialects.roocode, "roocode"), (dialects.kilocode, "kilocode"), (dialects.cline, "cline")):
        assert facts(dialect(both), "client", "agent", "cost") == [("new", "anthropic", "t1", 1704067200000, 5, 6, 1, 0, 0, client, "N", 0.5), ("unknown", "anthropic", "t2", 1704067200000, 5, 6, 1, 0, 0, client, None, 0.5)]
    said = lambda role, *kinds, **k: {"role": role, "ts": 1704067200000, "content": [{"type": x} for x in kinds]} | k
    reply = {"modelInfo": {"id": "gpt-5", "provider": "openai"}, "metrics": {"inputTokens": 3, "cost": 0.25}}
    cli = {"sessionId": "S", "agent": "act", "messages": [said("user", "text"), said("assistant", "text", id="1", **reply), said("user", "tool_result", "text"), said("assistant", "text", id="2", **reply)]}
    found = dialects.cline(records(spark, ("/c/S/S.messages.json", cli)))
    assert facts(found, "is_turn_start", "dedup_key") == [("gpt-5", "openai", "S", 1704067200000, 3, 0, 0, 0, 0, False, "cline:S:2"), ("gpt-5", "openai", "S", 1704067200000, 3, 0, 0, 0, 0, True, "cline:S:1")]


def test_droid(spark):
    own = {"model": "custom:Claude-Opus-4.6-[Proxy]", "providerLock": "anthropic", "providerLockTimestamp": "2024-01-01T00:00:00Z", "tokenUsage": {"inputTokens": 3, "thinkingTokens": 1}}
    nameless = {"providerLock": "openai", "tokenUsage": {"outputTokens": 2}}
    found = dialects.droid(records(spark, ("/d/a.settings.json", own), ("/d/b.settings.json", nameless), ("/d/b.jsonl", 'x Model: GPT-5.2 [openai] "'), ("/d/c.settings.json", nameless), ("/d/e.settings.json", own | {"tokenUsage": {}})))
    assert facts(found) == [("claude-opus-4-6", "anthropic", "a", 1704067200000, 3, 0, 0, 0, 1), ("gpt-5-2", "openai", "b", 1700000000000, 0, 2, 0, 0, 0), ("gpt-unknown", "openai", "c", 1700000000000, 0, 2, 0, 0, 0)]


def test_codebuff(spark):
    p = "/h/manicode/projects/web/chats/2024-01-01T00-00-00.000Z/chat-messages.json"
    deep = {"runState": {"sessionState": {"mainAgentState": {"messageHistory": [{"role": "assistant", "providerOptions": {"usage": {"outputTokens": 1}}}, {"role": "assistant", "providerOptions": {"codebuff": {"model": "glm-5", "usage": {"completion_tokens": 7}}}}]}}}}
    rows = [{"variant": "ai", "id": "m1", "credits": 2.0, "metadata": {"model": "claude-x", "usage": {"inputTokens": 4, "prompt_tokens_details": {"cached_tokens": 3}}}}, {"role": "user", "metadata": {"usage": {"inputTokens": 4}}}, {"role": "assistant", "timestamp": 1704067201, "metadata": deep}, {"variant": "agent"}]
    found = dialects.codebuff(records(spark, (p, rows)))
    s = "manicode/web/2024-01-01T00-00-00.000Z"
    assert facts(found, "cost") == [("claude-x", "anthropic", s, 1704067200000, 4, 0, 3, 0, 0, 2.0), ("glm-5", "zai", s, 1704067201000, 0, 7, 0, 0, 0, 0.0)]


def test_sqlite(spark, tmp_path):
    def base(name, *statements):
        (tmp_path / name).mkdir()
        file = tmp_path / name / {"kilo": "kilo.db", "goose": "sessions.db", "hermes": "state.db"}[name]
        with sqlite3.connect(file) as db:
            db.execute("PRAGMA journal_mode = WAL")
            for sql, *rows in statements:
                db.executemany(sql, rows) if rows else db.execute(sql)
        db.close()
        return str(tmp_path / name)

    data = {"role": "assistant", "modelID": "claude-x", "providerID": "vertex", "cost": 0.5, "tokens": {"input": 3, "output": -2, "cache": {"read": 4, "write": 5}}, "time": {"created": 1704067200000.0}, "mode": "plan"}
    kilo = base("kilo", ("CREATE TABLE message (id TEXT, session_id TEXT, data TEXT)",), ("INSERT INTO message VALUES (?,?,?)", ("m", "s", json.dumps(data)), ("n", "s", "{"), ("o", "s", json.dumps(data | {"role": "user"}))))
    assert facts(logs.read(spark, "kilo", kilo), "agent", "dedup_key") == [("claude-x", "anthropic", "s", 1704067200000, 3, 0, 4, 5, 0, "plan", "m")]
    columns = "id, model_config_json, provider_name, created_at, total_tokens, input_tokens, output_tokens, accumulated_total_tokens, accumulated_input_tokens, accumulated_output_tokens"
    goose = base("goose", (f"CREATE TABLE sessions ({columns})",), ("INSERT INTO sessions VALUES (?,?,?,?,?,?,?,?,?,?)", ("a", '{"model_name": "gpt-5"}', None, "2024-01-01 00:00:00", 1, 1, 1, 100, 60, 30), ("b", '{"model_name": " "}', None, "", 1, 1, 1, 1, 1, 1), ("c", '{"model_name": "m"}', "my", "2024-01-01", None, 2, 3, None, None, None), ("d", '{"model_name": "m"}', "my", "x", 0, 0, 0, None, None, None)))
    assert facts(logs.read(spark, "goose", goose)) == [("gpt-5", "openai", "a", 1704067200000, 60, 30, 0, 0, 10), ("m", "my", "c", 1704067200000, 2, 3, 0, 0, 0)]
    hermes = base(
        "hermes",
        ("CREATE TABLE sessions (id, model, started_at, message_count, input_tokens, output_tokens, cache_read_tokens, cache_write_tokens, reasoning_tokens, billing_provider, estimated_cost_usd, actual_cost_usd)",),
        ("INSERT INTO sessions VALUES (?,?,?,?,?,?,?,?,?,?,?,?)", ("s1", "claude-x", 1704067200.0, 5, 99, 0, 0, 0, 0, "anthropic", 1, 2), ("s2", "gpt-5", 1704067200.0, 2, 7, 0, 0, 0, 0, None, 0.5, None), ("s3", " ", 1, 1, 1, 1, 1, 1, 1, None, 1, 1)),
        ("CREATE TABLE session_model_usage (session_id, model, billing_provider, input_tokens, output_tokens, cache_read_tokens, cache_write_tokens, reasoning_tokens, actual_cost_usd, estimated_cost_usd)",),
        ("INSERT INTO session_model_usage VALUES (?,?,?,?,?,?,?,?,?,?)", ("s1", "a-first", "openai", 1, 0, 0, 0, 0, 0, 0.25), ("s1", "claude-x", "anthropic", 2, 0, 0, 0, 0, 0.5, 9), ("s1", "claude-x", "anthropic", 3, 0, 0, 0, 0, 0, 0.125), ("s1", "none", "x", 0, 0, 0, 0, 0, 0, 0)),
    )
    assert facts(logs.read(spark, "hermes", hermes), "message_count", "cost") == [("a-first", "openai", "s1", 1704067200000, 1, 0, 0, 0, 0, 0, 0.25), ("claude-x", "anthropic", "s1", 1704067200000, 5, 0, 0, 0, 0, 5, 0.625), ("gpt-5", "openai", "s2", 1704067200000, 7, 0, 0, 0, 0, 2, 0.5)]
    (tmp_path / "kilo" / "sub").mkdir()
    (tmp_path / "kilo" / "sub" / "kilo.db").write_bytes(b"not a database")
    assert logs.read(spark, "kilo", kilo).count() == 1


def test_files(spark, tmp_path):
    (tmp_path / "usage-1.csv").write_text('Date,Model,Input (w/ Cache Write),Input (w/o Cache Write),Cache Read,Output Tokens,Total Tokens,Cost\n"2024-01-01T00:00:00Z","gpt-5, max","1,000",2,3,4,9,"$1,234.50"\n')
    (tmp_path / "usage-2.csv").write_text("Date,Cloud Agent ID,Automation ID,Kind,Model,Max Mode,Input (w/ Cache Write),Input (w/o Cache Write),Cache Read,Output Tokens,Total Tokens,Cost,Cost to you\n2024-01-02,,,Included,claude,No,5,6,7,8,26,Included,0.5\n")
    assert facts(logs.read(spark, "cursor", str(tmp_path)), "cost") == [("claude", "cursor", "cursor-2024-01-02", 1704153600000, 6, 8, 7, 5, 0, 0.5), ("gpt-5, max", "cursor", "cursor-2024-01-01", 1704067200000, 2, 4, 3, 1000, 0, 1234.5)]
    (tmp_path / "w9").mkdir()
    (tmp_path / "w9" / "session-usage.json").write_text('\ufeff{"byModel":\n{"m":{"input":{"tokens":1}}}, "lastRequest": {"timestamp": 5}}')
    assert facts(logs.read(spark, "mux", str(tmp_path))) == [("m", "", "w9", 5, 1, 0, 0, 0, 0)]
    with pytest.raises(ValueError):
        logs.read(spark, "nobody", str(tmp_path))


def test_increments():
    t = (100, 10, 40, 4)
    assert codex.increment(t, None, None) == (t, t) and codex.increment(t, (5, 1, 0, 0), None) == ((5, 1, 0, 0), t)
    assert codex.increment(t, (5, 1, 0, 0), t) == (None, t)  # a repeat
    assert codex.increment((99, 10, 40, 4), (5, 1, 0, 0), t) == (None, t)  # a late snapshot
    assert codex.increment((2, 1, 0, 0), (2, 1, 0, 0), t) == ((2, 1, 0, 0), (2, 1, 0, 0))  # a reset
    assert codex.increment((120, 12, 40, 4), None, t) == ((20, 2, 0, 0), (120, 12, 40, 4))
    assert codex.increment((3, 1, 0, 0), None, t) == (None, (3, 1, 0, 0))
    assert codex.increment(None, (5, 1, 0, 0), t) == ((5, 1, 0, 0), (105, 11, 40, 4)) and codex.increment(None, (5, 1, 0, 0), None)[1] is None
    assert codex.buckets((10, 5, 30, 9)) == (0, 0, 10, 5)


def _codex(kind, at, **payload):
    return {"type": kind, "timestamp": f"2024-01-01T00:00:{at:02d}Z", "payload": payload}


def _count(at, total=None, last=None, **more):
    usage = lambda n: {"input_tokens": n, "output_tokens": 1}
    info = {k: usage(v) for k, v in (("total_token_usage", total), ("last_token_usage", last)) if v is not None}
    return _codex("event_msg", at, type="token_count", info=info | more)


def test_codex_sessions(spark):
    p, q, base = "/c/rollout-a.jsonl", "/c/rollout-b.jsonl", 1704067200000
    own = [_codex("session_meta", 0, id="A", cwd="/w/p", model_provider="azure"), _count(1, 10, 10), _codex("turn_context", 2, model="gpt-5"), _codex("event_msg", 3, type="user_message", message="<env>"), _codex("event_msg", 4, type="user_message", message="hi"), _count(6, 30, 20), _count(7, 30, 20), _count(8, 45, 15)]
    fork = [_codex("session_meta", 20, id="B", forked_from_id="A"), _codex("session_meta", 20, id="A"), _count(20, 30, 20), _codex("turn_context", 21, model="gpt-5.1"), _count(22, 30, 20), _count(23, 42, 12)]
    found = codex.codex_rows(records(spark, *((p, x) for x in own), (p, "{"), *((q, x) for x in fork)))
    got = sorted(tuple(r) for r in found.select("session_id", "ts_ms", "model", "provider", "input", "output", "duration_ms", "is_turn_start", "workspace").collect())
    assert got == [
        ("rollout-a", base + 1000, "gpt-5", "azure_ai", 10, 1, None, False, "/w/p"),
        ("rollout-a", base + 4000, "gpt-5", "azure_ai", 20, 1, 2000, True, "/w/p"),
        ("rollout-a", base + 6000, "gpt-5", "azure_ai", 15, 1, 2000, False, "/w/p"),
        ("rollout-b", base + 21000, "gpt-5.1", "openai", 12, 1, 2000, False, None),
    ]
    nameless = codex.codex_rows(records(spark, (p, _count(1, None, 4)), (p, _count(2, None, 0))))
    assert [(r["model"], r["provider"], r["input"]) for r in nameless.collect()] == [("unknown", "openai", 4), ("unknown", "openai", 0)]


def test_claude_turns_and_tools(spark):
    p = "/l/s.jsonl"
    said = lambda **k: {"sessionId": "s", "timestamp": "2024-01-01T00:00:00Z"} | k
    use = lambda i: {"id": i, "model": "claude-x", "usage": {"input_tokens": 1}}
    rows = [
        said(type="user", message={"content": "hello"}), said(type="assistant", requestId="r", message=use("a")), said(type="assistant", requestId="r", message=use("b")),
        said(type="user", message={"content": [{"type": "tool_result", "tool_use_id": "t1"}]}, toolUseResult={"agentId": "x", "usage": {"input_tokens": 9}}), said(type="assistant", message=use("c"), isSidechain=True, agentId="side"),
    ]
    got = sorted(tuple(r) for r in logs.claude_rows(records(spark, *((p, r) for r in rows))).select("dedup_key", "input", "is_turn_start", "agent").collect())
    assert got == [("a:r", 1, True, None), ("b:r", 1, False, None), ("claude:tool_result:s:t1", 9, False, "x"), ("message:c", 1, False, "side")]


def test_gemini(spark):
    row = lambda **t: {"type": "gemini", "model": "gemini-3", "timestamp": "2024-01-01T00:00:00Z", "tokens": t}
    doc = {"sessionId": "S", "messages": [row(input=10, cached=4, output=2, total=12), row(input=10, cached=4, output=2, total=16), row(prompt=3, tool=2, thoughts=1), {"type": "user"}, {"tokens": {"input": 1}}]}
    found = dialects.gemini(records(spark, ("/g/session-1.json", doc)))
    assert facts(found) == sorted([("gemini-3", "google", "S", 1704067200000, 6, 2, 4, 0, 0), ("gemini-3", "google", "S", 1704067200000, 10, 2, 4, 0, 0), ("gemini-3", "google", "S", 1704067200000, 5, 0, 0, 0, 1)], key=str)


def test_openclaw(spark):
    p = "/o/s1.jsonl.reset.1"
    msg = lambda **k: {"type": "message", "message": {"role": "assistant", "timestamp": 1704067200000, "usage": {"input": 1, "cost": {"total": 0.5}}} | k}
    found = dialects.openclaw(records(spark, (p, msg()), (p, {"type": "model_change", "modelId": "a", "provider": "x"}), (p, msg()), (p, {"type": "custom", "customType": "model-snapshot", "data": {"modelId": "b"}}), (p, msg()), (p, msg(model="c", provider="z")), (p, msg(model=""))))
    assert sorted((r["model"], r["provider"], r["session_id"], r["cost"]) for r in found.collect()) == [("a", "x", "s1", 0.5), ("b", "x", "s1", 0.5), ("c", "z", "s1", 0.5), ("c", "z", "s1", 0.5)]


def test_commandcode(spark):
    p = "/h/.commandcode/projects/web/s.jsonl"
    said = lambda role, content: {"role": role, "content": content, "sessionId": "S", "timestamp": "2024-01-01T00:00:00Z"}
    found = dialects.commandcode(records(spark, ("/h/.commandcode/config.json", {"model": "z/GLM-5-Free"}), (p, said("user", "123456")), (p, said("tool", [1, 2])), (p, said("assistant", "12")), (p, said("assistant", "")), (p, said("assistant", "abcdef"))))
    assert facts(found, "is_turn_start", "dedup_key", "workspace") == [("GLM-5", "zai", "S", 1704067200000, 0, 2, 0, 0, 0, False, "S:1", "web"), ("GLM-5", "zai", "S", 1704067200000, 4, 1, 0, 0, 0, True, "S:0", "web")]


def test_spans_of_several_tiers(spark):
    span = lambda trace, operation, n, **more: {"traceId": trace, "timestamp": 1704067200000, "attributes": {"gen_ai.operation.name": operation, "gen_ai.response.model": "gpt-5", "gen_ai.usage.input_tokens": n, "gen_ai.usage.cache_read.input_tokens": 2} | more}
    found = dialects.tiered_spans(records(spark, ("/c/a.jsonl", span("t1", "chat", 10)), ("/c/a.jsonl", span("t1", "invoke_agent", 99)), ("/c/a.jsonl", span("t2", "invoke_agent", 7)), ("/c/a.jsonl", span("t3", "other", 1))))
    assert sorted((r["session_id"], r["input"], r["cache_read"]) for r in found.collect()) == [("t1", 8, 2), ("t2", 5, 2)]


def test_crush(spark, tmp_path):
    with sqlite3.connect(tmp_path / "crush.db") as db:
        db.execute("CREATE TABLE sessions (id, parent_session_id, message_count, cost, created_at, updated_at)")
        db.execute("CREATE TABLE messages (id, session_id, role, created_at)")
        db.executemany("INSERT INTO sessions VALUES (?,?,?,?,?,?)", [("r", None, 2, 9.0, 1704067200, 1704067300), ("c", "r", 1, 5.0, 1, 1), ("g", "c", 1, None, 1, 1), ("lone", None, 0, 2.0, 1704067200, None), ("none", None, 0, 0, 1, 1)])
        db.executemany("INSERT INTO messages VALUES (?,?,?,?)", [("1", "r", "assistant", 1704067200), ("2", "g", "assistant", 1704067260000), ("3", "c", "assistant", 1704153600), ("4", "r", "user", 1704067200), ("5", "r", "assistant", 0)])
    db.close()
    got = sorted((r["ts_ms"], round(r["cost"], 9), r["message_count"], r["session_id"].rpartition(":")[2]) for r in logs.read(spark, "crush", str(tmp_path)).collect())
    assert got == [(1704067200000, 2.0, 0, "lone"), (1704067200000, 6.0, 2, "r"), (1704153600000, 3.0, 1, "r")]


def test_message_tables(spark):
    data = {"role": "assistant", "modelID": "claude-x", "tokens": {"input": 3, "output": 1, "cache": {"read": 4, "write": 5}}, "time": {"created": 1704067200, "completed": 1704067201.5}, "path": {"root": "/w/p"}, "cost": 0.5}
    row = {"id": "m", "session_id": "s", "data": json.dumps(data)}
    found = dialects.opencode(records(spark, ("/o/opencode.db", row), ("/o/storage/message/n.json", data | {"sessionID": "t"})))
    assert facts(found, "workspace", "duration_ms", "dedup_key") == [("claude-x", "anthropic", "s", 1704067200000, 3, 1, 4, 5, 0, "/w/p", 1500, "m"), ("claude-x", "anthropic", "t", 1704067200000, 3, 1, 4, 5, 0, "/w/p", 1500, "n")]
    found = dialects.micode(records(spark, ("/m/a.db", row), ("/m/a.db", row | {"id": "copy"})))
    assert facts(found, "cost_source", "dedup_key") == [("claude-x", "anthropic", "s", 1704067200000, 3, 1, 4, 5, 0, "reported", "m")]
