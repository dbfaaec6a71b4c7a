"""Further operators as queries: precedence, rotation, archive rules, zones, trees. Columns that the test tables lack are
made of event numbers, by arithmetic that SQL repeats."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names
from ..operators import archive, filters, hierarchy, precedence, price_lookup, pricing, rotation, series
from ..sources import bridge

usage = bridge.usage_from_events
NOW = 1_706_000_000_000


def priced(spark, sf):
    return pricing.priced(usage(spark, sf))


def with_columns(u, **columns: str):
    return u.withColumns({k: F.expr(v) for k, v in columns.items()})


# Sources that tell of one request -------------------------------------------------------------------------------------

_TIERED = {"tier": "element_at(array('chat', 'inference', 'agent_turn', 'agent_summary'), int(event_id % 4 + 1))", "trace": "if(event_id % 3 = 0, string(event_id div 7), null)", "response": "if(event_id % 5 < 3, concat('r', event_id div 6), null)"}
_TIERED_SQL = "t AS (SELECT event_id, event_id % 4 AS k, CASE WHEN event_id % 3 = 0 THEN CAST(event_id // 7 AS VARCHAR) END AS trace, CASE WHEN event_id % 5 < 3 THEN 'r' || (event_id // 6) END AS response FROM usage)"


def _tiers(spark, sf):
    own = with_columns(usage(spark, sf), **_TIERED)
    return precedence.tiered(own.select("event_id", "tier", "trace", "response")).select("event_id", "tier")


_DUPLICATE = {"dedup_key": "string(event_id div 3)", "start_ms": "if(event_id % 4 = 0, null, ts_ms)", "end_ms": "if(event_id % 5 = 0, null, ts_ms + event_id % 1000)", "agent": "if(event_id % 3 = 0, '', concat('a', event_id % 7))", "agent_direct": "event_id % 2 = 0"}


def _duplicates(spark, sf):
    own = with_columns(usage(spark, sf), **_DUPLICATE).select("event_id", "dedup_key", "input", "output", "cache_read", "cache_write", "reasoning", "start_ms", "end_ms", "duration_ms", "agent", "agent_direct")
    return precedence.merged_duplicates(own)


def _lanes(spark, sf):
    own = with_columns(usage(spark, sf), lane="if(event_id % 2 = 0, 'json', 'sqlite')")
    return precedence.lane_order(own, "lane", "opencode").select("event_id", "lane")


def _forms(spark, sf):
    u = usage(spark, sf)
    covered = u.where("client = 'claude'").select(F.concat(F.lit("s:"), "session_id").alias("key")).union(u.where("client = 'claude'").select(F.concat(F.lit("k:"), "dedup_key")))
    rows = u.where("client = 'codex'")
    return precedence.not_covered(rows, covered.where("key is not null"), F.concat(F.lit("s:"), F.col("date")), F.concat(F.lit("k:"), F.col("dedup_key"))).select("event_id")


def _filled(spark, sf):
    own = with_columns(usage(spark, sf), said="if(event_id % 50 = 0, model, null)")
    return precedence.unique_or_null(own.select("event_id", "session_id", "said"), own.where("said is not null").select("session_id", "said"), "session_id", "said")


def _retained(spark, sf):
    u = usage(spark, sf).select("event_id", "dedup_key")
    return precedence.retained(u.where("event_id < 600"), u.where("event_id >= 300"))


ALIASES = {"gpt-5-4": "GPT Five", "claude-opus-4-6": "opus", "grok-4": "grok-4"}
_GATEWAY = {"model": "element_at(array('hf:Org/Model-X', 'accounts/fireworks/models/GLM-5', 'Plain', 'hf:bare', 'accounts/x/models/y'), int(event_id % 5 + 1))", "provider": "element_at(array('unknown', '', 'glhf', 'acme', 'acme'), int(event_id % 5 + 1))"}

# Rotation -------------------------------------------------------------------------------------------------------------

_WINDOWS = {"account": "session_id", "scope": "if(event_id % 3 = 0, 'model', null)", "percent_used": "if(event_id % 11 = 0, 'NaN', event_id % 101)", "resets_at": f"if(event_id % 13 = 0, null, {NOW} + (event_id % 7 - 3) * 1000)"}
_TASKS = {"generation": "event_id % 8", "observed_at": f"{NOW} - (event_id % 8) * 3000", "thread": "concat('t', event_id div 2)", "account": "client", "started_at": "ts_ms"}
_STATE = f"CASE WHEN generation * 3000 > {rotation.FRESH_MS} THEN 'stale' ELSE 'fresh' END"


def _tasks(spark, sf):
    return rotation.task_activity(with_columns(usage(spark, sf), **_TASKS).select(*_TASKS), F.lit(NOW))


def _route(spark, sf):
    own = with_columns(usage(spark, sf), owner="if(event_id % 3 = 0, concat('a', event_id % 5), null)").select(F.col("event_id").alias("request"), "owner")
    accounts = spark.createDataFrame([("a0", 3, True, False), ("a1", 1, False, False), ("a2", 2, True, False), ("a3", 0, True, True)], "account string, priority int, available boolean, excluded boolean")
    return rotation.route(own, accounts)


PAYLOADS = ['{"error": {"type": "usage_limit_reached"}}', '{"type": "error", "message": "Usage limit hit"}', '{"message": "usage limit"}', "broken", '{"error": {"message": "other"}}']
PLANS = ['{"rate_limit_tier": "default_claude_max_20x"}', '{"usageMultiplier": 5}', '{"claudeAiOauth": {"rateLimitTier": "max_5x"}}', '{"rate_limit_tier": "free"}', "x"]
SPELLED = [" /X-AI/ ", "vertex", "AI21", "gpt4", "unknown", "<none>", "Z-ai", "minimaxai", "stepfun-ai", ""]
_CANONICAL = ["xai", "anthropic", "ai21", None, None, None, "zai", "minimax", "stepfun", None]
FAMILIES = ["cc-mirror/work", "9router", "codex", "claude"]
VERSIONS = ["claude-opus-4-6", "gpt-5-4-mini", "m-2026-01-02", "x-10-2", "a-1-2-3", "plain"]
_VERSIONED = ["claude-opus-4.6", "gpt-5.4-mini", "m-2026-01-02", "x-10-2", "a-1.2.3", "plain"]


def pick(values: list, u, name: str):
    return u.withColumn(name, F.element_at(F.array(*map(F.lit, values)), (F.col("event_id") % len(values) + 1).cast("int")))


def literal(values: list) -> str:
    """An SQL list, picked by event number."""
    return "[" + ", ".join("NULL" if v is None else repr(v) if isinstance(v, str) else str(v) for v in values) + f"][event_id % {len(values)} + 1]"


# Archive --------------------------------------------------------------------------------------------------------------

_REVISED = {"event": "string(event_id div 6)", "generation": "event_id * 7 % 5", "model_conflicted": "false", "client": "'codex'", "model": "concat('m', event_id % 3)", "provider": "'p'", "ts_ms": "1", "input": "event_id % 2", "output": "0", "cache_read": "0", "cache_write": "0", "reasoning": "0", "duration_ms": "bigint(null)", "message_count": "1", "is_turn_start": "false", "reported_nanos": "bigint(event_id % 4)"}


def _revisions(spark, sf):
    return archive.hashes(with_columns(usage(spark, sf), **_REVISED))


def _first(spark, sf):
    found = archive.first_observation(_revisions(spark, sf).withColumn("accounting_hash", F.expr("concat(event_id % 3, event_id % 2)")).withColumn("revision_hash", F.expr("lpad(event_id, 9, '0')")))
    return found.select("event", "event_id", "selected")


_GROWN = {"event": "string(event_id div 4)", "generation": "event_id % 4", "same": "if(event_id % 23 = 0, 'y', 'x')", "input": "event_id % 4 + if(event_id % 17 = 0, -3, 0)", "cost_rank": "0", "revision_hash": "lpad(event_id, 9, '0')", "is_turn_start": "false", "duration_ms": "bigint(null)", "message_count": "1", "output": "1", "cache_read": "0", "cache_write": "0", "reasoning": "0"}


def _completed(spark, sf):
    own = with_columns(usage(spark, sf), **_GROWN)
    return archive.completed(own.select("event", "revision_hash", "generation", "cost_rank", "reported_nanos", "duration_ms", "same", "is_turn_start", *archive._COUNTS))


def _resolved(spark, sf):
    u = usage(spark, sf)
    own = with_columns(u, identity="concat('i', event_id div 2)", confidence="event_id % 3", alias="if(event_id % 2 = 0, concat('a', event_id div 10), null)", accounting="string(event_id div 5)").select("event_id", "identity", "confidence", "alias", "accounting")
    known = with_columns(u.where("event_id < 500"), event="concat('e', event_id div 4)", identity="concat('i', event_id)", confidence="2", alias="if(event_id % 3 = 0, concat('a', event_id div 9), null)", accounting="string(event_id div 6)").select("event", "identity", "confidence", "alias", "accounting")
    return archive.resolve(own, known).select("event_id", "event", "how")


_RESOLVED_SQL = """k AS (SELECT 'e' || (event_id // 4) AS event, 'i' || event_id AS identity, 2 AS confidence, CASE WHEN event_id % 3 = 0 THEN 'a' || (event_id // 9) END AS alias, CAST(event_id // 6 AS VARCHAR) AS accounting FROM usage WHERE event_id < 500),
  f AS (SELECT event_id, 'i' || (event_id // 2) AS identity, event_id % 3 AS confidence, CASE WHEN event_id % 2 = 0 THEN 'a' || (event_id // 10) END AS alias, CAST(event_id // 5 AS VARCHAR) AS accounting FROM usage),
  bi AS (SELECT identity, min(event) AS same FROM k GROUP BY identity), ba AS (SELECT alias, min((event, accounting)) AS a FROM k WHERE alias IS NOT NULL GROUP BY alias),
  bt AS (SELECT accounting, min(event) AS twin, max(confidence) AS trust FROM k GROUP BY accounting HAVING count(DISTINCT event) = 1),
  j AS (SELECT f.*, same, a[1] AS kin, a[2] AS told, twin, trust FROM f LEFT JOIN bi USING (identity) LEFT JOIN ba USING (alias) LEFT JOIN bt USING (accounting)),
  h AS (SELECT *, CASE WHEN same IS NOT NULL THEN 'known' WHEN kin IS NOT NULL AND told = accounting THEN 'alias' WHEN kin IS NOT NULL THEN 'collision' WHEN twin IS NOT NULL AND trust <> confidence THEN 'twin' ELSE 'new' END AS how FROM j)
  SELECT event_id, CASE how WHEN 'known' THEN same WHEN 'alias' THEN kin WHEN 'twin' THEN twin ELSE identity END AS event, how FROM h"""

ZONE = "America/New_York"


def _threads(spark, sf):
    c = bridge.table(spark, sf, "customer")
    rows = c.select(F.col("c_custkey").cast("long").alias("node"), F.expr("case when c_custkey % 40 = 0 then bigint(c_custkey) when c_custkey > 20 then bigint(c_custkey div 3) end").alias("parent"), F.col("c_custkey").alias("position"))
    return hierarchy.tree_order(rows)


def _graph(spark, sf):
    """Days with their totals, their models' share and the whole's own, in one row a day."""
    p = priced(spark, sf)
    days = p.groupBy("date").agg(F.sum("cost_nanos").alias("cost_nanos"), F.sum("message_count").cast("long").alias("messages"))
    models = p.groupBy("date", "client", "model").agg(F.sum("cost_nanos").alias("c")).groupBy("date").agg(F.count(F.lit(1)).alias("models"), F.max("c").alias("dearest"))
    whole = p.agg(F.sum("cost_nanos").alias("total_nanos"), F.count_distinct("date").alias("days"))
    return days.join(models, "date").crossJoin(F.broadcast(whole))


def _borrowed(spark, sf):
    rows = spark.createDataFrame([("a", "x", 10.0, None, 1.0), ("a", None, 10.0, 20.0, 1.0), ("b", "x", 10.0, None, 1.0), ("b", None, 11.0, 20.0, 1.0), ("c", "x", 5.0, 6.0, None), ("c", None, 5.0, 6.0, 2.0)], "model string, hint string, input double, output double, cache double")
    return pricing.borrowed(rows)


CATALOGUE = [("litellm", "gpt-5.4"), ("litellm", "azure/gpt-5.4"), ("litellm", "claude-opus-4-6"), ("openrouter", "anthropic/claude-sonnet-4.5"), ("openrouter", "x-ai/grok-4"), ("models.dev", "google/gemini-3-pro-preview"), ("models.dev", "zai/glm-4.7"), ("litellm", "fireworks_ai/kimi-k2.5"), ("models.dev", "moonshotai/kimi-k2.5"), ("litellm", "auto-model")]
#: A name, its provider, and what it means: (stage, key).
MEANT = [
    ("GPT-5.4", "openai", "exact", "gpt-5.4"), ("gpt-5-4", None, "exact", "gpt-5.4"), ("gpt-5.4", "azure", "exact", "gpt-5.4"), ("azure/gpt-5.4", None, "path", "azure/gpt-5.4"),
    ("claude-opus-4.6-thinking", None, "exact", "claude-opus-4-6"), ("claude-sonnet-4-5", None, "prefix", "anthropic/claude-sonnet-4.5"), ("claude-sonnet-4-5-20250929", None, "suffix", "anthropic/claude-sonnet-4.5"),
    ("grok-4", "xai", "prefix", "x-ai/grok-4"), ("gemini-3-pro", "google", "fuzzy", "google/gemini-3-pro-preview"), ("big-pickle", None, "under", "zai/glm-4.7"), ("kimi-k2.5", None, "under", "moonshotai/kimi-k2.5"),
    ("kimi-k2.5", "fireworks_ai", "under", "fireworks_ai/kimi-k2.5"), ("auto", None, None, None), ("acme/agent_review", None, None, None), ("gpt-5.4-fast-beta", None, "fuzzy", "gpt-5.4"), ("mini", None, None, None), ("model", None, None, None), ("zzz-unknown", None, None, None), ("", None, None, None),
]


def _resolved_names(spark, sf):
    u = usage(spark, sf)
    own = pick([m for m, *_ in MEANT], u, "model").withColumn("provider", F.element_at(F.array(*(F.lit(x[1]) for x in MEANT)), (F.col("event_id") % len(MEANT) + 1).cast("int")))
    return price_lookup.with_key(own, CATALOGUE).select("event_id", "price_key")


def queries(u: str, p: str) -> dict:
    w = f"WITH {u}"
    zoned = f"strftime(timezone('{ZONE}', make_timestamptz(ts_ms // 60000 * 60000000)), '{{}}')"
    sums = "CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(cost_nanos) AS BIGINT) AS cost_nanos, CAST(sum(message_count) AS BIGINT) AS messages"
    found = {
        "copilot_tiers": (_tiers, f"{w}, {_TIERED_SQL}, bt AS (SELECT trace, min(k) AS m FROM t WHERE trace IS NOT NULL GROUP BY trace), br AS (SELECT response, min(k) AS m FROM t WHERE response IS NOT NULL GROUP BY response) SELECT event_id, ['chat', 'inference', 'agent_turn', 'agent_summary'][k + 1] AS tier FROM t LEFT JOIN bt USING (trace) LEFT JOIN br USING (response) WHERE k <= coalesce(bt.m, 9) AND k <= coalesce(br.m, 9)"),
        "copilot_merge": (_duplicates, f"""{w}, d AS (SELECT *, CAST(event_id // 3 AS VARCHAR) AS k, CASE WHEN event_id % 4 <> 0 THEN ts_ms END AS s, CASE WHEN event_id % 5 <> 0 THEN ts_ms + event_id % 1000 END AS e, CASE WHEN event_id % 3 <> 0 THEN 'a' || (event_id % 7) END AS g, event_id % 2 = 0 AS direct FROM usage),
            m AS (SELECT k, min(event_id) AS event_id, max(input) AS i, max(output) AS output, max(cache_read) AS cache_read, max(cache_write) AS cache_write, max(reasoning) AS reasoning, min(s) AS start_ms, max(e) AS end_ms, max(duration_ms) AS longest, coalesce(min(g) FILTER (direct), min(g)) AS agent, count(g) FILTER (direct) > 0 AS agent_direct FROM d GROUP BY k)
            SELECT event_id, k AS dedup_key, i - least(cache_read, i) AS input, output, cache_read, cache_write, reasoning, start_ms, end_ms, greatest(CASE WHEN end_ms > start_ms THEN end_ms - start_ms END, longest) AS duration_ms, agent, agent_direct FROM m"""),
        "lane_order": (_lanes, f"{w} SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'json' ELSE 'sqlite' END AS lane FROM usage QUALIFY row_number() OVER (PARTITION BY coalesce(dedup_key, 'none' || event_id) ORDER BY event_id % 2 = 0, event_id) = 1"),
        "derived_keys_anti": (_forms, f"{w} SELECT event_id FROM usage WHERE client = 'codex' AND date NOT IN (SELECT session_id FROM usage WHERE client = 'claude') AND (dedup_key IS NULL OR dedup_key NOT IN (SELECT dedup_key FROM usage WHERE client = 'claude' AND dedup_key IS NOT NULL))"),
        "unique_or_null": (_filled, f"{w}, e AS (SELECT *, CASE WHEN event_id % 50 = 0 THEN model END AS said FROM usage), o AS (SELECT session_id, min(said) AS one FROM e WHERE said IS NOT NULL GROUP BY session_id HAVING count(DISTINCT said) = 1) SELECT event_id, session_id, coalesce(said, one) AS said FROM e LEFT JOIN o USING (session_id)"),
        "cache_retention": (_retained, f"{w}, a AS (SELECT * FROM usage WHERE event_id >= 300) SELECT event_id, dedup_key FROM a UNION ALL SELECT event_id, dedup_key FROM usage WHERE event_id < 600 AND dedup_key IS NOT NULL AND dedup_key NOT IN (SELECT dedup_key FROM a WHERE dedup_key IS NOT NULL)"),
        "alias_fold": (lambda s, sf: usage(s, sf).select("event_id", precedence.alias_fold(F.col("model"), ALIASES).alias("model")), f"{w} SELECT event_id, CASE model WHEN 'gpt-5.4' THEN 'gpt five' WHEN 'claude-opus-4-6' THEN 'opus' ELSE model END AS model FROM usage"),
        "gateway_models": (lambda s, sf: precedence.gateway_rows(with_columns(usage(s, sf), **_GATEWAY)).select("event_id", "model", "provider"), f"{w} SELECT event_id, {literal(['model-x', 'glm-5', 'plain', 'bare', 'accounts/x/models/y'])} AS model, {literal(['synthetic', 'synthetic', 'glhf', 'acme', 'acme'])} AS provider FROM usage"),
        "version_separators": (lambda s, sf: pick(VERSIONS, usage(s, sf), "v").select("event_id", precedence.version_separators(F.col("v")).alias("v")), f"{w} SELECT event_id, {literal(_VERSIONED)} AS v FROM usage"),
        "provider_spellings": (lambda s, sf: pick(SPELLED, usage(s, sf), "p").select("event_id", names.provider_canonical(F.col("p")).alias("provider")), f"{w} SELECT event_id, {literal(_CANONICAL)} AS provider FROM usage"),
        "client_families": (lambda s, sf: pick(FAMILIES, usage(s, sf), "client").select("event_id", names.client_surface(F.col("client")).alias("client")), f"{w} SELECT event_id, {literal(['claude', 'gjc', 'codex', 'claude'])} AS client FROM usage"),
        "filter_family_rows": (lambda s, sf: filters.by_clients(pick(FAMILIES, usage(s, sf), "client"), ["claude"]).select("event_id", "client"), f"{w} SELECT event_id, c AS client FROM (SELECT event_id, {literal(FAMILIES)} AS c FROM usage) WHERE c IN ('cc-mirror/work', 'claude')"),
        "quota_drain": (lambda s, sf: rotation.quota_drain(with_columns(usage(s, sf), **{k: v.replace("'NaN'", "double('NaN')") for k, v in _WINDOWS.items()}).select(*_WINDOWS), F.lit(NOW)), f"{w}, x AS (SELECT session_id AS account, event_id % 3 = 0 AS scoped, CASE WHEN event_id % 11 = 0 THEN 0 ELSE 100 - event_id % 101 END AS remaining, CASE WHEN event_id % 13 <> 0 THEN {NOW} + (event_id % 7 - 3) * 1000 END AS r FROM usage) SELECT account, CASE WHEN count(*) = count(r) THEN max(r) END AS reset_at FROM x WHERE NOT scoped AND remaining <= 1 AND coalesce(r, {NOW}) >= {NOW} GROUP BY account"),
        "task_activity": (_tasks, f"{w}, x AS (SELECT event_id % 8 AS generation, 't' || (event_id // 2) AS thread, client AS account, ts_ms AS started_at FROM usage), y AS (SELECT *, {_STATE} AS st FROM x), c AS (SELECT thread FROM y WHERE st = 'fresh' GROUP BY thread HAVING count(DISTINCT (account, started_at)) > 1) SELECT generation, count(*) FILTER (st = 'fresh') AS tasks, min(started_at) FILTER (st = 'fresh') AS oldest, CASE WHEN bool_or(st = 'stale') THEN 'stale' WHEN bool_or(st = 'fresh' AND thread IN (SELECT thread FROM c)) THEN 'conflict' ELSE 'fresh' END AS state FROM y GROUP BY generation"),
        "route_choice": (_route, f"{w} SELECT event_id AS request, CASE WHEN event_id % 3 <> 0 THEN 'a2' WHEN event_id % 5 IN (0, 2) THEN 'a' || (event_id % 5) END AS account FROM usage"),
        "usage_limit_class": (lambda s, sf: pick(PAYLOADS, usage(s, sf), "x").select("event_id", rotation.usage_limit(F.col("x")).alias("kind")), f"{w} SELECT event_id, {literal(['structured', 'message', None, None, None])} AS kind FROM usage"),
        "plan_multiplier": (lambda s, sf: pick(PLANS, usage(s, sf), "x").select("event_id", rotation.plan_multiplier(F.col("x")).alias("times")), f"{w} SELECT event_id, {literal([20, 5, 5, None, None])} AS times FROM usage"),
        "signin_settling": (lambda s, sf: usage(s, sf).select("event_id", rotation.settling(F.col("event_id") % 2 == 0, F.when(F.col("event_id") % 7 != 0, F.col("ts_ms")), F.col("ts_ms") + F.col("event_id") % 10 * 60_000).alias("settling")), f"{w} SELECT event_id, event_id % 2 = 0 AND event_id % 7 <> 0 AND event_id % 10 <= 5 AS settling FROM usage"),
        "account_order": (lambda s, sf: rotation.account_order(usage(s, sf).select(F.col("session_id").alias("account")).distinct(), usage(s, sf).where("is_turn_start").groupBy(F.col("session_id").alias("account")).agg(F.min("event_id").alias("rank"))), f"{w}, r AS (SELECT session_id AS account, min(event_id) FILTER (is_turn_start) AS rank FROM usage GROUP BY session_id) SELECT account, rank, CAST(row_number() OVER (ORDER BY rank NULLS LAST, account) AS INTEGER) AS place FROM r"),
        "percent_remaining": (lambda s, sf: usage(s, sf).select("event_id", rotation.percent_remaining((F.col("event_id") % 150 - 20).cast("double")).alias("left")), f"{w} SELECT event_id, CASE WHEN event_id % 150 BETWEEN 20 AND 120 THEN CAST(120 - event_id % 150 AS DOUBLE) ELSE 0.0 END AS \"left\" FROM usage"),
        "archive_admission": (lambda s, sf: filters.admitted(with_columns(usage(s, sf), input="input - 40000", model="if(event_id % 6 = 0, ' ', model)")).select("event_id"), f"{w} SELECT event_id FROM usage WHERE input >= 40000 AND event_id % 6 <> 0"),
        "cost_validation": (lambda s, sf: filters.valid(with_columns(usage(s, sf), cost="case event_id % 4 when 0 then double('NaN') when 1 then double('Infinity') when 2 then -1.0 else 2.5 end")).select("event_id", "cost", "is_valid"), f"{w} SELECT event_id, CASE WHEN event_id % 4 = 3 THEN 2.5::DOUBLE ELSE 0.0::DOUBLE END AS cost, event_id % 4 = 3 AS is_valid FROM usage"),
        "many_ranges_anti": (lambda s, sf: filters.outside_ranges(usage(s, sf), [(1704067200000 + i * 7_000_000, 1704067200000 + i * 7_000_000 + 1_000_000) for i in range(400)]).select("event_id"), f"{w} SELECT event_id FROM usage WHERE NOT (ts_ms >= 1704067200000 AND ts_ms < 1704067200000 + 400 * 7000000::BIGINT AND (ts_ms - 1704067200000) % 7000000 < 1000000)"),
        "headless_tag": (lambda s, sf: filters.headless(with_columns(usage(s, sf), path="concat(if(event_id % 3 = 0, '/h/', '/o/'), event_id)", agent="if(event_id % 2 = 0, '', 'me')"), ["/h"]).select("event_id", "agent"), f"{w} SELECT event_id, CASE WHEN event_id % 2 <> 0 THEN 'me' WHEN event_id % 3 = 0 THEN 'headless' ELSE '' END AS agent FROM usage"),
        "active_buckets": (lambda s, sf: filters.active(usage(s, sf).groupBy("session_id").agg(F.sum("message_count").alias("messages"), F.count_if("is_turn_start").alias("turns"))), f"{w} SELECT session_id, CAST(sum(message_count) AS BIGINT) AS messages, count(*) FILTER (is_turn_start) AS turns FROM usage GROUP BY session_id HAVING sum(message_count) > 0 OR count(*) FILTER (is_turn_start) > 0"),
        "canonical_first_observation": (_first, f"""{w}, r AS (SELECT CAST(event_id // 6 AS VARCHAR) AS event, event_id, event_id * 7 % 5 AS g, (event_id % 3) || '' || (event_id % 2) AS h, cost_source, lpad(CAST(event_id AS VARCHAR), 9, '0') AS rh FROM usage), a AS (SELECT *, min(g) OVER (PARTITION BY event, h) AS f FROM r),
            b AS (SELECT *, row_number() OVER (PARTITION BY event ORDER BY f, h, cost_source <> 'reported', g, rh) = 1 AS selected FROM a) SELECT event, event_id, selected FROM b QUALIFY row_number() OVER (PARTITION BY event ORDER BY selected DESC, g, rh) <= 4"""),
        "canonical_streamed": (_completed, f"""{w}, g AS (SELECT CAST(event_id // 4 AS VARCHAR) AS event, event_id % 4 AS g, CASE WHEN event_id % 23 = 0 THEN 'y' ELSE 'x' END AS same, event_id % 4 + CASE WHEN event_id % 17 = 0 THEN -3 ELSE 0 END AS input, lpad(CAST(event_id AS VARCHAR), 9, '0') AS rh FROM usage), l AS (SELECT event, list(struct_pack(s := same, i := input, h := rh) ORDER BY g) AS rows FROM g GROUP BY event),
            f AS (SELECT event, list_reduce(list_transform(rows, lambda x: struct_pack(s := x.s, i := x.i, h := x.h, c := false)), lambda a, x: CASE WHEN x.s = a.s AND x.i >= a.i THEN struct_pack(s := x.s, i := x.i, h := x.h, c := a.c) ELSE struct_pack(s := a.s, i := a.i, h := a.h, c := true) END) AS z FROM l) SELECT event, z.h AS revision_hash, z.c AS conflict FROM f"""),
        "archive_resolve": (_resolved, f"{w}, {_RESOLVED_SQL}"),
        "conflict_flag": (lambda s, sf: archive.conflicts(_revisions(s, sf)), f"{w} SELECT CAST(event_id // 6 AS VARCHAR) AS event, count(DISTINCT (event_id % 3, event_id % 2)) > 1 OR count(DISTINCT CASE WHEN cost_source = 'reported' THEN event_id % 4 END) > 1 AS conflict FROM usage GROUP BY 1"),
        "capture_state": (lambda s, sf: archive.capture(usage(s, sf).where("event_id < 200").groupBy("client").agg(F.min("ts_ms").alias("first_ms"), F.max("ts_ms").alias("last_ms")), usage(s, sf)), f"{w} SELECT client, min(ts_ms) AS first_ms, max(ts_ms) AS last_ms FROM usage GROUP BY client"),
        "checkpoint_skip": (lambda s, sf: archive.not_seen(with_columns(usage(s, sf), source="session_id", revision="string(event_id % 10)").select("event_id", "source", "revision"), with_columns(usage(s, sf), source="session_id", revision="string(event_id % 7)", complete="event_id % 2 = 0").select("source", "revision", "complete")).select("event_id"), f"{w} SELECT event_id FROM usage a WHERE NOT EXISTS (SELECT 1 FROM usage b WHERE b.event_id % 2 = 0 AND b.session_id = a.session_id AND b.event_id % 7 = a.event_id % 10)"),
        "forget_and_rebuild": (lambda s, sf: archive.forget(priced(s, sf), [(1704500000000, 1705000000000)]).where("period = 0").drop("period", "bucket_ms"), f"WITH {p} SELECT {', '.join(archive.KEYS)}, {', '.join(f'CAST(sum({c}) AS BIGINT) AS {c}' for c in archive.MEASURES)}, count(*) AS events FROM priced WHERE NOT (ts_ms >= 1704500000000 AND ts_ms < 1705000000000) GROUP BY {', '.join(archive.KEYS)}"),
        "archive_counters": (lambda s, sf: archive.counters(usage(s, sf).where("event_id < 700").select(F.col("event_id").alias("fact_id")), usage(s, sf).where("event_id >= 100").select(F.col("event_id").alias("fact_id"), F.col("input").alias("tokens"), "cost_source")), f"{w}, a AS (SELECT * FROM usage WHERE event_id >= 100) SELECT count(*) AS events, CAST(sum(input) AS BIGINT) AS tokens, count(*) FILTER (cost_source = 'reported') AS reported, count(*) FILTER (event_id >= 700) AS added, (SELECT count(*) FROM usage WHERE event_id < 100 AND event_id < 700) AS removed FROM a"),
        "graph_days": (_graph, f"WITH {p}, m AS (SELECT date, client, model, sum(cost_nanos) AS c FROM priced GROUP BY ALL), n AS (SELECT date, count(*) AS models, CAST(max(c) AS BIGINT) AS dearest FROM m GROUP BY date) SELECT date, CAST(sum(cost_nanos) AS BIGINT) AS cost_nanos, CAST(sum(message_count) AS BIGINT) AS messages, any_value(models) AS models, any_value(dearest) AS dearest, (SELECT CAST(sum(cost_nanos) AS BIGINT) FROM priced) AS total_nanos, (SELECT count(DISTINCT date) FROM priced) AS days FROM priced JOIN n USING (date) GROUP BY date"),
        "trailing_costs": (lambda s, sf: series.trailing_costs(priced(s, sf)), f"WITH {p}, l AS (SELECT max(date) AS d FROM priced) SELECT CAST(coalesce(sum(cost_nanos) FILTER (date = d), 0) AS BIGINT) AS today, CAST(coalesce(sum(cost_nanos) FILTER (CAST(date AS DATE) > CAST(d AS DATE) - 7), 0) AS BIGINT) AS week FROM priced, l"),
        "series_merge": (lambda s, sf: series.merged(*(priced(s, sf).where(F.col("client") == c).groupBy(F.col("date").alias("bucket")).agg(F.sum("input").alias("tokens"), F.sum("cost_nanos").alias("cost_nanos"), F.sum("message_count").alias("messages")) for c in bridge.CLIENTS)), f"WITH {p} SELECT date AS bucket, CAST(sum(input) AS BIGINT) AS tokens, CAST(sum(cost_nanos) AS BIGINT) AS cost_nanos, CAST(sum(message_count) AS BIGINT) AS messages FROM priced GROUP BY date"),
        "chart_peak": (lambda s, sf: series.peak(priced(s, sf).groupBy("date").agg(F.sum("cost_nanos").alias("cost_nanos"))), f"WITH {p}, d AS (SELECT date, CAST(sum(cost_nanos) AS BIGINT) AS cost_nanos FROM priced GROUP BY date) SELECT date, cost_nanos, CAST(ceil(cost_nanos / pow(10, floor(log10(cost_nanos)))) * pow(10, floor(log10(cost_nanos))) AS BIGINT) AS top FROM d ORDER BY cost_nanos DESC, date LIMIT 1"),
        "snapshot_problems": (lambda s, sf: series.unordered(with_columns(usage(s, sf), bucket="date", tokens="input - 4000", cost_nanos="reported_nanos", messages="message_count", client="if(event_id % 9 = 0, '', client)").select("client", "bucket", "tokens", "cost_nanos", "messages")), f"{w}, x AS (SELECT CASE WHEN event_id % 9 = 0 THEN '' ELSE client END AS client, date, input - 4000 AS t FROM usage), a AS (SELECT 'repeated' AS problem, count(*) AS n FROM (SELECT 1 FROM x GROUP BY client, date HAVING count(*) > 1) UNION ALL SELECT 'negative', count(*) FROM x WHERE t < 0 UNION ALL SELECT 'nameless', count(*) FROM x WHERE client = '') SELECT * FROM a WHERE n > 0"),
        "top_models": (lambda s, sf: series.top_models(priced(s, sf)), f"WITH {p} SELECT model, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(cost_nanos) AS BIGINT) AS cost_nanos FROM priced GROUP BY model ORDER BY tokens DESC, model LIMIT 5"),
        "thread_tree_order": (_threads, """WITH RECURSIVE e AS (SELECT c_custkey AS node, CASE WHEN c_custkey % 40 = 0 THEN NULL WHEN c_custkey > 20 AND c_custkey // 3 > 0 THEN c_custkey // 3 END AS parent FROM customer), t AS (SELECT node, 0 AS depth, lpad(CAST(node AS VARCHAR), 12, '0') AS path FROM e WHERE parent IS NULL UNION ALL SELECT e.node, t.depth + 1, t.path || '/' || lpad(CAST(e.node AS VARCHAR), 12, '0') FROM t JOIN e ON e.parent = t.node) SELECT node, depth, path FROM t"""),
        "borrowed_rates": (_borrowed, "SELECT * FROM (VALUES ('a', 'x', 10.0::DOUBLE, 20.0::DOUBLE, 1.0::DOUBLE), ('b', 'x', 10.0::DOUBLE, NULL, 1.0::DOUBLE), ('c', 'x', 5.0::DOUBLE, 6.0::DOUBLE, 2.0::DOUBLE)) t(model, hint, input, output, cache)"),
        "hosted_surcharge": (lambda s, sf: pricing.with_surcharge(priced(s, sf).withColumn("provider", F.expr("if(event_id % 2 = 0, 'hosted', provider)")), "hosted").select("event_id", "cost_nanos"), f"WITH {p} SELECT event_id, CAST(CASE WHEN event_id % 2 = 0 AND cost_source <> 'reported' THEN cost_nanos * 11 // 10 ELSE cost_nanos END AS BIGINT) AS cost_nanos FROM priced"),
        "custom_prices": (lambda s, sf: pricing.with_custom(usage(s, sf).select("event_id", "model", "input"), {"grok-4": 7, "gpt-5.4": 9}, 1).select("event_id", "nanos"), f"{w} SELECT event_id, input * CASE model WHEN 'grok-4' THEN 7 WHEN 'gpt-5.4' THEN 9 ELSE 1 END AS nanos FROM usage"),
        "price_resolution": (_resolved_names, f"{w} SELECT event_id, {literal([k for *_, k in MEANT])} AS price_key FROM usage"),
        "cost_policies": (lambda s, sf: pricing.by_policy(with_columns(usage(s, sf), policy="element_at(array('reprice', 'fill_non_positive', 'fill_non_authoritative', 'preserve'), int(event_id % 4 + 1))", estimate="event_id"), "policy", "estimate").select("event_id", "nanos"), f"{w} SELECT event_id, CAST(CASE event_id % 4 WHEN 0 THEN event_id WHEN 1 THEN CASE WHEN reported_nanos > 0 THEN reported_nanos ELSE event_id END WHEN 2 THEN CASE WHEN cost_source = 'reported' THEN reported_nanos ELSE event_id END ELSE reported_nanos END AS BIGINT) AS nanos FROM usage"),
    }
    for step, form in (("hour", "%Y-%m-%d %H:00"), ("day", "%Y-%m-%d"), ("month", "%Y-%m")):
        found[f"zone_{step}_series"] = (lambda s, sf, step=step: series.in_zone(archive.rollup(priced(s, sf)), ZONE, step), f"WITH {p} SELECT {zoned.format(form)} AS bucket, client, {sums} FROM priced GROUP BY ALL")
    return found
