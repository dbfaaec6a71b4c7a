"""Every operator as a query over the test tables, with SQL of the same rows."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from ..functions import names
from ..operators import archive, dedup, deltas, filters, hierarchy, pricing, reports, series, sessions
from ..sources import bridge
from . import more, readers

# SQL side ------------------------------------------------------------------------------------------------------------

_MODEL = " ".join(f"WHEN '{k}' THEN '{m}'" for k, (_, m) in bridge.MODELS.items())
_PROVIDER = " ".join(f"WHEN '{k}' THEN '{p}'" for k, (p, _) in bridge.MODELS.items())
USAGE = f"""usage AS (
  SELECT event_id, ['codex','claude','opencode'][event_id % 3 + 1] AS client,
    CASE event_type {_PROVIDER} END AS provider, CASE event_type {_MODEL} END AS model,
    's' || user_id AS session_id, CASE WHEN user_id % 10 <> 0 THEN '/home/w/p' || (user_id % 10) END AS workspace,
    epoch_us(ts) // 1000 AS ts_ms, strftime(ts, '%Y-%m-%d') AS date,
    CAST(json_extract(props, '$.k') AS BIGINT) * 4000 AS input, event_id % 977 * 3 AS output, event_id % 1009 * 300 AS cache_read,
    event_id % 313 * 800 AS cache_write, event_id % 89 AS reasoning,
    CASE WHEN event_id % 11 = 0 THEN 'reported' ELSE 'estimated' END AS cost_source,
    CASE WHEN event_id % 11 = 0 THEN event_id % 1000 * 1000000 ELSE 0 END AS reported_nanos,
    CASE WHEN event_id % 5 <> 0 THEN event_id % 7 * 20000 END AS duration_ms,
    CASE WHEN event_id % 13 = 0 THEN 0 ELSE 1 END AS message_count, event_id % 4 = 0 AS is_turn_start,
    CASE WHEN event_id % 17 <> 0 THEN CAST(event_id // 2 AS VARCHAR) END AS dedup_key FROM events)"""


def _bands(tokens: str, rates: list[int], bands: tuple) -> str:
    """Marginal cost written out: each threshold adds the step of its rate for the tokens above it."""
    steps = [(t, r - (rates[i - 1] if i else 0)) for i, (t, r) in enumerate(zip(bands, rates, strict=True))]
    return "(" + " + ".join(f"greatest({tokens} - {t}, 0) * ({d})" for t, d in steps) + ")"


def _filled(rates: tuple) -> list[int]:
    out, last = [], 0
    for r in rates:
        last = last if r is None else r
        out.append(last)
    return out


def _price(model: str) -> str:
    i, o, r, w = pricing.CATALOGUE[model]
    if model in pricing.WHOLE_REQUEST:
        scaled = f"(cache_write * {w[0] * _filled(i)[-1]}) // {i[0]}"
        high = f"input * {_filled(i)[-1]} + (output + reasoning) * {_filled(o)[-1]} + cache_read * {_filled(r)[-1]} + {scaled}"
        low = f"input * {i[0]} + (output + reasoning) * {o[0]} + cache_read * {r[0]} + cache_write * {w[0]}"
        return f"CASE WHEN input + cache_read + cache_write > 272000 THEN {high} ELSE {low} END"
    return " + ".join(_bands(t, _filled(x), b) for t, x, b in (("input", i, pricing.INPUT_BANDS), ("(output + reasoning)", o, pricing.INPUT_BANDS), ("cache_read", r, pricing.READ_BANDS), ("cache_write", w, pricing.WRITE_BANDS)))


def _covers(model: str) -> str:
    need = [t for t, x in zip(("input", "output + reasoning", "cache_read", "cache_write"), pricing.CATALOGUE[model], strict=True) if x[0] is None]
    return " AND ".join(f"{t} = 0" for t in need) or "true"


PRICED = f"""{USAGE}, estimated AS (SELECT *, CASE model {" ".join(f"WHEN '{m}' THEN {_price(m)}" for m in pricing.CATALOGUE)} ELSE 0 END AS estimate,
    CASE model {" ".join(f"WHEN '{m}' THEN {_covers(m)}" for m in pricing.CATALOGUE)} ELSE false END AS has_price FROM usage),
  priced AS (SELECT * EXCLUDE (estimate, has_price), CAST(CASE WHEN cost_source = 'reported' THEN reported_nanos ELSE estimate END AS BIGINT) AS cost_nanos,
    cost_source = 'reported' OR has_price AS is_covered, input + output + cache_read + cache_write + reasoning AS tokens FROM estimated)"""

_SUMS = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in reports.BUCKETS) + ", CAST(sum(cost_nanos) AS BIGINT) AS cost_nanos, CAST(sum(message_count) AS BIGINT) AS messages"
_LIST = "array_to_string(list_sort(list_distinct(list({0}))), ', ') AS {1}"
_TURNS = "count(*) FILTER (is_turn_start) AS turns"
_TIMED = "coalesce(duration_ms, 0) > 0 AND tokens > 0"

INTERVALS = f"""{USAGE}, spans AS (SELECT *, ts_ms + greatest(coalesce(duration_ms, 0), 0) AS e FROM usage WHERE ts_ms > 0),
  marked AS (SELECT *, CASE WHEN ts_ms <= max(e) OVER (PARTITION BY client, session_id ORDER BY ts_ms, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 180000 THEN 0 ELSE 1 END AS fresh FROM spans),
  numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY client, session_id ORDER BY ts_ms, e ROWS UNBOUNDED PRECEDING) AS block FROM marked),
  intervals AS (SELECT client, session_id, min(ts_ms) AS start_ms, max(e) AS end_ms, max(e) - min(ts_ms) AS wall_ms, CAST(sum(message_count) AS BIGINT) AS messages,
    CAST(sum(input + output + cache_read + cache_write + reasoning) AS BIGINT) AS tokens FROM numbered GROUP BY client, session_id, block)"""

# Spark side ----------------------------------------------------------------------------------------------------------

usage = bridge.usage_from_events


def priced(spark, sf_dir):
    return pricing.priced(usage(spark, sf_dir))


def intervals(spark, sf_dir):
    return sessions.sessionize(usage(spark, sf_dir))


def over(rows, f, *args, **options):
    return lambda spark, sf_dir: f(rows(spark, sf_dir), *args, **options)


QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def add(name: str, query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLES[name] = sql


def _brief(rows):
    return rows.select("event_id", "client", "model", "date", "input")


_B = "event_id, client, model, date, input"
RANGES = [(1704500000000, 1704600000000), (1705000000000, 1705500000000), (1705400000000, 1705600000000)]

add("filter_year", over(usage, lambda u: _brief(filters.by_date(u, year="2024"))), f"WITH {USAGE} SELECT {_B} FROM usage WHERE date LIKE '2024-%'")
add("filter_since_until", over(usage, lambda u: _brief(filters.by_date(u, since="2024-01-10", until="2024-01-12"))), f"WITH {USAGE} SELECT {_B} FROM usage WHERE date BETWEEN '2024-01-10' AND '2024-01-12'")
add("filter_clients_family", over(usage, lambda u: _brief(filters.by_clients(u, ["claude", "codex"]))), f"WITH {USAGE} SELECT {_B} FROM usage WHERE client IN ('claude', 'codex')")
add("forgotten_ranges_anti", over(usage, lambda u: _brief(filters.outside_ranges(u, RANGES))), f"WITH {USAGE}, r(a, b) AS (VALUES {', '.join(map(str, RANGES))}) SELECT {_B} FROM usage WHERE NOT EXISTS (SELECT 1 FROM r WHERE ts_ms >= a AND ts_ms < b)")
add("ingress_validation", over(usage, lambda u: filters.valid(u.withColumn("input", F.col("input") - 100_000)).select("event_id", "input", "is_valid")), f"WITH {USAGE} SELECT event_id, greatest(input - 100000, 0) AS input, input >= 100000 AS is_valid FROM usage")

add("daily_usage", over(priced, reports.daily), f"WITH {PRICED} SELECT date, {_SUMS}, {_TURNS}, {_LIST.format('client', 'clients')}, {_LIST.format('model', 'models')} FROM priced GROUP BY date")
add("daily_client_model", over(priced, reports.daily_client_model), f"WITH {PRICED} SELECT date, client, model, {_SUMS}, {_LIST.format('provider', 'providers')} FROM priced GROUP BY ALL")
add("hourly_usage", over(priced, reports.hourly), f"WITH {PRICED} SELECT strftime(make_timestamp(ts_ms * 1000), '%Y-%m-%d %H:00') AS hour, {_SUMS}, {_TURNS}, {_LIST.format('client', 'clients')}, {_LIST.format('model', 'models')} FROM priced GROUP BY hour")
add("monthly_usage", over(priced, reports.monthly), f"WITH {PRICED} SELECT substr(date, 1, 7) AS month, {_SUMS}, {_LIST.format('model', 'models')} FROM priced GROUP BY month")
for _group, _keys in reports.GROUPS.items():
    add(
        f"model_usage_{_group}",
        over(priced, reports.by_model, _group),
        f"WITH {PRICED} SELECT {', '.join(_keys)}, {_SUMS}, {_LIST.format('provider', 'providers')}, CAST(coalesce(sum(duration_ms) FILTER ({_TIMED}), 0) AS BIGINT) AS timed_ms, CAST(coalesce(sum(tokens) FILTER ({_TIMED}), 0) AS BIGINT) AS timed_tokens,"
        f" CASE WHEN sum(tokens) FILTER ({_TIMED}) > 0 THEN CAST(sum(duration_ms) FILTER ({_TIMED}) AS DOUBLE) * 1000.0::DOUBLE / CAST(sum(tokens) FILTER ({_TIMED}) AS DOUBLE) END AS ms_per_1k FROM priced GROUP BY {', '.join(_keys)}",
    )
add("session_usage", over(priced, reports.sessions), f"WITH {PRICED} SELECT session_id, {_SUMS}, min(ts_ms // 1000) AS first_seen, max(ts_ms // 1000) AS last_seen, {_LIST.format('client', 'clients')} FROM priced GROUP BY session_id")
add("session_top_client", over(priced, reports.session_top), f"WITH {PRICED}, g AS (SELECT session_id, client, provider, model, CAST(sum(cost_nanos) AS BIGINT) AS cost_nanos FROM priced GROUP BY ALL) SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY cost_nanos DESC, client, provider, model) = 1")
add("year_summary", over(priced, reports.years), f"WITH {PRICED} SELECT substr(date, 1, 4) AS year, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(cost_nanos) AS BIGINT) AS cost_nanos, min(date) AS first_date, max(date) AS last_date FROM priced GROUP BY year")
add(
    "data_summary",
    over(priced, reports.summary),
    f"WITH {PRICED}, d AS (SELECT date, sum(tokens) AS t, sum(cost_nanos) AS c, sum(message_count) AS m FROM priced GROUP BY date) SELECT CAST(sum(t) AS BIGINT) AS tokens, CAST(sum(c) AS BIGINT) AS cost_nanos, count(*) FILTER (t > 0 OR c > 0 OR m > 0) AS active_days,"
    f" CAST(max(c) AS BIGINT) AS max_day_nanos, CAST(sum(c) AS DOUBLE) / count(*) FILTER (t > 0 OR c > 0 OR m > 0) AS mean_nanos, (SELECT {_LIST.format('client', 'x')} FROM priced) AS clients, (SELECT {_LIST.format('model', 'x')} FROM priced) AS models FROM d",
)
add(
    "daily_intensity",
    over(priced, reports.intensity),
    f"WITH {PRICED}, d AS (SELECT date, CAST(sum(cost_nanos) AS BIGINT) AS cost_nanos FROM priced GROUP BY date) SELECT *, CAST(CASE WHEN cost_nanos * 4 >= 3 * max(cost_nanos) OVER () THEN 4 WHEN cost_nanos * 2 >= max(cost_nanos) OVER () THEN 3 WHEN cost_nanos * 4 >= max(cost_nanos) OVER () THEN 2 WHEN cost_nanos > 0 THEN 1 ELSE 0 END AS INTEGER) AS intensity FROM d",
)
add("model_performance", over(priced, reports.performance), f"WITH {PRICED} SELECT model, count(*) FILTER ({_TIMED}) AS timed, least(1.0::DOUBLE, CAST(count(*) FILTER ({_TIMED}) AS DOUBLE) / count(*)) AS coverage, CAST(sum(duration_ms) FILTER ({_TIMED}) AS DOUBLE) * 1000.0::DOUBLE / CAST(sum(tokens) FILTER ({_TIMED}) AS DOUBLE) AS ms_per_1k FROM priced GROUP BY model")
add(
    "cost_coverage",
    over(priced, reports.coverage),
    f"WITH {PRICED}, x AS (SELECT *, is_covered OR tokens = 0 AS ok FROM priced) SELECT client, CAST(coalesce(sum(tokens) FILTER (ok), 0) AS BIGINT) AS covered_tokens, CAST(coalesce(sum(tokens) FILTER (NOT ok), 0) AS BIGINT) AS uncovered_tokens, CAST(coalesce(sum(message_count) FILTER (ok), 0) AS BIGINT) AS covered_messages, CAST(coalesce(sum(message_count) FILTER (NOT ok), 0) AS BIGINT) AS uncovered_messages FROM x GROUP BY client",
)
add("sorted_page", over(priced, lambda p: reports.page(reports.by_model(p, "session_model").select("session_id", "model", "cost_nanos", F.concat("session_id", "model").alias("tie")), "cost_nanos", True, "tie")), f"WITH {PRICED} SELECT session_id, model, CAST(sum(cost_nanos) AS BIGINT) AS cost_nanos, session_id || model AS tie FROM priced GROUP BY session_id, model ORDER BY cost_nanos DESC, tie DESC LIMIT 10")
add("turn_counts", over(usage, lambda u: u.groupBy("client", "session_id").agg(F.count_if("is_turn_start").alias("turns"))), f"WITH {USAGE} SELECT client, session_id, {_TURNS} FROM usage GROUP BY ALL")

add("sessionize", intervals, f"WITH {INTERVALS} SELECT * FROM intervals")
add("time_metrics", over(intervals, sessions.time_totals), f"WITH {INTERVALS} SELECT CAST(sum(wall_ms) AS BIGINT) AS wall_ms, CAST(count(*) FILTER (messages > 0) + (SELECT count(*) FROM (SELECT client, session_id FROM intervals GROUP BY ALL HAVING max(messages) = 0)) AS BIGINT) AS sessions FROM intervals")
add(
    "longest_continuous",
    over(intervals, sessions.longest_run),
    f"WITH {INTERVALS}, w AS (SELECT start_ms AS s, end_ms AS e FROM intervals WHERE wall_ms > 0), m AS (SELECT *, CASE WHEN s <= max(e) OVER (ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 180000 THEN 0 ELSE 1 END AS f FROM w), n AS (SELECT *, sum(f) OVER (ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM m) SELECT max(x) AS longest_ms FROM (SELECT max(e) - min(s) AS x FROM n GROUP BY g)",
)
add(
    "max_concurrent_sessions",
    over(intervals, sessions.max_concurrent),
    f"WITH {INTERVALS}, m AS (SELECT start_ms AS t, 1 AS d FROM intervals UNION ALL SELECT greatest(end_ms, start_ms + 1), -1 FROM intervals) SELECT CAST(max(c) AS BIGINT) AS max_concurrent FROM (SELECT sum(d) OVER (ORDER BY t, d DESC ROWS UNBOUNDED PRECEDING) AS c FROM m)",
)
add(
    "daily_active_time",
    over(intervals, sessions.daily_active),
    f"WITH {INTERVALS}, d AS (SELECT start_ms, end_ms, unnest(generate_series(start_ms // 86400000, end_ms // 86400000)) AS k FROM intervals WHERE wall_ms > 0) SELECT strftime(make_timestamp(k * 86400000000), '%Y-%m-%d') AS date, CAST(sum(least(end_ms, (k + 1) * 86400000) - greatest(start_ms, k * 86400000)) AS BIGINT) AS active_ms FROM d WHERE least(end_ms, (k + 1) * 86400000) > greatest(start_ms, k * 86400000) GROUP BY k",
)

_BAND_SQL = ", ".join(f"greatest(least(input, {h or 'input'}) - {t}, 0) AS band_{t}" for t, h in zip(pricing.INPUT_BANDS, (*pricing.INPUT_BANDS[1:], None), strict=True))
add("tier_bands", over(usage, lambda u: u.select("event_id", *(pricing.band(F.col("input"), t, h).alias(f"band_{t}") for t, h in zip(pricing.INPUT_BANDS, (*pricing.INPUT_BANDS[1:], None), strict=True)))), f"WITH {USAGE} SELECT event_id, {_BAND_SQL} FROM usage")
add("rate_ladder", lambda spark, _: pricing.prices(spark).select("priced_model", *(r.alias(f"rate_{t}") for t, r in zip(pricing.INPUT_BANDS, pricing.ladder("input", pricing.INPUT_BANDS), strict=True))), "SELECT * FROM (VALUES " + ", ".join(f"('{m}', " + ", ".join(f"CAST({x} AS BIGINT)" for x in _filled(r[0])) + ")" for m, r in pricing.CATALOGUE.items()) + ") t(priced_model, " + ", ".join(f"rate_{t}" for t in pricing.INPUT_BANDS) + ")")
add("message_cost", over(priced, lambda p: p.select("event_id", "model", "cost_nanos")), f"WITH {PRICED} SELECT event_id, model, cost_nanos FROM priced")
add("long_context_cost", over(priced, lambda p: p.where("model = 'gpt-5.4' and input + cache_read + cache_write > 272000").select("event_id", "cost_nanos")), f"WITH {PRICED} SELECT event_id, cost_nanos FROM priced WHERE model = 'gpt-5.4' AND input + cache_read + cache_write > 272000")
add("coverage_check", over(priced, lambda p: p.select("event_id", "is_covered")), f"WITH {PRICED} SELECT event_id, is_covered FROM priced")
add("unpriced_exclusions", over(usage, pricing.exclusions), f"WITH {PRICED} SELECT provider, model, CAST(sum(message_count) AS BIGINT) AS messages, CAST(sum(tokens) AS BIGINT) AS tokens, max(CASE WHEN model IN ({', '.join(map(repr, pricing.CATALOGUE))}) THEN 'missing rate' ELSE 'unknown model' END) AS reason FROM priced WHERE NOT is_covered GROUP BY provider, model")

add("first_wins", over(usage, lambda u: _brief(dedup.first_wins(u))), f"WITH {USAGE} SELECT {_B} FROM usage WHERE dedup_key IS NULL UNION ALL SELECT {_B} FROM (SELECT * FROM usage WHERE dedup_key IS NOT NULL QUALIFY row_number() OVER (PARTITION BY dedup_key ORDER BY event_id) = 1)")
add("latest_per_session", over(usage, lambda u: _brief(dedup.latest(u))), f"WITH {USAGE} SELECT {_B} FROM usage QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY ts_ms DESC, dedup_key DESC NULLS LAST, event_id DESC) = 1")
add("max_merge", over(usage, lambda u: dedup.max_merge(u).select("dedup_key", "event_id", "input", "output", "cache_read", "duration_ms")), f"WITH {USAGE} SELECT dedup_key, min(event_id) AS event_id, max(input) AS input, max(output) AS output, max(cache_read) AS cache_read, max(duration_ms) AS duration_ms FROM usage GROUP BY dedup_key, CASE WHEN dedup_key IS NULL THEN event_id END")
add("authoritative_cost_fill", over(usage, lambda u: dedup.reported_cost_wins(u).select("event_id", "cost_source", "reported_nanos")), f"WITH {USAGE}, b AS (SELECT *, min(event_id) FILTER (cost_source = 'reported') OVER (PARTITION BY k) AS r, row_number() OVER (PARTITION BY k ORDER BY event_id) AS n FROM (SELECT *, coalesce(dedup_key, 'none' || event_id) AS k FROM usage)) SELECT event_id, CASE WHEN r IS NULL THEN cost_source ELSE 'reported' END AS cost_source, coalesce(r % 1000 * 1000000, reported_nanos) AS reported_nanos FROM b WHERE n = 1")
add("session_anti_join", over(usage, lambda u: _brief(dedup.not_covered_by(u.where("client = 'codex'"), u.where("client = 'claude' and date >= '2024-01-29'"), "session_id"))), f"WITH {USAGE} SELECT {_B} FROM usage WHERE client = 'codex' AND session_id NOT IN (SELECT session_id FROM usage WHERE client = 'claude' AND date >= '2024-01-29')")
add("multiset_anti", over(usage, lambda u: _brief(dedup.multiset_anti(u.where("client = 'codex'"), u.where("client = 'claude'"), ["session_id", "date"]))), f"WITH {USAGE}, n AS (SELECT *, row_number() OVER (PARTITION BY session_id, date ORDER BY event_id) AS n FROM usage WHERE client = 'codex') SELECT {_B} FROM n WHERE n > (SELECT count(*) FROM usage u WHERE u.client = 'claude' AND u.session_id = n.session_id AND u.date = n.date)")
add("tolerance_match", over(usage, lambda u: dedup.within_tolerance(u.where("client = 'codex'"), u.where("client = 'claude'"), ["model"], 5000)), f"WITH {USAGE} SELECT a.event_id AS left_id, b.event_id AS right_id, abs(a.ts_ms - b.ts_ms) AS apart FROM usage a JOIN usage b ON a.model = b.model AND abs(a.ts_ms - b.ts_ms) <= 5000 WHERE a.client = 'codex' AND b.client = 'claude'")

_W = "PARTITION BY session_id ORDER BY ts_ms, event_id"
add("cumulative_delta", over(usage, lambda u: deltas.cumulative_delta(u, "input", ["session_id"]).select("event_id", "delta")), f"WITH {USAGE}, l AS (SELECT event_id, input, lag(input) OVER ({_W}) AS b FROM usage) SELECT event_id, CASE WHEN b IS NULL OR input < b THEN input ELSE input - b END AS delta FROM l")
add("monotone_watermark_delta", over(usage, lambda u: deltas.watermark_delta(u, "input", ["session_id"]).select("event_id", "delta")), f"WITH {USAGE} SELECT event_id, greatest(input - coalesce(max(input) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) AS delta FROM usage")
add("forward_fill_model", over(usage, lambda u: deltas.forward_fill(u.withColumn("m", F.when(F.col("event_id") % 3 == 0, F.col("model"))), "m", ["session_id"]).select("event_id", "m_filled")), f"WITH {USAGE} SELECT event_id, last_value(CASE WHEN event_id % 3 = 0 THEN model END IGNORE NULLS) OVER ({_W} ROWS UNBOUNDED PRECEDING) AS m_filled FROM usage")
add("occurrence_number", over(usage, lambda u: deltas.occurrence(u, ["session_id", "date"]).select("event_id", "occurrence")), f"WITH {USAGE} SELECT event_id, CAST(row_number() OVER (PARTITION BY session_id, date ORDER BY event_id) - 1 AS INTEGER) AS occurrence FROM usage")
add("duration_since_previous", over(usage, lambda u: deltas.since_previous(u, ["session_id"]).select("event_id", "since_ms")), f"WITH {USAGE} SELECT event_id, greatest(coalesce(ts_ms - lag(ts_ms) OVER ({_W}), 0), 0) AS since_ms FROM usage")

for _name, _step, _n in (("minutes_60_zero_fill", series.MINUTE, 60), ("days_30_zero_fill", series.DAY, 30), ("hours_24_zero_fill", 60 * series.MINUTE, 24)):
    add(_name, over(priced, series.trailing, _step, _n), f"WITH {PRICED}, l AS (SELECT max(ts_ms) // {_step} AS b FROM priced), k AS (SELECT unnest(generate_series(b - {_n - 1}, b)) AS k FROM l) SELECT k * {_step} AS bucket_ms, CAST(coalesce(sum(tokens), 0) AS BIGINT) AS tokens, CAST(coalesce(sum(cost_nanos), 0) AS BIGINT) AS cost_nanos, CAST(coalesce(sum(message_count), 0) AS BIGINT) AS messages FROM k LEFT JOIN priced ON ts_ms // {_step} = k GROUP BY k")
add("weekly_all_time", over(priced, series.weekly), f"WITH {PRICED} SELECT strftime(date_trunc('week', CAST(date AS DATE)), '%Y-%m-%d') AS week, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(cost_nanos) AS BIGINT) AS cost_nanos FROM priced GROUP BY week")
add("week_to_date", over(priced, series.to_date, "week"), f"WITH {PRICED} SELECT CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(cost_nanos) AS BIGINT) AS cost_nanos, CAST(sum(message_count) AS BIGINT) AS messages FROM priced WHERE CAST(date AS DATE) >= (SELECT date_trunc('week', max(CAST(date AS DATE))) FROM priced)")
add("trailing_months", over(priced, series.months_back), f"WITH {PRICED} SELECT substr(date, 1, 7) AS month, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(cost_nanos) AS BIGINT) AS cost_nanos FROM priced WHERE CAST(date AS DATE) >= (SELECT date_trunc('month', max(CAST(date AS DATE))) - INTERVAL 2 MONTH FROM priced) GROUP BY month")
add("period_models", over(priced, series.models_of_last), f"WITH {PRICED} SELECT model, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(cost_nanos) AS BIGINT) AS cost_nanos FROM priced WHERE ts_ms > (SELECT max(ts_ms) FROM priced) - 3600000 GROUP BY model HAVING sum(tokens) > 0")


def _hash(*parts: str) -> str:
    return "sha256(" + " || ".join(f"lpad(upper(printf('%x', octet_length(encode(coalesce(CAST({p} AS VARCHAR), ''))))), 16, '0') || coalesce(CAST({p} AS VARCHAR), '')" for p in parts) + ")"


_FACTS = ("client", "provider", "model", "session_id", "ts_ms", "input", "output", "cache_read", "cache_write", "reasoning")
_KEYS = ", ".join(archive.KEYS)
_ROLL = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in archive.MEASURES)


def _rollup_sql(rows: str) -> str:
    return f"SELECT 1 AS period, ts_ms // 60000 * 60000 AS bucket_ms, {_KEYS}, {_ROLL}, count(*) AS events FROM {rows} GROUP BY ALL UNION ALL SELECT 0, CAST(0 AS BIGINT), {_KEYS}, {_ROLL}, count(*) FROM {rows} GROUP BY ALL"


def _signed(spark, sf_dir):
    whole = priced(spark, sf_dir)
    before = whole.where("event_id % 10 = 3")
    after = before.where("event_id % 20 = 3").withColumn("output", F.col("output") + 7)
    return archive.apply_changes(archive.rollup(whole), before, after)


add("identity_hash", over(usage, lambda u: archive.identify(u).select("event_id", "fact_id")), f"WITH {USAGE} SELECT event_id, CASE WHEN dedup_key IS NOT NULL THEN {_hash(chr(39) + 'key' + chr(39), 'client', 'dedup_key')} ELSE {_hash(*_FACTS)} END AS fact_id FROM usage")
add("canonical_revision", over(usage, lambda u: archive.canonical(u, 1).select("event_id", "client", "dedup_key")), f"WITH {USAGE} SELECT event_id, client, dedup_key FROM usage QUALIFY row_number() OVER (PARTITION BY client, dedup_key, CASE WHEN dedup_key IS NULL THEN event_id END ORDER BY cost_source = 'reported' DESC, event_id) = 1")
add("rollup_minutes", over(priced, archive.rollup), f"WITH {PRICED} {_rollup_sql('priced')}")
add("rollup_signed_delta", _signed, f"WITH {PRICED}, changed AS (SELECT * REPLACE (CASE WHEN event_id % 20 = 3 THEN output + 7 ELSE output END AS output) FROM priced WHERE event_id % 10 <> 3 OR event_id % 20 = 3) {_rollup_sql('changed')}")
add(
    "rollup_equals_events",
    over(priced, lambda p: archive.rollup(p).where("period = 1").groupBy("client", "model").agg(F.sum("input").alias("input"), F.sum("cost_nanos").alias("cost_nanos"), F.sum("events").alias("events"))),
    f"WITH {PRICED} SELECT client, model, CAST(sum(input) AS BIGINT) AS input, CAST(sum(cost_nanos) AS BIGINT) AS cost_nanos, count(*) AS events FROM priced GROUP BY client, model",
)
add("replay_merge", over(usage, lambda u: archive.merge(archive.identify(u.where("event_id % 3 < 2")), archive.identify(u.where("event_id % 3 = 1"))).groupBy("client").agg(F.count(F.lit(1)).alias("n"))), f"WITH {USAGE}, k AS (SELECT *, CASE WHEN dedup_key IS NULL THEN 'e' || event_id ELSE client || dedup_key END AS id FROM usage), f AS (SELECT * FROM k WHERE event_id % 3 = 1 QUALIFY row_number() OVER (PARTITION BY id ORDER BY event_id DESC) = 1) SELECT client, count(*) AS n FROM (SELECT client FROM k WHERE event_id % 3 < 2 AND id NOT IN (SELECT id FROM f) UNION ALL SELECT client FROM f) GROUP BY client")


REPLAYED_FROM = "2024-01-20"


def _replayed(u):
    """The whole table, with the rows of its last days, of all clients, read again with a message more."""
    again = u.where(F.col("date") >= REPLAYED_FROM).withColumn("message_count", F.col("message_count") + 1)
    return archive.merge(archive.identify(u), archive.identify(again)).select("fact_id", "event_id", "client", "model", "date", "output", "message_count")


_FACT_ID = f"CASE WHEN dedup_key IS NOT NULL THEN {_hash(chr(39) + 'key' + chr(39), 'client', 'dedup_key')} ELSE {_hash(*_FACTS)} END"
_R = "fact_id, event_id, client, model, date, output"
add(
    "replay_merge_rows",
    over(usage, _replayed),
    f"WITH {USAGE}, k AS (SELECT *, {_FACT_ID} AS fact_id FROM usage), f AS (SELECT * FROM k WHERE date >= '{REPLAYED_FROM}' QUALIFY row_number() OVER (PARTITION BY fact_id ORDER BY event_id DESC) = 1) SELECT {_R}, message_count FROM k WHERE fact_id NOT IN (SELECT fact_id FROM f) UNION ALL SELECT {_R}, message_count + 1 FROM f",
)


def _tree(spark, sf_dir):
    c = bridge.table(spark, sf_dir, "customer")
    edges = c.select(F.col("c_custkey").alias("node"), F.when(F.col("c_custkey") > 10, F.expr("c_custkey div 3")).alias("parent"))
    return hierarchy.descendants(spark, edges)


add("session_tree_recursive", _tree, "WITH RECURSIVE e AS (SELECT c_custkey AS node, CASE WHEN c_custkey > 10 THEN c_custkey // 3 END AS parent FROM customer), t AS (SELECT node AS root, node, 0 AS depth FROM e WHERE parent IS NULL UNION ALL SELECT t.root, e.node, t.depth + 1 FROM t JOIN e ON e.parent = t.node) SELECT * FROM t")
add("proportional_day_allocation", over(usage, hierarchy.deal_over_days, "reported_nanos"), f"WITH {USAGE}, d AS (SELECT session_id, date, count(*) AS n, max(reported_nanos) AS t FROM usage GROUP BY ALL), s AS (SELECT *, max(t) OVER w AS whole, CAST(floor(CAST(max(t) OVER w * n AS DOUBLE) / sum(n) OVER w) AS BIGINT) AS share, row_number() OVER (PARTITION BY session_id ORDER BY date DESC) AS r FROM d WINDOW w AS (PARTITION BY session_id)) SELECT session_id, date, CAST(CASE WHEN r = 1 THEN greatest(whole - (sum(CASE WHEN r > 1 THEN share ELSE 0 END) OVER (PARTITION BY session_id)), 0) ELSE share END AS BIGINT) AS share FROM s")

SPELLINGS = ["Claude-Opus-4.6", "anthropic/claude-4-5-sonnet", "gpt-5.4(high)", "gemini-3-pro-20260101", "Grok-4", "ollama/llama3", "o3-mini", "kimi-k2"]


def _spelled(u):
    raw = F.element_at(F.array(*map(F.lit, SPELLINGS)), (F.col("event_id") % len(SPELLINGS) + 1).cast("int"))
    own = u.withColumn("raw", raw)
    return own.select("event_id", names.model_normalize(F.col("raw")).alias("model"), names.provider_infer(F.col("raw")).alias("provider"), names.workspace_label(F.col("workspace")).alias("label"), names.fmt_tokens(F.col("input")).alias("tokens"), names.estimate_tokens(F.col("raw")).alias("guess"))


_NORMAL = ["claude-opus-4-6", "claude-sonnet-4-5", "gpt-5.4", "gemini-3-pro", "grok-4", "ollama/llama3", "o3-mini", "kimi-k2"]
_INFERRED = ["anthropic", "anthropic", "openai", "google", "xai", "meta", "openai", "moonshotai"]
add(
    "names_and_labels",
    over(usage, _spelled),
    f"WITH {USAGE} SELECT event_id, {_NORMAL}[event_id % 8 + 1] AS model, {_INFERRED}[event_id % 8 + 1] AS provider, split_part(workspace, '/', 4) AS label, CASE WHEN input >= 1000 THEN printf('%.1f', input / 1000.0) || 'k' ELSE CAST(input AS VARCHAR) END AS tokens, CAST(ceil(length({SPELLINGS}[event_id % 8 + 1]) / 4.0) AS BIGINT) AS guess FROM usage",
)
add("provider_canonical", over(usage, lambda u: u.select("event_id", names.provider_canonical(F.concat(F.lit(" /"), F.upper("provider"), F.lit("/ "))).alias("provider"))), f"WITH {USAGE} SELECT event_id, provider FROM usage")
add("cost_per_million", over(priced, lambda p: p.select("event_id", names.cost_per_million(F.col("cost_nanos") / 1e9, F.col("input")).alias("rate"))), f"WITH {PRICED} SELECT event_id, CASE WHEN input > 0 THEN CAST(cost_nanos AS DOUBLE) / 1e9 * 1e6 / input END AS rate FROM priced")
add("first_user_message", lambda spark, sf: bridge.table(spark, sf, "conversations").where("role = 'user'").groupBy("conv_id").agg(names.shortened(F.min_by("text", "turn"), 100).alias("first")), "SELECT conv_id, CASE WHEN length(t) > 100 THEN substr(t, 1, 100) || '...' ELSE t END AS first FROM (SELECT conv_id, arg_min(text, turn) AS t FROM conversations WHERE role = 'user' GROUP BY conv_id)")


def _stream(which, spark, sf_dir):
    """The stream over what is there now, open windows included, into a table in a folder of its own."""
    import tempfile
    import uuid

    from ..streaming import usage as live

    folder = f"{spark.conf.get('spark.checkpoint.dir', None) or tempfile.mkdtemp(prefix='tallyspark-')}/stream-{uuid.uuid4().hex}"
    schema = bridge.table(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    out = {"sessions": live.session_windows, "minutes": live.minute_counts}[which](events, late=None)
    live.drain_whole(out, f"{folder}/out", f"{folder}/checkpoint")
    return spark.read.schema(out.schema).parquet(f"{folder}/out")


add("stream_session_window", partial(_stream, "sessions"))
add("stream_minute_rollup", partial(_stream, "minutes"))

for _name, _query in readers.queries(USAGE)[0].items():
    add(_name, _query, readers.queries(USAGE)[1][_name])

for _name, (_query, _sql) in more.queries(USAGE, PRICED).items():
    add(_name, _query, _sql)
