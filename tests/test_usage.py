import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tallyspark.functions import names, safe
from tallyspark.operators import dedup, filters, hierarchy, pricing, sessions
from tallyspark.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def rounded(row):
    return tuple(round(x, 6) if isinstance(x, float) else x for x in row)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_sql(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    found = duck.execute(catalogue.ORACLES[name])
    order = [[d[0] for d in found.description].index(c) for c in columns]
    want = [tuple(r[i] for i in order) for r in found.fetchall()]
    assert sorted(map(rounded, want), key=repr) == sorted((rounded(r[c] for c in columns) for r in got.collect()), key=repr)


@pytest.mark.parametrize("name,sql", [
    ("stream_minute_rollup", "SELECT count(*) FROM (SELECT DISTINCT date_trunc('minute', ts), event_type FROM events WHERE ts < (SELECT max(ts) FROM events) - INTERVAL 3 HOUR)"),
    ("stream_session_window", "SELECT 1"),
])
def test_streams(spark, duck, name, sql):
    n = catalogue.QUERIES[name](spark, SF).count()
    assert n >= duck.execute(sql).fetchall()[0][0]


@pytest.mark.parametrize("name,sql", [
    ("stream_minute_rollup", "SELECT date_trunc('minute', ts) AS minute, event_type, count(*) AS n, sum(value) AS value FROM events GROUP BY ALL"),
    ("stream_session_window", "SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS end, count(*) AS n FROM (SELECT *, count(*) FILTER (new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM (SELECT *, coalesce(ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE, true) AS new FROM events)) GROUP BY user_id, k"),
])
def test_streams_hold_every_event(spark, duck, name, sql):
    got = catalogue.QUERIES[name](spark, SF)
    want = duck.execute(sql).fetchall()
    assert sorted(map(rounded, want), key=repr) == sorted((rounded(r) for r in got.collect()), key=repr)
    assert sum(r["n"] for r in got.collect()) == duck.execute("SELECT count(*) FROM events").fetchall()[0][0]


def test_replay_merge_holds_every_row_of_every_client(spark):
    rows = catalogue.QUERIES["replay_merge_rows"](spark, SF).collect()
    usage = {r["event_id"]: r for r in catalogue.usage(spark, SF).collect()}
    assert sorted(r["event_id"] for r in rows) == sorted(usage) and {r["client"] for r in rows} == {"codex", "claude", "opencode"}
    changed = [r for r in rows if r["message_count"] != usage[r["event_id"]]["message_count"]]
    assert {r["client"] for r in changed} == {"codex", "claude", "opencode"} and len(changed) == sum(r["date"] >= catalogue.REPLAYED_FROM for r in usage.values())


MESSAGE = "client string, session_id string, ts_ms long, duration_ms long, message_count int, input long, output long, cache_read long, cache_write long, reasoning long"


def intervals(spark, *rows):
    return sessions.sessionize(spark.createDataFrame([("a", "s", t, d, n, 1, 0, 0, 0, 0) for t, d, n in rows], MESSAGE))


def test_sessions(spark):
    one = intervals(spark, (1_000_000, 45_000, 1)).collect()[0]
    assert (one["start_ms"], one["end_ms"], one["wall_ms"]) == (1_000_000, 1_045_000, 45_000)
    assert intervals(spark, (1_000_000, 60_000, 1), (1_600_000, 30_000, 1)).count() == 2
    assert [r["wall_ms"] for r in intervals(spark, *((1 + 60_000 * i, 0, 1) for i in range(5))).collect()] == [240_000]
    spread = intervals(spark, (1_000_000, None, 1), (9_000_000, None, 0), (20_000_000, None, 0))
    assert spread.count() == 3 and sessions.time_totals(spread).first()["sessions"] == 1
    assert intervals(spark, (0, None, 1), (1_000_000, None, 1)).count() == 1
    empty = intervals(spark).where("false")
    assert sessions.longest_run(empty).first()[0] in (0, None) and sessions.max_concurrent(empty).first()[0] == 0


def test_prices(spark):
    card = {"m": ((1, None, 2, None, None), (0, None, None, None, None), (0, None, None), (0, None)), "gpt-5.4": pricing.CATALOGUE["gpt-5.4"]}
    fields = "model string, cost_source string, reported_nanos long, input long, output long, cache_read long, cache_write long, reasoning long"
    rows = [("m", "estimated", 0, 200_000, 0, 0, 0, 0), ("m", "estimated", 0, 400_000, 0, 0, 0, 0), ("gpt-5.4", "estimated", 0, 272_000, 0, 0, 0, 0), ("gpt-5.4", "estimated", 0, 272_001, 0, 0, 0, 0), ("x", "reported", 7, 1, 0, 0, 0, 0), ("x", "estimated", 0, 1, 0, 0, 0, 0)]
    got = [(r["cost_nanos"], r["is_covered"]) for r in pricing.priced(spark.createDataFrame(rows, fields), card).collect()]
    assert got == [(200_000, True), (600_000, True), (272_000 * 2500, True), (272_001 * 5000, True), (7, True), (0, False)]


def test_sums_stop_at_the_largest_long(spark):
    rows = spark.createDataFrame([(safe.MOST,), (safe.MOST,)], "x long")
    from pyspark.sql import functions as F

    assert rows.agg(safe.sat_sum(F.col("x"))).first()[0] == safe.MOST


def test_names(spark):
    from pyspark.sql import functions as F

    raw = spark.createDataFrame([("Moonshot/", "write-agent  two", 1_234_567), ("<none>", None, 12), ("ai21", "x", 1), ("acme9", "x", 1)], "p string, a string, n long")
    got = [tuple(r) for r in raw.select(names.provider_canonical(F.col("p")), names.agent_name(F.col("a")), names.fmt_tokens(F.col("n"))).collect()]
    assert got == [("moonshotai", "Write Agent Two", "1.23M"), (None, None, "12"), ("ai21", "X", "1"), (None, "X", "1")]


def test_tree_and_dedup(spark):
    edges = spark.createDataFrame([(1, None), (2, 1), (3, 2), (5, 6), (6, 5)], "node long, parent long")
    assert sorted(map(tuple, hierarchy.descendants(spark, edges).collect())) == [(1, 1, 0), (1, 2, 1), (1, 3, 2)]
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, None), (5, "")], "event_id long, dedup_key string")
    assert sorted(r["event_id"] for r in dedup.first_wins(rows).collect()) == [1, 3, 4, 5]
    assert filters.outside_ranges(spark.createDataFrame([(1,), (5,), (9,)], "ts_ms long"), [(4, 6), (5, 9)]).count() == 2


def test_logs(spark, tmp_path):
    from tallyspark.sources import logs

    (tmp_path / "c").mkdir()
    (tmp_path / "c/s.jsonl").write_bytes(b'{"type":"assistant","requestId":"r","sessionId":"s1","timestamp":"2026-01-01T00:00:00Z","message":{"id":"m","model":"x","usage":{"input_tokens":5,"output_tokens":"7"}}}\r\n{bad \xff line\n')
    row = logs.read(spark, "claude", str(tmp_path / "c")).collect()
    assert [(r["dedup_key"], r["input"], r["output"], r["ts_ms"]) for r in row] == [("m:r", 5, 7, 1767225600000)]
    (tmp_path / "x").mkdir()
    (tmp_path / "x/roll.jsonl").write_text('{"type":"event_msg","timestamp":1767225600,"payload":{"type":"token_count","model":"gpt-5.4","info":{"last_token_usage":{"input_tokens":10,"cached_input_tokens":4,"output_tokens":6,"reasoning_output_tokens":9}}}}\n')
    r = logs.read(spark, "codex", str(tmp_path / "x")).first()
    assert (r["input"], r["cache_read"], r["output"], r["reasoning"], r["session_id"], r["ts_ms"]) == (6, 4, 0, 6, "roll", 1767225600000)
    (tmp_path / "u").mkdir()
    (tmp_path / "u/usage1.csv").write_text("Date,Model,Input (w/ Cache Write),Input (w/o Cache Write),Cache Read,Output Tokens,Total Tokens,Cost\n2026-01-01T00:00:00Z,m,1,2,3,4,10,\"$1,234.56\"\n2026-01-02T00:00:00Z,m,1,2,3,4,10,Included\n")
    assert sorted(r["cost"] for r in logs.read(spark, "cursor", str(tmp_path / "u")).collect()) == [0.0, 1234.56]


def test_entry(spark):
    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())


def test_deep_and_wide_trees(spark):
    chain = spark.range(10_000).selectExpr("id as node", "if(id = 0, null, id - 1) as parent")
    got = hierarchy.descendants(spark, chain).agg(F.max("depth"), F.count(F.lit(1)), F.max("root")).first()
    assert tuple(got) == (9_999, 10_000, 0)
    wide = spark.range(2_000_000).selectExpr("id as node", "if(id = 0, null, id div 3) as parent").where("node = 0 or node <> parent")
    assert hierarchy.descendants(spark, wide).count() == 2_000_000
    rows = [(1, None), (2, 1), (3, 4), (4, 3), (5, 4), (6, 99)]
    loops = spark.createDataFrame(rows, "node long, parent long")
    assert sorted(map(tuple, hierarchy.descendants(spark, loops).collect())) == [(1, 1, 0), (1, 2, 1)]
    ordered = hierarchy.tree_order(loops.withColumn("position", F.col("node"))).orderBy("path").collect()
    assert [(r["node"], r["depth"]) for r in ordered] == [(1, 0), (2, 1), (3, 0), (4, 0), (5, 1), (6, 0)]


def test_rows_without_keys_are_never_merged(spark):
    u = spark.createDataFrame([(1, None, 5, "reported", 7), (2, None, 6, "estimated", 0), (3, "", 1, "estimated", 0), (4, "k", 1, "estimated", 0), (5, "k", 9, "reported", 3)], "event_id long, dedup_key string, input long, cost_source string, reported_nanos long")
    u = u.withColumns({c: F.lit(0).cast("long") for c in ("output", "cache_read", "cache_write", "reasoning", "duration_ms")})
    assert sorted((r["event_id"], r["input"]) for r in dedup.max_merge(u).collect()) == [(1, 5), (2, 6), (3, 1), (4, 9)]
    assert sorted((r["event_id"], r["reported_nanos"], r["cost_source"]) for r in dedup.reported_cost_wins(u).collect()) == [(1, 7, "reported"), (2, 0, "estimated"), (3, 0, "estimated"), (4, 3, "reported")]


def test_sweeps_over_minutes(spark):
    import random

    rng = random.Random(4)
    spans = [(s := rng.randrange(1, 20_000_000), s + rng.choice([0, 1, 59_999, 400_000])) for _ in range(400)]
    own = spark.createDataFrame([(a, b, b - a) for a, b in spans], "start_ms long, end_ms long, wall_ms long")
    marks = sorted([(a, 0, 1) for a, b in spans] + [(max(b, a + 1), 1, -1) for a, b in spans])
    now = most = 0
    for _, _, d in marks:
        now += d
        most = max(most, now)
    assert sessions.max_concurrent(own).first()[0] == most
    best, top, head = 0, None, None
    for a, b in sorted(x for x in spans if x[1] > x[0]):
        if top is None or a > top + sessions.GAP_MS:
            head, top = a, b
        top = max(top, b)
        best = max(best, top - head)
    assert sessions.longest_run(own).first()[0] == best


def test_names_mean_rows_of_the_catalogue(spark):
    from tallyspark.operators import price_lookup
    from tallyspark.plans import more

    known = price_lookup.Catalogue(tuple(more.CATALOGUE))
    for model, provider, stage, key in more.MEANT:
        got = known.resolve(model, provider)
        assert (got and (got[0], got[2])) == (stage and (stage, key)), (model, provider, got)
    assert price_lookup.usable([("a", "github_copilot/x", 1.0), ("a", "y", None), ("a", "z", 0.0)]) == [("a", "z")]
