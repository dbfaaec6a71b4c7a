"""Which revision of an event counts."""

import random

from tallyspark.operators import archive

COUNTS = ("input", "output", "cache_read", "cache_write", "reasoning", "message_count")
SCHEMA = "event string, revision_hash string, generation long, cost_rank int, reported_nanos long, duration_ms long, same string, is_turn_start boolean, " + ", ".join(f"{c} long" for c in COUNTS)


def extends(later, earlier):
    rank = lambda r: (r["duration_ms"] is not None, r["duration_ms"] or 0)
    cost = earlier["cost_rank"] == 0 or (later["cost_rank"] == 2 and later["reported_nanos"] == earlier["reported_nanos"])
    turn = later["is_turn_start"] or not earlier["is_turn_start"]
    return later["same"] == earlier["same"] and all((later[c] or 0) >= (earlier[c] or 0) for c in COUNTS) and turn and rank(later) >= rank(earlier) and cost


def one_event(rows):
    now, conflict = None, False
    for generation in sorted({r["generation"] for r in rows}):
        group = [r for r in rows if r["generation"] == generation]
        if now is not None and not all(extends(r, now) for r in group):
            conflict = True
            continue
        top = [r for r in group if all(extends(r, x) for x in group)]
        if top:
            now = min(top, key=lambda r: (-r["cost_rank"], r["revision_hash"]))
        else:
            conflict, now = True, now or min(group, key=lambda r: r["revision_hash"])
    return now["revision_hash"], conflict


def revisions(rng, events):
    for e in range(events):
        for k in range(rng.randint(1, 6)):
            grown = [rng.choice((0, 0, 1)) + rng.choice((0, k)) for _ in COUNTS] if rng.random() < 0.5 else [k // 2] * len(COUNTS)
            cost = rng.choice((0, 0, 0, 1, 2, 2))
            yield (None if e == 0 else f"e{e}", f"h{rng.randint(0, 99):02d}-{k}", rng.choice((k // 2, 0)), cost, rng.choice((None, 5, 5, 6)), rng.choice((None, k, -1)), rng.choice(("x",) * 20 + ("y", None)), rng.choice((None, False, k > 2)), *(x if rng.random() < 0.95 else None for x in grown))


def test_completed_equals_one_event_at_a_time(spark):
    rows = list(revisions(random.Random(3), 3000))
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    by_event = {}
    for r in rows:
        by_event.setdefault(r[0], []).append(dict(zip(names, r, strict=True)))
    want = {e: one_event(x) for e, x in by_event.items()}
    got = archive.completed(spark.createDataFrame(rows, SCHEMA).repartition(7))
    assert {r["event"]: (r["revision_hash"], r["conflict"]) for r in got.collect()} == want
    assert len({c for _, c in want.values()}) == 2 and sum(not c for _, c in want.values()) > 300


def test_completed_is_exact_and_runs_no_python_for_each_event(spark):
    long, rest = 2**53, (1,) * 6
    rows = [("a", "p", 0, 0, None, None, "x", False, *rest), ("a", "q", 1, 0, None, long + 1, "x", False, *rest), ("a", "r", 2, 0, None, long, "x", False, *rest)]
    rows += [("b", f"h{k:05d}", k % 3, 0, None, None, "x", False, *(k % 3,) * 6) for k in range(20_000)]
    got = archive.completed(spark.createDataFrame(rows, SCHEMA))
    assert sorted(map(tuple, got.collect())) == [("a", "q", True), ("b", "h00002", False)]
    assert "Pandas" not in got._jdf.queryExecution().toString()
    assert archive.completed(spark.createDataFrame([], SCHEMA)).count() == 0
