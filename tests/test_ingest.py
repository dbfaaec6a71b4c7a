"""Incremental reading: batches, changes, state and replays."""

import json

from pyspark.sql import functions as F

from tallyspark.operators import archive
from tallyspark.streaming import ingest


def _write(folder, name, *totals):
    (folder / f"{name}.jsonl").write_text("".join(json.dumps({"session": s, "line": n, "total": t}) + "\n" for s, n, t in totals))


def test_batches_are_bounded_and_read_once(spark, tmp_path):
    logs, seen = tmp_path / "logs", []
    logs.mkdir()
    for i in range(7):
        _write(logs, f"f{i}", ("s", i, i))
    read = lambda: ingest.run(ingest.new_lines(spark, str(logs), files=3), lambda b, n: seen.append((n, b.select("path").distinct().count())), str(tmp_path / "c")).awaitTermination()
    read()
    assert [n for _, n in seen] == [3, 3, 1]
    read()
    assert len([x for x in seen if x[1]]) == 3
    _write(logs, "f9", ("s", 9, 9))
    read()
    assert [n for _, n in seen if n] == [3, 3, 1, 1]


def test_increments_resume_and_take_late_rows(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    out = []

    def read():
        own = ingest.new_lines(spark, str(logs)).select(F.from_json("value", "session string, line long, total long").alias("d")).select("d.*")
        ingest.run(ingest.increments(own), lambda b, _: out.extend(map(tuple, b.collect())), str(tmp_path / "c")).awaitTermination()

    _write(logs, "a", ("s", 1, 10), ("s", 2, 8), ("s", 3, 25), ("t", 1, 4))
    read()
    _write(logs, "b", ("s", 5, 40), ("s", 4, 20), ("t", 2, 4))
    read()
    assert sorted(out) == [("s", 1, 10), ("s", 2, 0), ("s", 3, 15), ("s", 4, 0), ("s", 5, 15), ("t", 1, 4), ("t", 2, 0)]


def test_changed_files(spark, tmp_path):
    import os

    for name in "abc":
        (tmp_path / name).write_text(name)
    before = spark.createDataFrame(ingest.fingerprints(spark, str(tmp_path)).collect())
    (tmp_path / "a").write_text("other")
    os.utime(tmp_path / "b", (1, 1))
    (tmp_path / "d").write_text("new")
    got = ingest.changed(ingest.fingerprints(spark, str(tmp_path)), before).collect()
    assert sorted(r["path"][-1] for r in got) == ["a", "d"]


def test_replays_change_nothing(spark):
    rows = spark.createDataFrame([("x", 1, 5), ("y", 2, 6)], "fact_id string, event_id long, n long")
    once = archive.merge(rows, rows)
    assert sorted(map(tuple, archive.merge(once, rows).collect())) == sorted(map(tuple, rows.collect()))


def test_status():
    assert ingest.status(None) == "starting" and ingest.status({"numInputRows": 0, "sources": [{"metrics": None}]}) == "ready"
    assert ingest.status({"numInputRows": 3}) == "catching_up" and ingest.status({"numInputRows": 0, "sources": [{"metrics": {"numFilesOutstanding": "2"}}]}) == "catching_up"
