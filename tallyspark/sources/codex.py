"""Session logs with cumulative counters: increments, inherited history of forks, models that are named later.

A file's lines are one state machine, read in order and never held together: files are dealt over the tasks, each sorted
by line, and a task keeps the state of one file at a time.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names
from . import dialects

_FACTS = "path string, line long, model string, stated string, session string, workspace string, ts_ms long, duration_ms long, input long, output long, cache_read long, reasoning long, agent string, is_turn_start boolean, dedup_key string"

Counts = tuple[int, int, int, int]  # input, output, cached, reasoning


def counts_of(usage) -> Counts | None:
    if not isinstance(usage, dict):
        return None
    n = lambda *ks: next((int(usage[k]) for k in ks if isinstance(usage.get(k), int | float)), 0)
    return n("input_tokens"), n("output_tokens"), max(n("cached_input_tokens"), n("cache_read_input_tokens")), n("reasoning_output_tokens")


def buckets(c: Counts) -> Counts:
    """(input, output, cache_read, reasoning): cached tokens are a part of the input, reasoning of the output."""
    cached = max(min(c[2], c[0]), 0)
    thought = min(max(c[3], 0), max(c[1], 0))
    return max(c[0] - cached, 0), max(c[1], 0) - thought, cached, thought


def increment(total: Counts | None, last: Counts | None, before: Counts | None) -> tuple[Counts | None, Counts | None]:
    """(what a record adds, the counters after it); None for nothing added.

    The last request's usage is the increment; totals only show repeats and steps back. A step back by about one request
    is a late snapshot and adds nothing. Totals alone add their growth; if they shrink they only set the counters.
    """
    if total is None:
        if last is None:
            return None, before
        return last, None if before is None else tuple(a + b for a, b in zip(before, last, strict=True))
    if before is None:
        return last or total, total
    if total == before:
        return None, before
    grown = all(a >= b for a, b in zip(total, before, strict=True))
    if last is None:
        return (tuple(a - b for a, b in zip(total, before, strict=True)), total) if grown else (None, total)
    now, was, one = sum(total), sum(before), sum(last)
    if not grown and min(now, was, one) > 0 and (100 * now >= 98 * was or now + 2 * one >= was):
        return None, before
    return last, total


def _ms(text) -> int | None:
    """Milliseconds of a time with a zone, or of a number of seconds or milliseconds."""
    if isinstance(text, int | float) and text > 0:
        return int(text if text >= 1e12 else text * 1000)
    try:
        found = datetime.fromisoformat(text)
    except (TypeError, ValueError):
        return None
    return None if found.tzinfo is None else round((found - datetime(1970, 1, 1, tzinfo=UTC)).total_seconds() * 1000)


@dataclass
class Session:
    """What is known while a file is read."""

    path: str
    modified: int
    model: str | None = None
    provider: str | None = None
    session: str | None = None
    parent: str | None = None
    agent: str | None = None
    workspace: str | None = None
    before: Counts | None = None
    cursor: int | None = None
    turn: bool = False
    replaying: bool = False
    inherited: Counts | None = None
    waiting: list[dict] = field(default_factory=list)

    def read(self, line: int, record: dict) -> Iterator[dict]:
        kind, payload = record.get("type"), record.get("payload")
        payload = payload if isinstance(payload, dict) else {}
        own = payload.get("type")
        info = payload.get("info") if isinstance(payload.get("info"), dict) else {}
        inner = info.get("model") or info.get("model_name")
        shown = payload.get("model") or payload.get("model_name") or (payload.get("model_info") or {}).get("slug")
        counted = kind == "event_msg" and own == "token_count"
        if self.replaying and kind != "session_meta":
            # a fork's file begins with its parent's records, up to the fork's own first turn
            if kind != "turn_context":
                if counted and (total := counts_of(info.get("total_token_usage"))):
                    self.inherited = total
                return
            self.replaying, self.before = False, self.inherited
        if kind == "session_meta":
            self._meta(payload)
        elif kind == "turn_context":
            self.model, self.cursor = shown, _ms(record.get("timestamp"))
            yield from self._named()
        elif kind == "event_msg" and own == "user_message":
            if not str(payload.get("message") or "").lstrip().startswith("<"):
                self.turn, self.cursor = True, _ms(record.get("timestamp"))
        elif counted and info:
            if name := shown or inner:
                self.model = name
                yield from self._named()
            yield from self._count(line, _ms(record.get("timestamp")), counts_of(info.get("total_token_usage")), counts_of(info.get("last_token_usage")))

    def _meta(self, payload: dict) -> None:
        source = payload.get("source")
        spawn = source.get("subagent") if isinstance(source, dict) else None
        spawn = spawn.get("thread_spawn") if isinstance(spawn, dict) else None
        parent = payload.get("forked_from_id") or (spawn.get("parent_thread_id") if isinstance(spawn, dict) else None)
        again = not self.replaying and self.parent and payload.get("id") == self.session
        if self.replaying and not parent:
            return  # the parent's own header, replayed
        self.session = payload.get("id") or self.session
        if parent and not again:
            self.parent, self.replaying, self.inherited = parent, True, None
        self.provider = payload.get("model_provider") or self.provider
        self.agent = "headless" if source == "exec" else payload.get("agent_nickname") or self.agent
        self.workspace = payload.get("cwd") or self.workspace

    def _count(self, line: int, said: int | None, total: Counts | None, last: Counts | None) -> Iterator[dict]:
        if self.inherited is not None:
            if total is not None and all(a <= b for a, b in zip(total, self.inherited, strict=True)):
                return  # still the parent's history
            self.inherited = None
        added, after = increment(total, last, self.before)
        found = buckets(added) if added else (0, 0, 0, 0)
        if not any(found):
            if added is None:
                self.before = after
            return  # counters of nothing don't move what is known
        self.before = after
        begun = self.cursor if self.cursor is not None else said if said is not None else self.modified
        took = said - self.cursor if said is not None and self.cursor is not None and said > self.cursor else None
        scope = self.parent or self.session or self.path
        key = ":".join(map(str, ("codex", scope, *(total if total else (begun, *found)))))
        row = {"path": self.path, "line": line, "model": self.model, "stated": self.provider, "session": self.path.rpartition("/")[2].removesuffix(".jsonl"), "workspace": self.workspace, "ts_ms": begun, "duration_ms": took, "agent": self.agent, "is_turn_start": self.turn, "dedup_key": key}
        row |= dict(zip(("input", "output", "cache_read", "reasoning"), found, strict=True))
        self.turn = False
        if said is not None and (self.cursor is None or said > self.cursor):
            self.cursor = said
        if self.model is None:
            self.waiting.append(row)
        else:
            yield row

    def _named(self) -> Iterator[dict]:
        """Rows that waited for a model's name."""
        if self.model is not None:
            for row in self.waiting:
                yield row | {"model": self.model}
            self.waiting.clear()

    def end(self) -> Iterator[dict]:
        for row in self.waiting:
            yield row | {"model": "unknown"}


def _read(batches):
    fields = [x.split(" ") for x in _FACTS.split(", ")]
    types = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}
    schema = pa.schema([(n, types[t]) for n, t in fields])
    now: Session | None = None
    out: list[dict] = []
    for batch in batches:
        for path, line, modified, value in zip(*(batch.column(k).to_pylist() for k in ("path", "line", "modified", "value")), strict=True):
            if now is None or now.path != path:
                if now is not None:
                    out += now.end()
                now = Session(path, modified)
            try:
                record = json.loads(value)
            except ValueError:
                continue
            if isinstance(record, dict):
                out += now.read(line, record)
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)
            out = []
    if now is not None and (rest := list(now.end())):
        yield pa.RecordBatch.from_pylist(rest, schema)


def codex_rows(records: DataFrame) -> DataFrame:
    """Usage of records (path, line, modified, value). Repeats across files (forks) go by dedup_key in dedup.first_wins."""
    ordered = records.repartition("path").sortWithinPartitions("path", "line")
    found = ordered.mapInArrow(_read, _FACTS).withColumn("modified", F.lit(0).cast("long"))
    provider = F.coalesce(names.provider_canonical(F.col("stated")), names.provider_infer(F.col("model")), F.lit("openai"))
    return dialects.rows(
        found, "codex", model=F.col("model"), provider=provider, session_id=F.col("session"), workspace=dialects.workspace_key(F.col("workspace")), ts_ms=F.col("ts_ms"), duration_ms=F.col("duration_ms"), agent=F.col("agent"),
        is_turn_start=F.col("is_turn_start"), dedup_key=F.col("dedup_key"), **{k: F.col(k) for k in ("input", "output", "cache_read", "reasoning")},
    )
