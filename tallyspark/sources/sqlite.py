"""SQLite files as records: each row of a query is a JSON object, so that dialects read it as any other record."""

from __future__ import annotations

import json
import sqlite3

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import dialects

_SCHEMA = "path string, line long, modified long, value string"


def open_bytes(content: bytes) -> sqlite3.Connection:
    """A database in memory, read only. A file in write-ahead mode is read as of its last checkpoint."""
    raw = bytearray(content)
    if raw[18:20] == b"\x02\x02":  # an in-memory database has no write-ahead file
        raw[18:20] = b"\x01\x01"
    found = sqlite3.connect(":memory:")
    found.deserialize(bytes(raw))
    found.execute("PRAGMA query_only = ON")
    return found


def _value(x):
    return x.decode("utf-8", "replace") if isinstance(x, bytes) else x


def records(spark: SparkSession, path: str, glob: str, queries: list[tuple[str, ...]]) -> DataFrame:
    """(path, line, modified, value): rows of every query's first form that the file's schema allows.

    Files travel whole to the tasks (a database of sessions is far below the 2 GB of a binary value). What isn't a
    database, or has none of a query's tables, gives no rows.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    files = files.select("path", F.unix_millis("modificationTime").alias("modified"), "content")

    def run(batches):
        for batch in batches:
            for file, modified, content in zip(*(batch.column(k).to_pylist() for k in ("path", "modified", "content")), strict=True):
                try:
                    base = open_bytes(content)
                except sqlite3.Error:
                    continue
                line = 0
                for forms in queries:
                    for form in forms:
                        try:
                            cursor = base.execute(form)
                            fields = [d[0] for d in cursor.description]
                            while part := cursor.fetchmany(1000):
                                values = [json.dumps({k: _value(v) for k, v in zip(fields, row, strict=True)}) for row in part]
                                n = len(values)
                                yield pa.RecordBatch.from_arrays([pa.array([file] * n), pa.array(range(line, line + n), pa.int64()), pa.array([modified] * n, pa.int64()), pa.array(values)], ["path", "line", "modified", "value"])
                                line += n
                            break
                        except sqlite3.Error:
                            continue
                base.close()

    return files.mapInArrow(run, _SCHEMA)


#: Of each client: a glob, queries (each in forms, the first that the schema allows counts), and the dialect of the rows.
TABLES = {
    "kilo": ("kilo.db", [("SELECT id, session_id, data FROM message ORDER BY rowid",)], dialects.kilo),
    "opencode": ("opencode*.db", [("SELECT id, session_id, data FROM message ORDER BY rowid", "SELECT id, session_id, data FROM session_message ORDER BY rowid")], dialects.opencode),
    "micode": ("*.db", [("SELECT id, session_id, data FROM message ORDER BY rowid",)], dialects.micode),
    "octofriend": ("sqlite.db", [("SELECT * FROM messages ORDER BY rowid",)], dialects.octofriend),
    "crush": ("crush.db", [("SELECT 'sessions' AS \"table\", * FROM sessions ORDER BY rowid",), ("SELECT 'messages' AS \"table\", id, session_id, role, created_at FROM messages ORDER BY rowid",)], dialects.crush),
    "goose": ("sessions.db", [("SELECT * FROM sessions ORDER BY rowid",)], dialects.goose),
    "hermes": ("state.db", [("SELECT 'sessions' AS \"table\", * FROM sessions ORDER BY rowid",), ("SELECT 'session_model_usage' AS \"table\", * FROM session_model_usage ORDER BY rowid",)], dialects.hermes),
}
