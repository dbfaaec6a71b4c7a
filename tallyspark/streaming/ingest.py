"""Incremental reading of logs: bounded batches, which files changed, counters that resume, replays that change nothing."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: A batch reads at most so many new files; the file source remembers which were read.
FILES = 32


def new_lines(spark: SparkSession, path: str, glob: str = "*.jsonl", files: int = FILES) -> DataFrame:
    """A stream of (path, value, modified): a row per line of files that weren't read yet, at most so many files a batch."""
    raw = spark.readStream.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).option("maxFilesPerTrigger", files).text(path)
    return raw.select(F.col("_metadata.file_path").alias("path"), "value", F.unix_millis("_metadata.file_modification_time").alias("modified"))


def fingerprints(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, size, modified, digest) of the files below a folder; the digest is of their whole contents."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return files.select("path", F.col("length").alias("size"), F.unix_millis("modificationTime").alias("modified"), F.sha2("content", 256).alias("digest"))


def changed(now: DataFrame, before: DataFrame) -> DataFrame:
    """Files of now (path, size, modified, digest) that are new or whose contents differ; a touched file with the same
    contents isn't changed. Sizes and times that agree spare the comparison of digests."""
    known = before.select("path", F.struct("size", "modified").alias("known__"), F.col("digest").alias("digest__"))
    own = now.join(known, "path", "left")
    same = (F.struct("size", "modified").eqNullSafe(F.col("known__"))) | F.col("digest").eqNullSafe(F.col("digest__"))
    return own.where(F.col("known__").isNull() | ~same).select(*now.columns)


def increments(totals: DataFrame) -> DataFrame:
    """(session, line, added) of a stream of cumulative totals (session, line, total): growth over the greatest total so
    far, which the stream's state carries from batch to batch; what doesn't grow adds nothing, however late it comes."""

    def grow(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        top = state.get[0] if state.exists else 0
        for part in parts:
            rows = part.sort_values("line")
            tops = rows["total"].cummax().clip(lower=top)
            before = tops.shift(fill_value=top)
            top = int(tops.iloc[-1]) if len(tops) else top
            yield pd.DataFrame({"session": key[0], "line": rows["line"], "added": (tops - before).astype("int64")})
        state.update((top,))

    return totals.groupBy("session").applyInPandasWithState(grow, "session string, line long, added long", "top long", "append", GroupStateTimeout.NoTimeout)


def status(progress: dict | None, waiting: int = 0) -> str:
    """ready, catching_up or starting, from a query's last progress and what its source says is still waiting."""
    if not progress:
        return "starting"
    behind = waiting or sum(int((s.get("metrics") or {}).get("numFilesOutstanding", 0) or 0) for s in progress.get("sources", []))
    return "catching_up" if behind or progress.get("numInputRows", 0) else "ready"


def run(stream: DataFrame, write, checkpoint: str, live: str | None = None):
    """Hand each batch (rows, number) to write: once over all there is, or every live interval ("60 seconds"). A batch
    counts as read only when write has returned, and has the same number if it is run again."""
    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    query = query.trigger(processingTime=live) if live else query.trigger(availableNow=True)
    return query.start()
