"""Usage as a stream: sessions and minutes under a watermark, and merges that replays don't disturb."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _timed(events: DataFrame, late: str | None) -> DataFrame:
    own = events.withColumn("at", F.col("ts").cast("timestamp"))
    return own.withWatermark("at", late) if late else own


def session_windows(events: DataFrame, gap: str = "30 minutes", late: str | None = "2 hours") -> DataFrame:
    """(user_id, start, end, n) of runs of events with at most gap between them; events later than late may be dropped,
    none if it is None."""
    own = _timed(events, late)
    return own.groupBy(F.session_window("at", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def minute_counts(events: DataFrame, late: str | None = "2 hours") -> DataFrame:
    own = _timed(events, late)
    return own.groupBy(F.window("at", "1 minute").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value")).select(F.col("w.start").alias("minute"), "event_type", "n", "value")


def drain(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Run a live stream over what is there now, into Parquet files at path: only windows behind the watermark, which no
    event can change any more."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()


def drain_whole(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Run a stream over what is there now, and write all its windows at path, those still open too."""
    write = lambda batch, _: batch.write.mode("overwrite").parquet(path)
    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("complete").trigger(availableNow=True).start().awaitTermination()


def merge_batches(stream: DataFrame, target: str, checkpoint: str, key: str, order: str) -> None:
    """Keep the newest row of each key in a table at target/v<batch>; a batch that is run again writes the same version."""

    def write(batch: DataFrame, number: int) -> None:
        from ..operators import archive

        spark = batch.sparkSession
        try:
            stored = spark.read.parquet(f"{target}/v{number - 1}") if number else batch.limit(0)
        except Exception as e:  # the version before isn't there only if nothing was written yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            stored = batch.limit(0)
        archive.merge(stored, batch, key, order).write.mode("overwrite").parquet(f"{target}/v{number}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
