"""The tables of the test data as rows of usage, by integer arithmetic that any SQL engine repeats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CLIENTS = ("codex", "claude", "opencode")
MODELS = {
    "click": ("openai", "gpt-5.4"),
    "error": ("anthropic", "claude-opus-4-6"),
    "purchase": ("google", "gemini-3-pro"),
    "signup": ("xai", "grok-4"),
    "view": ("anthropic", "claude-sonnet-4-5"),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def usage_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One usage row for each event."""
    e, n = table(spark, sf_dir, "events"), F.col("event_id")
    pick = lambda i: F.coalesce(*(F.when(F.col("event_type") == k, v[i]) for k, v in MODELS.items()))
    ts = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts) div 1000")
    return e.select(
        n,
        F.element_at(F.array(*map(F.lit, CLIENTS)), (n % 3 + 1).cast("int")).alias("client"),
        pick(0).alias("provider"),
        pick(1).alias("model"),
        F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("session_id"),
        F.when(F.col("user_id") % 10 != 0, F.concat(F.lit("/home/w/p"), (F.col("user_id") % 10).cast("string"))).alias("workspace"),
        ts.alias("ts_ms"),
        F.date_format("ts", "yyyy-MM-dd").alias("date"),
        (F.get_json_object("props", "$.k").cast("long") * 4000).alias("input"),
        (n % 977 * 3).alias("output"),
        (n % 1009 * 300).alias("cache_read"),
        (n % 313 * 800).alias("cache_write"),
        (n % 89).alias("reasoning"),
        F.when(n % 11 == 0, "reported").otherwise("estimated").alias("cost_source"),
        F.when(n % 11 == 0, n % 1000 * 1_000_000).otherwise(F.lit(0).cast("long")).alias("reported_nanos"),
        F.when(n % 5 != 0, n % 7 * 20_000).alias("duration_ms"),
        F.when(n % 13 == 0, 0).otherwise(1).alias("message_count"),
        (n % 4 == 0).alias("is_turn_start"),
        F.when(n % 17 != 0, F.floor(n / 2).cast("string")).alias("dedup_key"),
    )
