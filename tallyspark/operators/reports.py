"""Aggregates of priced usage: by day, hour, month, year, model, session; coverage and intensity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names, safe

BUCKETS = ("input", "output", "cache_read", "cache_write", "reasoning")
GROUPS = {
    "model": ["model"],
    "client_model": ["client", "model"],
    "client_provider_model": ["client", "provider", "model"],
    "workspace_model": ["workspace", "model"],
    "session_model": ["session_id", "model"],
    "client_session_model": ["client", "session_id", "model"],
}


def total() -> Column:
    return sum((safe.nonneg(F.col(c)) for c in BUCKETS[1:]), safe.nonneg(F.col(BUCKETS[0])))


def measures() -> list[Column]:
    """Sums are clamped at 0 after they are taken."""
    sums = [F.greatest(safe.sat_sum(F.col(c)), F.lit(0)).alias(c) for c in BUCKETS]
    return [*sums, safe.sat_sum(F.col("cost_nanos")).alias("cost_nanos"), safe.sat_sum(F.col("message_count")).alias("messages")]


def daily(priced: DataFrame) -> DataFrame:
    turns = F.sum(F.col("is_turn_start").cast("int")).cast("long").alias("turns")
    return priced.groupBy("date").agg(*measures(), turns, safe.sorted_text(F.col("client")).alias("clients"), safe.sorted_text(F.col("model")).alias("models"))


def daily_client_model(priced: DataFrame) -> DataFrame:
    return priced.groupBy("date", "client", names.model_normalize(F.col("model")).alias("model")).agg(*measures(), safe.sorted_text(F.col("provider")).alias("providers"))


def hourly(priced: DataFrame, zone: str = "UTC") -> DataFrame:
    key = safe.hour_key(F.col("ts_ms"), F.col("date"), zone).alias("hour")
    return priced.groupBy(key).agg(*measures(), F.sum(F.col("is_turn_start").cast("int")).cast("long").alias("turns"), safe.sorted_text(F.col("client")).alias("clients"), safe.sorted_text(F.col("model")).alias("models"))


def monthly(priced: DataFrame) -> DataFrame:
    """Rows whose date can't be read take no part."""
    return priced.withColumn("month", safe.month_key(F.col("date"))).where("month is not null").groupBy("month").agg(*measures(), safe.sorted_text(F.col("model")).alias("models"))


def by_model(priced: DataFrame, group: str) -> DataFrame:
    """Usage by one of GROUPS, with the providers seen and the time for a thousand tokens of rows that have both."""
    timed = (F.coalesce(F.col("duration_ms"), F.lit(0)) > 0) & (total() > 0)
    own = priced.groupBy(*GROUPS[group]).agg(
        *measures(),
        safe.sorted_text(F.col("provider")).alias("providers"),
        F.coalesce(F.sum(F.when(timed, F.col("duration_ms"))), F.lit(0)).cast("long").alias("timed_ms"),
        F.coalesce(F.sum(F.when(timed, total())), F.lit(0)).cast("long").alias("timed_tokens"),
    )
    return own.withColumn("ms_per_1k", F.when(F.col("timed_tokens") > 0, F.col("timed_ms") * 1000.0 / F.col("timed_tokens")))


def performance(priced: DataFrame) -> DataFrame:
    timed = (F.coalesce(F.col("duration_ms"), F.lit(0)) > 0) & (total() > 0)
    own = priced.groupBy("model").agg(F.count(F.when(timed, 1)).alias("timed"), F.count(F.lit(1)).alias("rows"), F.sum(F.when(timed, F.col("duration_ms"))).cast("long").alias("ms"), F.sum(F.when(timed, total())).cast("long").alias("tokens"))
    return own.select("model", "timed", F.least(F.lit(1.0), F.col("timed") / F.col("rows")).alias("coverage"), (F.col("ms") * 1000.0 / F.col("tokens")).alias("ms_per_1k"))


def sessions(priced: DataFrame) -> DataFrame:
    seconds = F.when(F.abs("ts_ms") > 1_000_000_000_000, F.expr("ts_ms div 1000")).otherwise(F.col("ts_ms"))
    return priced.groupBy("session_id").agg(*measures(), F.min(seconds).alias("first_seen"), F.max(seconds).alias("last_seen"), safe.sorted_text(F.col("client")).alias("clients"))


def session_top(priced: DataFrame) -> DataFrame:
    """The client, provider and model on which each session spent most; ties go to the first by name."""
    own = priced.groupBy("session_id", "client", "provider", "model").agg(safe.sat_sum(F.col("cost_nanos")).alias("cost_nanos"))
    order = Window.partitionBy("session_id").orderBy(F.col("cost_nanos").desc(), "client", "provider", "model")
    return own.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")


def years(priced: DataFrame) -> DataFrame:
    own = priced.where(F.length("date") >= 4)
    return own.groupBy(F.substring("date", 1, 4).alias("year")).agg(safe.sat_sum(total()).alias("tokens"), safe.sat_sum(F.col("cost_nanos")).alias("cost_nanos"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


def summary(priced: DataFrame) -> DataFrame:
    """One row over all days; a day is active with tokens, cost or messages."""
    days = priced.groupBy("date").agg(safe.sat_sum(total()).alias("tokens"), safe.sat_sum(F.col("cost_nanos")).alias("cost"), safe.sat_sum(F.col("message_count")).alias("messages"))
    active = (F.col("tokens") > 0) | (F.col("cost") > 0) | (F.col("messages") > 0)
    whole = days.agg(safe.sat_sum(F.col("tokens")).alias("tokens"), safe.sat_sum(F.col("cost")).alias("cost_nanos"), F.count(F.when(active, 1)).alias("active_days"), F.coalesce(F.max("cost"), F.lit(0)).alias("max_day_nanos"))
    seen = priced.agg(safe.sorted_text(F.col("client")).alias("clients"), safe.sorted_text(F.col("model")).alias("models"))
    mean = F.when(F.col("active_days") > 0, F.col("cost_nanos") / F.col("active_days")).otherwise(0.0)
    return whole.withColumn("mean_nanos", mean).crossJoin(F.broadcast(seen))  # one row by one row


def intensity(priced: DataFrame) -> DataFrame:
    """0 to 4 by a day's share of the dearest day's cost."""
    days = priced.groupBy("date").agg(safe.sat_sum(F.col("cost_nanos")).alias("cost_nanos"))
    most = days.agg(F.max("cost_nanos").alias("most"))
    share = F.when(F.col("most") > 0, F.col("cost_nanos") / F.col("most")).otherwise(0.0)
    level = F.when(share >= 0.75, 4).when(share >= 0.5, 3).when(share >= 0.25, 2).when(share > 0, 1).otherwise(0)
    return days.crossJoin(F.broadcast(most)).select("date", "cost_nanos", level.alias("intensity"))


def coverage(priced: DataFrame) -> DataFrame:
    own = priced.groupBy("client")
    ok = F.col("is_covered") | (total() == 0)
    return own.agg(
        safe.sat_sum(F.when(ok, total())).alias("covered_tokens"),
        safe.sat_sum(F.when(~ok, total())).alias("uncovered_tokens"),
        safe.sat_sum(F.when(ok, F.col("message_count"))).alias("covered_messages"),
        safe.sat_sum(F.when(~ok, F.col("message_count"))).alias("uncovered_messages"),
    )


def page(rows: DataFrame, by: str, descending: bool, tie: str, size: int = 10) -> DataFrame:
    return rows.orderBy(F.col(by).desc() if descending else F.col(by).asc(), F.col(tie).desc()).limit(size)
