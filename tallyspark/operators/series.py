"""Series without gaps, and periods to date. The present is the latest row's time unless it is given."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import safe

MINUTE, DAY = 60_000, 86_400_000


def _tokens():
    return sum((F.col(c) for c in ("output", "cache_read", "cache_write", "reasoning")), F.col("input"))


def trailing(priced: DataFrame, step_ms: int, n: int) -> DataFrame:
    """(bucket_ms, tokens, cost_nanos, messages) of the last n steps up to the latest row, with 0 where nothing was."""
    last = priced.agg(F.max("ts_ms").alias("m")).select(safe.floor_div(F.col("m"), step_ms).alias("last"))
    buckets = last.select(F.explode(F.sequence(F.col("last") - (n - 1), F.col("last"))).alias("bucket"))
    since = priced.crossJoin(F.broadcast(last)).where(F.col("ts_ms") >= (F.col("last") - (n - 1)) * step_ms)
    sums = since.groupBy(safe.floor_div(F.col("ts_ms"), step_ms).alias("bucket")).agg(safe.sat_sum(_tokens()).alias("tokens"), safe.sat_sum(F.col("cost_nanos")).alias("cost_nanos"), safe.sat_sum(F.col("message_count")).alias("messages"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return buckets.join(sums, "bucket", "left").select((F.col("bucket") * step_ms).alias("bucket_ms"), zero("tokens"), zero("cost_nanos"), zero("messages"))


def weekly(priced: DataFrame) -> DataFrame:
    """Weeks from Monday, from the first to the last with a row, without gaps."""
    own = priced.groupBy(F.to_date(F.date_trunc("week", F.to_date("date"))).alias("w")).agg(safe.sat_sum(_tokens()).alias("tokens"), safe.sat_sum(F.col("cost_nanos")).alias("cost_nanos"))
    every = own.agg(F.min("w").alias("a"), F.max("w").alias("b")).where("a is not null").select(F.explode(F.expr("sequence(a, b, interval 7 day)")).alias("w"))
    return every.join(own, "w", "left").select(F.date_format("w", "yyyy-MM-dd").alias("week"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("cost_nanos", F.lit(0)).alias("cost_nanos"))


def to_date(priced: DataFrame, period: str = "week") -> DataFrame:
    """Totals of the latest row's week (from Monday) or month."""
    last = priced.agg(F.max("date").alias("last"))
    own = priced.crossJoin(F.broadcast(last)).where(F.to_date("date") >= F.date_trunc(period, F.to_date("last")))
    return own.agg(safe.sat_sum(_tokens()).alias("tokens"), safe.sat_sum(F.col("cost_nanos")).alias("cost_nanos"), safe.sat_sum(F.col("message_count")).alias("messages"))


def models_of_last(priced: DataFrame, ms: int = 60 * MINUTE) -> DataFrame:
    """(model, tokens, cost_nanos) of the last ms up to the latest row, where there are tokens."""
    last = priced.agg(F.max("ts_ms").alias("last"))
    own = priced.crossJoin(F.broadcast(last)).where(F.col("ts_ms") > F.col("last") - ms)
    return own.groupBy("model").agg(safe.sat_sum(_tokens()).alias("tokens"), safe.sat_sum(F.col("cost_nanos")).alias("cost_nanos")).where("tokens > 0")


def months_back(priced: DataFrame, n: int = 3) -> DataFrame:
    last = priced.agg(F.max("date").alias("last"))
    own = priced.crossJoin(F.broadcast(last)).where(F.col("date") >= F.date_format(F.add_months(F.date_trunc("month", F.to_date("last")), 1 - n), "yyyy-MM-dd"))
    return own.groupBy(safe.month_key(F.col("date")).alias("month")).agg(safe.sat_sum(_tokens()).alias("tokens"), safe.sat_sum(F.col("cost_nanos")).alias("cost_nanos"))


def in_zone(rollups: DataFrame, zone: str, step: str = "hour") -> DataFrame:
    """Minute rollups (bucket_ms, ...) as a series of the zone's hours, days or months."""
    form = {"hour": "yyyy-MM-dd HH:00", "day": "yyyy-MM-dd", "month": "yyyy-MM"}[step]
    own = rollups.where("period = 1").groupBy(F.date_format(safe.zone_time(F.col("bucket_ms"), zone), form).alias("bucket"), "client")
    return own.agg(safe.sat_sum(_tokens()).alias("tokens"), safe.sat_sum(F.col("cost_nanos")).alias("cost_nanos"), safe.sat_sum(F.col("message_count")).alias("messages"))


def merged(*parts: DataFrame) -> DataFrame:
    """Series (bucket, tokens, cost_nanos, messages) of several sources as one."""
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole.groupBy("bucket").agg(*(safe.sat_sum(F.col(c)).alias(c) for c in ("tokens", "cost_nanos", "messages")))


def trailing_costs(priced: DataFrame) -> DataFrame:
    """(today, week): cost of the latest row's day, and of the seven days up to it."""
    days = priced.groupBy("date").agg(safe.sat_sum(F.col("cost_nanos")).alias("c"))
    last = days.agg(F.max("date").alias("last"))
    own = days.crossJoin(F.broadcast(last))
    back = F.date_diff(F.to_date("last"), F.to_date("date"))
    return own.agg(safe.sat_sum(F.when(back == 0, F.col("c")).otherwise(0)).alias("today"), safe.sat_sum(F.when(back < 7, F.col("c")).otherwise(0)).alias("week"))


def peak(points: DataFrame, key: str = "date", value: str = "cost_nanos") -> DataFrame:
    """(key, value, top): the greatest point, the first of several, and a round maximum for a chart above it."""
    best = points.agg(F.max(F.struct(F.col(value), (-F.unix_date(F.to_date(key))).alias("n"), F.col(key))).alias("b")).select(F.col(f"b.{key}").alias(key), F.col(f"b.{value}").alias(value))
    size = F.pow(F.lit(10.0), F.floor(F.log10(F.greatest(F.col(value), F.lit(1)).cast("double"))))
    return best.withColumn("top", (F.ceil(F.col(value) / size) * size).cast("long"))


def unordered(snapshot: DataFrame, key: str = "bucket") -> DataFrame:
    """(problem, n) of a snapshot (client, bucket, tokens, cost_nanos, messages): repeated buckets of a client, negative
    measures, empty clients. No rows where it may be stored."""
    twice = snapshot.groupBy("client", key).count().where("count > 1").agg(F.count(F.lit(1)).alias("n")).select(F.lit("repeated").alias("problem"), "n")
    low = snapshot.where("least(tokens, cost_nanos, messages) < 0").agg(F.count(F.lit(1)).alias("n")).select(F.lit("negative").alias("problem"), "n")
    none = snapshot.where("client is null or trim(client) = ''").agg(F.count(F.lit(1)).alias("n")).select(F.lit("nameless").alias("problem"), "n")
    return twice.unionByName(low).unionByName(none).where("n > 0")


def top_models(priced: DataFrame, most: int = 5) -> DataFrame:
    """The models with the most tokens, by name where equal."""
    own = priced.groupBy("model").agg(safe.sat_sum(_tokens()).alias("tokens"), safe.sat_sum(F.col("cost_nanos")).alias("cost_nanos"))
    return own.orderBy(F.col("tokens").desc(), "model").limit(most)
