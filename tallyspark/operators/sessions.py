"""Activity intervals: sessions by idle gap, their totals, the longest run, concurrency, time per day.

Questions about all sessions at once are answered in two levels: within a minute by a window on the minute, between
minutes by what each carries over, that in turn within a day and between days. No task holds more than a minute's
intervals or a day's minutes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import safe

GAP_MS, DAY_MS, PART_MS = 180_000, 86_400_000, 60_000
_PAST = Window.unboundedPreceding


def sessionize(usage: DataFrame, gap_ms: int = GAP_MS) -> DataFrame:
    """(client, session_id, start_ms, end_ms, wall_ms, messages, tokens): a row ends at its time and positive duration; a
    new interval starts more than the gap after the latest end so far. Rows without a time take no part."""
    own = usage.where("ts_ms > 0").withColumn("end", F.col("ts_ms") + F.greatest(F.coalesce("duration_ms", F.lit(0)), F.lit(0)))
    order = Window.partitionBy("client", "session_id").orderBy("ts_ms", "end")
    latest = F.max("end").over(order.rowsBetween(_PAST, -1))
    own = own.withColumn("fresh", (latest.isNull() | (F.col("ts_ms") > latest + gap_ms)).cast("int"))
    own = own.withColumn("block", F.sum("fresh").over(order.rowsBetween(_PAST, 0)))
    tokens = sum((F.col(c) for c in ("output", "cache_read", "cache_write", "reasoning")), F.col("input"))
    found = own.groupBy("client", "session_id", "block").agg(F.min("ts_ms").alias("start_ms"), F.max("end").alias("end_ms"), F.sum("message_count").cast("long").alias("messages"), safe.sat_sum(tokens).alias("tokens"))
    return found.select("client", "session_id", "start_ms", "end_ms", (F.col("end_ms") - F.col("start_ms")).alias("wall_ms"), "messages", "tokens")


def time_totals(intervals: DataFrame) -> DataFrame:
    """Sessions are intervals with messages, and (client, session) pairs whose intervals have none."""
    groups = intervals.groupBy("client", "session_id").agg(F.sum("wall_ms").alias("ms"), F.count(F.when(F.col("messages") > 0, 1)).alias("n"))
    return groups.agg(F.coalesce(F.sum("ms"), F.lit(0)).cast("long").alias("wall_ms"), F.coalesce(F.sum(F.greatest("n", F.lit(1))), F.lit(0)).cast("long").alias("sessions"))


def _carried(parts: DataFrame, value: str, how) -> DataFrame:
    """(part, before): how (F.max or F.sum) of value over all parts (part, value) before; parts are minutes."""
    own = parts.withColumn("day__", safe.floor_div(F.col("part"), DAY_MS // PART_MS))
    days = own.groupBy("day__").agg(how(value).alias("v__"))
    days = days.select("day__", how("v__").over(Window.orderBy("day__").rowsBetween(_PAST, -1)).alias("before_day"))
    inside = how(value).over(Window.partitionBy("day__").orderBy("part").rowsBetween(_PAST, -1))
    both = own.withColumn("inside", inside).join(days, "day__")
    whole = F.greatest("inside", "before_day") if how is F.max else F.coalesce("inside", F.lit(0)) + F.coalesce("before_day", F.lit(0))
    return both.select("part", whole.alias("before"))


def longest_run(intervals: DataFrame, gap_ms: int = GAP_MS) -> DataFrame:
    """(longest_ms): intervals of all sessions with some length, merged where the gap is small."""
    own = intervals.where("start_ms > 0 and wall_ms > 0").select("start_ms", "end_ms", safe.floor_div(F.col("start_ms"), PART_MS).alias("part"))
    carried = _carried(own.groupBy("part").agg(F.max("end_ms").alias("top")), "top", F.max)
    order = Window.partitionBy("part").orderBy("start_ms", "end_ms")
    own = own.join(carried, "part").withColumn("latest", F.greatest("before", F.max("end_ms").over(order.rowsBetween(_PAST, -1))))
    heads = own.where(F.col("latest").isNull() | (F.col("start_ms") > F.col("latest") + gap_ms)).select("part", "start_ms", "latest")
    # a run ends where the next one starts: at the latest end seen until then; the last at the latest of all
    runs = _carried(heads.groupBy("part").agg(F.max("start_ms").alias("last")), "last", F.max)
    inner = F.lag("start_ms").over(Window.partitionBy("part").orderBy("start_ms"))
    closed = heads.join(runs, "part").withColumn("head", F.coalesce(inner, F.col("before"))).where("head is not null").select((F.col("latest") - F.col("head")).alias("ms"))
    final = own.agg(F.max("end_ms").alias("e")).crossJoin(heads.agg(F.max("start_ms").alias("s"))).select((F.col("e") - F.col("s")).alias("ms"))
    return closed.union(final).agg(F.coalesce(F.max("ms"), F.lit(0)).alias("longest_ms"))


def max_concurrent(intervals: DataFrame) -> DataFrame:
    """(max_concurrent): starts count before ends at the same time; an interval without length lasts 1 ms."""
    own = intervals.where("start_ms > 0").select("start_ms", F.greatest("end_ms", F.col("start_ms") + 1).alias("end_ms"))
    marks = own.select(F.explode(F.array(F.struct(F.col("start_ms").alias("at"), F.lit(1).alias("d")), F.struct(F.col("end_ms").alias("at"), F.lit(-1).alias("d")))).alias("m"))
    marks = marks.groupBy(F.col("m.at").alias("at"), F.col("m.d").alias("d")).agg(F.sum("m.d").alias("n")).withColumn("part", safe.floor_div(F.col("at"), PART_MS))
    carried = _carried(marks.groupBy("part").agg(F.sum("n").alias("net")), "net", F.sum)
    order = Window.partitionBy("part").orderBy("at", F.col("d").desc()).rowsBetween(_PAST, 0)
    return marks.join(carried, "part").select((F.coalesce("before", F.lit(0)) + F.sum("n").over(order)).alias("n")).agg(F.greatest(F.coalesce(F.max("n"), F.lit(0)), F.lit(0)).cast("long").alias("max_concurrent"))


def daily_active(intervals: DataFrame, zone: str = "UTC") -> DataFrame:
    """(date, active_ms): each interval's overlap with the zone's days."""
    own = intervals.where("start_ms > 0 and wall_ms > 0")
    local = lambda c: F.to_date(safe.zone_time(F.col(c), zone))
    days = own.select("start_ms", "end_ms", F.explode(F.sequence(local("start_ms"), local("end_ms"))).alias("day"))
    edge = lambda d: F.unix_millis(F.to_utc_timestamp(d.cast("timestamp"), zone))
    overlap = F.least("end_ms", edge(F.date_add("day", 1))) - F.greatest("start_ms", edge(F.col("day")))
    return days.withColumn("ms", overlap).where("ms > 0").groupBy(F.date_format("day", "yyyy-MM-dd").alias("date")).agg(F.sum("ms").alias("active_ms"))
