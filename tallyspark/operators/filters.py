"""Row filters of usage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names


def by_date(usage: DataFrame, year: str | None = None, since: str | None = None, until: str | None = None) -> DataFrame:
    """Inclusive, by the order of date texts."""
    for condition in (year and F.col("date").startswith(f"{year}-"), since and F.col("date") >= since, until and F.col("date") <= until):
        if condition is not None:
            usage = usage.where(condition)
    return usage


def by_clients(usage: DataFrame, clients: list[str]) -> DataFrame:
    return usage.where(names.client_surface(F.col("client")).isin(*clients))


def valid(usage: DataFrame) -> DataFrame:
    """Adds is_valid and clamps: negative counts, and costs that aren't finite numbers from 0 on, become 0 and mark the row."""
    counts = [c for c in ("input", "output", "cache_read", "cache_write", "reasoning", "message_count") if c in usage.columns]
    costs = [c for c in ("cost", "cost_nanos", "reported_nanos") if c in usage.columns]
    wrong = {c: F.coalesce(F.col(c) < 0, F.lit(False)) for c in counts}
    for c in costs:
        x = F.col(c).cast("double")
        wrong[c] = F.coalesce((x < 0) | F.isnan(x) | (x == float("inf")), F.lit(False))
    bad = F.lit(False)
    for x in wrong.values():
        bad = bad | x
    return usage.withColumn("is_valid", ~bad).withColumns({c: F.when(x, F.lit(0)).otherwise(F.col(c)).cast(usage.schema[c].dataType) for c, x in wrong.items()})


def admitted(usage: DataFrame) -> DataFrame:
    """Rows that the archive takes: no negative fact or time, and a client and a model that aren't empty."""
    facts = [c for c in ("ts_ms", "input", "output", "cache_read", "cache_write", "reasoning", "message_count", "duration_ms", "reported_nanos") if c in usage.columns]
    good = (F.trim("client") != "") & (F.trim("model") != "")
    for c in facts:
        good = good & (F.coalesce(F.col(c), F.lit(0)) >= 0)
    return usage.where(good)


def active(usage: DataFrame) -> DataFrame:
    """Buckets with tokens, messages, turns or cost."""
    some = [F.coalesce(F.col(c), F.lit(0)) > 0 for c in ("tokens", "messages", "turns", "cost_nanos") if c in usage.columns]
    hit = F.lit(False)
    for x in some:
        hit = hit | x
    return usage.where(hit)


def headless(usage: DataFrame, roots: list[str]) -> DataFrame:
    """Rows of files below the roots have the agent headless where they name none."""
    inside = F.lit(False)
    for root in roots:
        inside = inside | F.col("path").startswith(root.rstrip("/") + "/")
    return usage.withColumn("agent", F.when(inside, F.coalesce(F.nullif(F.col("agent"), F.lit("")), F.lit("headless"))).otherwise(F.col("agent")))


#: Of more ranges than this a sorted table of them is joined by bins; a plan of so many comparisons is still small.
INLINE_RANGES = 64


def outside_ranges(usage: DataFrame, ranges: list[tuple[int, int]], time: str = "ts_ms") -> DataFrame:
    """Without rows in any half-open range of the time. Ranges are merged first; few make one predicate, many a table
    whose ranges are dealt over the days they touch, so that a row meets those of its own day alone."""
    merged: list[list[int]] = []
    for start, end in sorted(x for x in ranges if x[0] < x[1]):
        if merged and start <= merged[-1][1]:
            merged[-1][1] = max(end, merged[-1][1])
        else:
            merged.append([start, end])
    if len(merged) <= INLINE_RANGES:
        inside = F.lit(False)
        for start, end in merged:
            inside = inside | ((F.col(time) >= start) & (F.col(time) < end))
        return usage.where(~F.coalesce(inside, F.lit(False)))
    day = 86_400_000
    table = usage.sparkSession.createDataFrame(merged, "a__ long, b__ long")
    table = table.withColumn("day__", F.explode(F.expr(f"sequence(floor(a__ / {day}), floor((b__ - 1) / {day}))")))
    own = F.floor(F.col(time) / F.lit(day))
    return usage.join(table, (own == F.col("day__")) & (F.col(time) >= F.col("a__")) & (F.col(time) < F.col("b__")), "left_anti")
