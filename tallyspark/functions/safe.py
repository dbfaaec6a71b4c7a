"""Numbers that can't overflow or go astray, and calendar keys in a named zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MOST = 9223372036854775807


def sat_sum(x: Column) -> Column:
    """Sum of longs that stops at the largest and smallest long; 0 of nothing."""
    exact = F.coalesce(F.sum(x.cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))
    return F.greatest(F.least(exact, F.lit(MOST).cast("decimal(38,0)")), F.lit(-MOST - 1).cast("decimal(38,0)")).cast("long")


def nonneg(x: Column) -> Column:
    return F.greatest(F.coalesce(x, F.lit(0).cast("long")), F.lit(0).cast("long"))


def finite(x: Column) -> Column:
    """x, or 0 where it is null, NaN or infinite."""
    bad = x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.when(bad, F.lit(0.0)).otherwise(x)


def zone_time(ts_ms: Column, zone: str = "UTC") -> Column:
    return F.from_utc_timestamp(F.timestamp_millis(ts_ms), zone)


def day_key(ts_ms: Column, zone: str = "UTC") -> Column:
    return F.date_format(zone_time(ts_ms, zone), "yyyy-MM-dd")


def hour_key(ts_ms: Column, date: Column, zone: str = "UTC") -> Column:
    """The zone's hour; rows without a time count at midnight of their date."""
    return F.when(ts_ms > 0, F.date_format(zone_time(ts_ms, zone), "yyyy-MM-dd HH:00")).otherwise(F.concat(date, F.lit(" 00:00")))


def month_key(date: Column) -> Column:
    """Month of a date text that can be read; null otherwise."""
    return F.date_format(F.try_to_date(date, "yyyy-MM-dd"), "yyyy-MM")


def floor_div(x: Column, by: int) -> Column:
    return F.floor(x / F.lit(by)).cast("long") if by < 1 else ((x - F.pmod(x, F.lit(by))) / by).cast("long")


def sorted_text(x: Column) -> Column:
    """Distinct values, sorted, joined by comma and blank."""
    return F.array_join(F.array_sort(F.collect_set(x)), ", ")


def identity(*parts: Column) -> Column:
    """SHA-256 over parts that each carry their length, so that no two lists of parts meet."""
    pieces = [F.concat(F.lpad(F.hex(F.octet_length(p)), 16, "0"), p) for p in (F.coalesce(p.cast("string"), F.lit("")) for p in parts)]
    return F.sha2(F.concat(*pieces), 256)
