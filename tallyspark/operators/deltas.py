"""Counters to increments, states carried forward, repeats numbered."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _order(keys: list[str]):
    return Window.partitionBy(*keys).orderBy("ts_ms", "event_id")


def cumulative_delta(rows: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """Increments of a counter; one that falls starts anew."""
    before = F.lag(value).over(_order(keys))
    return rows.withColumn("delta", F.when(before.isNull() | (F.col(value) < before), F.col(value)).otherwise(F.col(value) - before))


def watermark_delta(rows: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """What a total adds to the highest seen before; lower totals add nothing."""
    high = F.coalesce(F.max(value).over(_order(keys).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("delta", F.greatest(F.col(value) - high, F.lit(0)))


def forward_fill(rows: DataFrame, column: str, keys: list[str]) -> DataFrame:
    return rows.withColumn(f"{column}_filled", F.last(column, ignorenulls=True).over(_order(keys).rowsBetween(Window.unboundedPreceding, 0)))


def occurrence(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.withColumn("occurrence", F.row_number().over(Window.partitionBy(*keys).orderBy("event_id")) - 1)


def since_previous(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.withColumn("since_ms", F.greatest(F.col("ts_ms") - F.lag("ts_ms").over(_order(keys)), F.lit(0)))
