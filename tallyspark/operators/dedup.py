"""Which of several records of one fact counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_wins(usage: DataFrame, key: str = "dedup_key", order: str = "event_id", within: tuple[str, ...] = ()) -> DataFrame:
    """The first row of each key; rows without a key (null or empty) all stay."""
    own = F.nullif(F.col(key), F.lit(""))
    w = Window.partitionBy(*within, F.coalesce(own, F.concat(F.lit("\0"), F.col(order).cast("string")))).orderBy(order)
    return usage.withColumn("n__", F.row_number().over(w)).where("n__ = 1").drop("n__")


def latest(usage: DataFrame, group: str = "session_id", time: str = "ts_ms", key: str = "dedup_key") -> DataFrame:
    """The latest row of each group; of rows of one time the one with the greater key."""
    w = Window.partitionBy(group).orderBy(F.col(time).desc(), F.col(key).desc_nulls_last(), F.col("event_id").desc())
    return usage.withColumn("n__", F.row_number().over(w)).where("n__ = 1").drop("n__")


def _own_key(key: str, order: str) -> Column:
    """The key, or one of a row's own where it has none: such rows are never merged."""
    return F.coalesce(F.nullif(F.col(key), F.lit("")), F.concat(F.lit("\0"), F.col(order).cast("string")))


def max_merge(usage: DataFrame, key: str = "dedup_key", order: str = "event_id") -> DataFrame:
    """One row per key: the greatest of each count and of the duration, other columns of the first row. Rows without a key
    all stay."""
    counts = ("input", "output", "cache_read", "cache_write", "reasoning", "duration_ms")
    rest = [c for c in usage.columns if c not in counts]
    found = usage.groupBy(_own_key(key, order).alias("k__")).agg(*(F.max(c).alias(c) for c in counts), *(F.min_by(c, order).alias(c) for c in rest))
    return found.select(*usage.columns)


def reported_cost_wins(usage: DataFrame, key: str = "dedup_key", order: str = "event_id") -> DataFrame:
    """The first row of each key, with the cost of the key's first row that reports one, if there is such. Rows without a
    key all stay as they are."""
    reported = F.when(F.col("cost_source") == "reported", F.struct(F.col(order), "reported_nanos"))
    best = F.min(reported).over(Window.partitionBy(_own_key(key, order)))
    own = first_wins(usage.withColumn("best__", best), key, order)
    return own.withColumn("reported_nanos", F.coalesce("best__.reported_nanos", "reported_nanos")).withColumn("cost_source", F.when(F.col("best__").isNotNull(), "reported").otherwise(F.col("cost_source"))).drop("best__")


def not_covered_by(usage: DataFrame, other: DataFrame, *keys: str) -> DataFrame:
    return usage.join(other.select(*keys).distinct(), list(keys), "left_anti")


def multiset_anti(rows: DataFrame, taken: DataFrame, keys: list[str], order: str = "event_id") -> DataFrame:
    """rows less taken, counting: each row of taken takes one row of its key away, the first ones."""
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    counts = taken.groupBy(*keys).agg(F.count(F.lit(1)).alias("c__"))
    return rows.withColumn("n__", number).join(counts, keys, "left").where(F.col("c__").isNull() | (F.col("n__") > F.col("c__"))).drop("n__", "c__")


def within_tolerance(left: DataFrame, right: DataFrame, keys: list[str], ms: int = 1000) -> DataFrame:
    """(left_id, right_id, apart) of rows with equal keys at most ms apart: times are binned by the tolerance, so that rows
    meet in their own bin or the next, and no key's rows are all compared."""
    size = ms + 1
    a = left.select(*keys, F.col("event_id").alias("left_id"), F.col("ts_ms").alias("a"), F.expr(f"ts_ms div {size}").alias("bin"))
    b = right.select(*keys, F.col("event_id").alias("right_id"), F.col("ts_ms").alias("b"), F.expr(f"ts_ms div {size}").alias("own"))
    b = b.withColumn("bin", F.explode(F.array(F.col("own") - 1, F.col("own"), F.col("own") + 1)))
    return a.join(b, [*keys, "bin"]).where(F.abs(F.col("a") - F.col("b")) <= ms).select("left_id", "right_id", F.abs(F.col("a") - F.col("b")).alias("apart"))
