"""Which source counts where several tell of one request; spellings that mean one model."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names

#: The tiers of one client's records, the best first.
TIERS = ("chat", "inference", "agent_turn", "agent_summary")
#: The order in which sources of one client are read, where it isn't that of their files.
LANES = {"opencode": ("sqlite", "json"), "zcode": ("sqlite", "jsonl"), "workbuddy": ("detailed", "fallback"), "devin": ("cli", "desktop"), "grok": ("unified", "legacy")}


def tiered(rows: DataFrame, tiers: tuple = TIERS) -> DataFrame:
    """rows (tier, trace, response, ...) less those that a better tier tells of under the same trace or response."""
    rank = reduce(lambda x, i: F.when(F.col("tier") == tiers[i], i).otherwise(x), range(len(tiers)), F.lit(len(tiers)))
    own = rows.withColumn("rank__", rank)
    for key in ("trace", "response"):
        best = own.where(F.col(key).isNotNull()).groupBy(key).agg(F.min("rank__").alias(f"best_{key}__"))
        own = own.join(best, key, "left")
    seen = F.least(F.col("best_trace__"), F.col("best_response__"))
    return own.where(seen.isNull() | (F.col("rank__") <= seen)).drop("rank__", "best_trace__", "best_response__").select(*rows.columns)


def merged_duplicates(rows: DataFrame, key: str = "dedup_key", order: str = "event_id") -> DataFrame:
    """One row per key: greatest counts (input with the cached tokens in it), first start, last end, and the agent told
    directly, of several the least. duration_ms is from start to end, or the longest told if that is more."""
    agent = F.nullif(F.col("agent"), F.lit(""))
    best = F.min(F.when(agent.isNotNull(), F.struct((~F.col("agent_direct")).alias("d"), agent.alias("agent"))))
    counts = ("output", "cache_read", "cache_write", "reasoning")
    rest = [c for c in rows.columns if c not in (*counts, key, "input", "start_ms", "end_ms", "duration_ms", "agent", "agent_direct")]
    found = rows.groupBy(key).agg(
        F.max("input").alias("whole"), *(F.max(c).alias(c) for c in counts), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.max("duration_ms").alias("longest"), best.alias("best"), *(F.min_by(c, order).alias(c) for c in rest)
    )
    span = F.when(F.col("end_ms") > F.col("start_ms"), F.col("end_ms") - F.col("start_ms"))
    found = found.withColumn("input", F.col("whole") - F.least("cache_read", "whole")).withColumn("duration_ms", F.greatest(span, F.col("longest")))
    return found.withColumn("agent", F.col("best.agent")).withColumn("agent_direct", F.coalesce(~F.col("best.d"), F.lit(False))).select(*rows.columns)


def lane_order(rows: DataFrame, lane: str, client: str, key: str = "dedup_key", order: str = "event_id") -> DataFrame:
    """The first row of each key by the client's order of sources; rows without a key all stay."""
    rank = reduce(lambda x, i: F.when(F.col(lane) == LANES[client][i], i).otherwise(x), range(len(LANES[client])), F.lit(99))
    w = Window.partitionBy(F.coalesce(F.nullif(F.col(key), F.lit("")), F.concat(F.lit("\0"), F.col(order).cast("string")))).orderBy(rank, order)
    return rows.withColumn("n__", F.row_number().over(w)).where("n__ = 1").drop("n__")


def not_covered(rows: DataFrame, covered: DataFrame, *forms: Column) -> DataFrame:
    """rows whose key is, in none of its forms, among covered (key): the forms are united and joined once."""
    own = rows.withColumn("id__", F.monotonically_increasing_id())
    keys = own.select("id__", F.explode(F.array_compact(F.array(*forms))).alias("key"))
    found = keys.join(covered.select("key").distinct(), "key", "left_semi").select("id__").distinct()
    return own.join(found, "id__", "left_anti").drop("id__")


def unique_or_null(rows: DataFrame, evidence: DataFrame, key: str, value: str) -> DataFrame:
    """rows with value filled from evidence (key, value) where all evidence of the key agrees; contradictions fill nothing."""
    one = evidence.where(F.col(value).isNotNull()).groupBy(key).agg(F.min(value).alias("a__"), F.max(value).alias("b__")).where("a__ = b__")
    return rows.join(one.select(key, "a__"), key, "left").withColumn(value, F.coalesce(value, "a__")).drop("a__").select(*rows.columns)


def retained(cached: DataFrame, parsed: DataFrame, key: str = "dedup_key") -> DataFrame:
    """parsed and those rows of cached with a stable key that a rewritten file no longer holds."""
    own = cached.where(F.col(key).isNotNull()).join(parsed.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")
    return parsed.unionByName(own.select(*parsed.columns))


def alias_fold(model: Column, aliases: dict[str, str]) -> Column:
    """A model's name for display: one hop through the aliases, dots and dashes being one; never for prices."""
    plain = names.model_normalize
    folded = plain(model)
    pairs = [(plain(F.lit(a)), plain(F.lit(b))) for a, b in list(aliases.items())[:4096]]
    out = folded
    for a, b in reversed(pairs):
        out = F.when((a != b) & (a != "") & (b != "") & (F.replace(folded, F.lit("."), F.lit("-")) == F.replace(a, F.lit("."), F.lit("-"))), b).otherwise(out)
    return out


def is_gateway(model: Column, provider: Column) -> Column:
    """Whether a model is served through a gateway: by its name's beginning or by the provider."""
    return F.lower(model).rlike("^(hf:|accounts/fireworks/|accounts/together/)") | F.lower(provider).isin("synthetic", "glhf", "synthetic.new", "octofriend")


def gateway_model(model: Column) -> Column:
    """The model behind the gateway: without host, organisation and path; lower-cased."""
    x = F.lower(model)
    hosted = F.regexp_replace(F.regexp_replace(x, "^hf:", ""), "^[^/]*/", "")
    return F.when(x.startswith("hf:"), hosted).when(x.rlike("^accounts/.*?/models/"), F.regexp_replace(x, "^accounts/.*?/models/", "")).otherwise(x)


def gateway_rows(rows: DataFrame) -> DataFrame:
    hit = F.coalesce(is_gateway(F.col("model"), F.col("provider")), F.lit(False))
    named = F.when(hit & ((F.col("provider") == "") | (F.lower("provider") == "unknown")), F.lit("synthetic")).otherwise(F.col("provider"))
    return rows.withColumn("provider", named).withColumn("model", F.when(hit, gateway_model(F.col("model"))).otherwise(F.col("model")))


def version_separators(model: Column) -> Column:
    """A dash between single digits becomes a dot (4-6 is 4.6); dates and longer numbers stay."""
    return F.regexp_replace(model, r"(?<![0-9])([0-9])-(?=[0-9](?![0-9]))", "$1.")
