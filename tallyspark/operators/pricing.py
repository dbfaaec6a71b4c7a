"""Tiered prices: tokens split into bands, rates inherited upwards, costs in nano-dollars, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where the bands of each bucket begin.
INPUT_BANDS, READ_BANDS, WRITE_BANDS = (0, 128_000, 200_000, 256_000, 272_000), (0, 200_000, 272_000), (0, 200_000)
LONG_CONTEXT = 272_000

#: Nano-dollars a token: (input bands, output bands, cache read bands, cache write bands); None where no rate is quoted.
CATALOGUE = {
    "gpt-5.4": ((2500, None, None, None, 5000), (15000, None, None, None, 22500), (250, None, 500), (0, None)),
    "claude-opus-4-6": ((5000, None, 10000, None, None), (25000, None, 37500, None, None), (500, 1000, None), (6250, 12500)),
    "gemini-3-pro": ((2000, None, 4000, None, None), (12000, None, 18000, None, None), (200, 400, None), (None, None)),
    "claude-sonnet-4-5": ((3000, 3500, 6000, None, None), (15000, None, 22500, 23000, None), (300, 600, 700), (3750, 7500)),
}
#: Models whose long requests have the highest rates for all tokens.
WHOLE_REQUEST = ("gpt-5.4",)
_NAMES = [f"{k}_{t}" for k, bands in (("input", INPUT_BANDS), ("output", INPUT_BANDS), ("read", READ_BANDS), ("write", WRITE_BANDS)) for t in bands]


def prices(spark: SparkSession, catalogue: dict = CATALOGUE) -> DataFrame:
    """A row per model, a column per bucket and band; a catalogue's size doesn't depend on the data."""
    rows = [(m, m in WHOLE_REQUEST, *(x for bands in rates for x in bands)) for m, rates in catalogue.items()]
    return spark.createDataFrame(rows, "priced_model string, whole_request boolean, " + ", ".join(f"{n} long" for n in _NAMES))


def band(tokens: Column, low: int, high: int | None) -> Column:
    """Tokens of a request between two thresholds; one exactly at a threshold stays below it."""
    top = F.least(tokens, F.lit(high).cast("long")) if high else tokens
    return F.greatest(top - F.lit(low), F.lit(0).cast("long"))


def ladder(kind: str, bands: tuple) -> list[Column]:
    """The rate of each band: its own, or that of the last band below that has a valid one, else 0."""
    valid = [F.when(F.col(f"{kind}_{t}") >= 0, F.col(f"{kind}_{t}")) for t in bands]
    return [F.coalesce(*reversed(valid[: i + 1]), F.lit(0).cast("long")) for i in range(len(bands))]


def filled(rates: tuple) -> list[int]:
    """ladder() of one quoted row."""
    out: list[int] = []
    for r in rates:
        out.append(r if r is not None and r >= 0 else out[-1] if out else 0)
    return out


def rate_card(spark: SparkSession, catalogue: dict = CATALOGUE) -> DataFrame:
    """prices() with each band's rate filled, and which buckets have a base rate."""
    rows = []
    for model, rates in catalogue.items():
        zeros = all(not x for bands in rates for x in bands) and any(x == 0 for bands in rates for x in bands)
        rows.append((model, model in WHOLE_REQUEST, *(x for bands in rates for x in filled(bands)), *(zeros or (bands[0] is not None and bands[0] >= 0) for bands in rates)))
    return spark.createDataFrame(rows, "priced_model string, whole_request boolean, " + ", ".join(f"{n} long" for n in _NAMES) + ", has_input boolean, has_output boolean, has_read boolean, has_write boolean")


def banded_cost(tokens: Column, kind: str, bands: tuple) -> Column:
    parts = [band(tokens, low, high) * F.col(f"{kind}_{low}") for low, high in zip(bands, (*bands[1:], None), strict=True)]
    return sum(parts[1:], parts[0])


def _buckets() -> tuple[Column, Column, Column, Column]:
    n = lambda c: F.greatest(F.coalesce(F.col(c), F.lit(0)), F.lit(0)).cast("long")
    return n("input"), n("output") + n("reasoning"), n("cache_read"), n("cache_write")


def estimate() -> Column:
    """Nano-dollars of a request from its buckets and its model's filled rates."""
    i, o, r, w = _buckets()
    marginal = banded_cost(i, "input", INPUT_BANDS) + banded_cost(o, "output", INPUT_BANDS) + banded_cost(r, "read", READ_BANDS) + banded_cost(w, "write", WRITE_BANDS)
    high_in, high_out, high_read = F.col("input_272000"), F.col("output_272000"), F.col("read_272000")
    scaled = F.when(F.col("input_0") > 0, F.floor(w * F.col("write_0") * high_in / F.col("input_0"))).otherwise(w * F.col("write_0")).cast("long")
    long = i * high_in + o * high_out + r * high_read + scaled
    short = i * F.col("input_0") + o * F.col("output_0") + r * F.col("read_0") + w * F.col("write_0")
    return F.when(F.col("whole_request"), F.when(i + r + w > LONG_CONTEXT, long).otherwise(short)).otherwise(marginal)


def covered() -> Column:
    """Every bucket with tokens has a base rate; a row that quotes only zeros covers everything."""
    i, o, r, w = _buckets()
    has = lambda tokens, kind: (tokens == 0) | F.col(f"has_{kind}")
    return F.coalesce(has(i, "input") & has(o, "output") & has(r, "read") & has(w, "write") & F.col("priced_model").isNotNull(), F.lit(False))


def priced(usage: DataFrame, catalogue: dict = CATALOGUE) -> DataFrame:
    """usage with cost_nanos (what was reported, else the estimate, 0 without a price) and is_covered."""
    both = usage.join(F.broadcast(rate_card(usage.sparkSession, catalogue)), F.col("model") == F.col("priced_model"), "left")
    reported = F.col("cost_source") == "reported"
    cost = F.when(reported, F.col("reported_nanos")).otherwise(F.coalesce(estimate(), F.lit(0).cast("long")))
    return both.select(*usage.columns, cost.cast("long").alias("cost_nanos"), (reported | covered()).alias("is_covered"))


def exclusions(usage: DataFrame, catalogue: dict = CATALOGUE) -> DataFrame:
    """(provider, model, messages, tokens, reason) of what no price covers."""
    tokens = sum(F.col(c) for c in ("output", "cache_read", "cache_write", "reasoning")) + F.col("input")
    own = priced(usage, catalogue).where(~F.col("is_covered"))
    known = F.col("model").isin(*catalogue) if catalogue else F.lit(False)
    return own.groupBy("provider", "model").agg(F.sum("message_count").cast("long").alias("messages"), F.sum(tokens).alias("tokens"), F.max(F.when(known, "missing rate").otherwise("unknown model")).alias("reason"))


RATES = ("input", "output", "cache")


def borrowed(rows: DataFrame) -> DataFrame:
    """rows (model, hint, rates) of a provider's own, with missing rates from the model's row without a hint, if all rates
    that both quote agree to 1e-9."""
    plain = rows.where("hint is null").select("model", *(F.col(r).alias(f"plain_{r}") for r in RATES))
    own = rows.where("hint is not null").join(plain, "model", "left")
    agree = F.lit(True)
    for r in RATES:
        agree = agree & (F.col(r).isNull() | F.col(f"plain_{r}").isNull() | (F.abs(F.col(r) - F.col(f"plain_{r}")) <= 1e-9))
    return own.select("model", "hint", *(F.coalesce(r, F.when(agree, F.col(f"plain_{r}"))).alias(r) for r in RATES))


def with_surcharge(priced_rows: DataFrame, provider: str) -> DataFrame:
    """Estimates of one hosted provider's requests cost 1.1 times as much, where they cost anything."""
    more = (F.col("provider") == provider) & (F.col("cost_source") != "reported") & (F.col("cost_nanos") > 0)
    return priced_rows.withColumn("cost_nanos", F.when(more, F.floor(F.col("cost_nanos") * 11 / 10).cast("long")).otherwise(F.col("cost_nanos")))


def with_custom(usage: DataFrame, custom: dict[str, int], otherwise: int) -> DataFrame:
    """Prices that the user set win over all others: (.., nanos) of the input at a rate a token."""
    rate = F.lit(otherwise)
    for model, nanos in custom.items():
        rate = F.when(F.col("model") == model, nanos).otherwise(rate)
    return usage.withColumn("nanos", F.col("input") * rate)


def by_policy(usage: DataFrame, policy: str, estimate: str) -> DataFrame:
    """nanos by a client's policy: always the estimate, the estimate where nothing or where nothing authoritative was
    reported, or only what was reported."""
    told, guess, rule = F.col("reported_nanos"), F.col(estimate), F.col(policy)
    return usage.withColumn(
        "nanos",
        F.when(rule == "reprice", guess).when(rule == "fill_non_positive", F.when(told > 0, told).otherwise(guess)).when(rule == "fill_non_authoritative", F.when(F.col("cost_source") == "reported", told).otherwise(guess)).otherwise(told).cast("long"),
    )
