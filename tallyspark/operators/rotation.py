"""Account rotation: quotas that run out, running tasks, which account takes a request, and small classifications."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DRAIN_PERCENT, FRESH_MS, SETTLING_MS = 1.0, 15_000, 300_000
#: Where a plan's multiplier may stand, in order of precedence.
MULTIPLIER_PATHS = (
    "$.rate_limit_tier", "$.rateLimitTier", "$.usage_multiplier", "$.usageMultiplier", "$.rate_limit_multiplier", "$.rateLimitMultiplier",
    "$.organization_rate_limit_tier", "$.organizationRateLimitTier", "$.oauthAccount.organizationRateLimitTier", "$.claudeAiOauth.rateLimitTier",
)


def percent_remaining(used: Column) -> Column:
    """What is left of 100; a share that isn't a number from 0 to 100 counts as all used."""
    return F.when((used >= 0) & (used <= 100), 100.0 - used).otherwise(0.0)


def quota_drain(windows: DataFrame, now_ms: Column) -> DataFrame:
    """(account, reset_at) of accounts with a window of the whole account that has at most 1 % left and isn't over.

    windows: (account, scope, percent_used, resets_at). The latest reset counts; one that isn't told wins over all (null).
    """
    own = windows.where(F.col("scope").isNull() & (F.col("resets_at").isNull() | (F.col("resets_at") >= now_ms)))
    own = own.where(percent_remaining(F.col("percent_used")) <= DRAIN_PERCENT)
    return own.groupBy("account").agg(F.when(~F.bool_or(F.col("resets_at").isNull()), F.max("resets_at")).alias("reset_at"))


def task_activity(tasks: DataFrame, now_ms: Column) -> DataFrame:
    """(generation, tasks, oldest, state) of workers' running tasks (generation, observed_at, thread, account, started_at).

    A worker that was last seen too long ago, or in the future, is stale or future and its tasks aren't counted; a
    thread that two workers tell differently is a conflict of both.
    """
    age = now_ms - F.col("observed_at")
    state = F.when(age > FRESH_MS, "stale").when(age < -FRESH_MS, "future").otherwise("fresh")
    own = tasks.withColumn("state", state)
    told = own.where("state = 'fresh'").groupBy("thread").agg(F.min(F.struct("account", "started_at")).alias("a"), F.max(F.struct("account", "started_at")).alias("b"))
    own = own.join(told.where("a <> b").select("thread", F.lit(True).alias("clash")), "thread", "left")
    fresh = F.col("state") == "fresh"
    grouped = own.groupBy("generation").agg(
        F.count_if(fresh).alias("tasks"), F.min(F.when(fresh, F.col("started_at"))).alias("oldest"),
        F.when(F.bool_or(F.col("state") == "future"), "future").when(F.bool_or(F.col("state") == "stale"), "stale").when(F.bool_or(fresh & F.col("clash").isNotNull()), "conflict").otherwise("fresh").alias("state"),
    )
    return grouped


def route(requests: DataFrame, accounts: DataFrame) -> DataFrame:
    """(request, account): the thread's owner if it may be used, else for a thread without owner the first available
    account by priority; null for none.

    requests: (request, owner or null); accounts: (account, priority, available, excluded). Accounts are few and are
    counted by their settings, so the best one is a single broadcast row.
    """
    usable = accounts.where("available and not excluded")
    best = usable.agg(F.min_by("account", F.struct("priority", "account")).alias("first"))
    owners = usable.select(F.col("account").alias("owner"), F.lit(True).alias("usable"))
    found = requests.join(owners, "owner", "left").crossJoin(F.broadcast(best))
    return found.select("request", F.when(F.col("owner").isNull(), F.col("first")).when(F.col("usable"), F.col("owner")).alias("account"))


def usage_limit(payload: Column) -> Column:
    """structured, message or null: what a reply of the provider says about a used-up quota."""
    doc = F.try_parse_json(payload)
    get = lambda p: F.try_variant_get(doc, p, "string")
    message = F.lower(F.coalesce(get("$.error.message"), get("$.message"), get("$.error")))
    failed = (get("$.type") == "error") | F.try_variant_get(doc, "$.error", "variant").isNotNull()
    return F.when(get("$.error.type") == "usage_limit_reached", "structured").when(failed & message.rlike("usage limit|usage_limit"), "message")


def plan_multiplier(metadata: Column) -> Column:
    """5 or 20 from the first place that names one, as number or in a text such as default_claude_max_20x; else null."""
    doc = F.try_parse_json(metadata)
    said = [F.regexp_extract(F.try_variant_get(doc, p, "string"), r"(?:^|[^0-9])(5|20)(?:x|$|\.0*$)", 1) for p in MULTIPLIER_PATHS]
    return F.coalesce(*(F.nullif(x, F.lit("")) for x in said)).cast("int")


def settling(managed: Column, created_ms: Column, now_ms: Column) -> Column:
    """A managed account signed in within the last five minutes; one without a time isn't."""
    return F.coalesce(managed & created_ms.isNotNull() & (F.greatest(now_ms - created_ms, F.lit(0)) <= SETTLING_MS), F.lit(False))


def account_order(accounts: DataFrame, ranks: DataFrame) -> DataFrame:
    """accounts with place: those with a stored rank (account, rank) first, then the others by name."""
    own = accounts.join(ranks, "account", "left")
    return own.withColumn("place", F.row_number().over(Window.orderBy(F.col("rank").asc_nulls_last(), "account")))
