"""Durable history: identities, which revision counts, minute rollups and their signed updates, forgetting."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import safe

MEASURES = ("input", "output", "cache_read", "cache_write", "reasoning", "cost_nanos", "message_count")
KEYS = ("client", "provider", "model", "cost_source")


def identify(usage: DataFrame) -> DataFrame:
    """Adds fact_id: from the durable key where there is one, else from the facts themselves."""
    facts = safe.identity(*(F.col(c) for c in ("client", "provider", "model", "session_id", "ts_ms", "input", "output", "cache_read", "cache_write", "reasoning")))
    durable = safe.identity(F.lit("key"), F.col("client"), F.col("dedup_key"))
    return usage.withColumn("fact_id", F.when(F.col("dedup_key").isNotNull(), durable).otherwise(facts))


def canonical(revisions: DataFrame, most: int = 4) -> DataFrame:
    """Of each identity at most so many revisions, the one that counts first: reported costs, then the oldest."""
    w = Window.partitionBy("client", F.coalesce("dedup_key", F.concat(F.lit("\0"), F.col("event_id").cast("string")))).orderBy((F.col("cost_source") == "reported").desc(), "event_id")
    return revisions.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def rollup(priced: DataFrame, step_ms: int = 60_000) -> DataFrame:
    """Sums by minute and for all time (period 1 and 0), with the number of events; the minutes are summed for all time."""
    bucket = (safe.floor_div(F.col("ts_ms"), step_ms) * step_ms).alias("bucket_ms")
    sums = [safe.sat_sum(F.col(c)).alias(c) for c in MEASURES]
    minutes = priced.groupBy(bucket, *KEYS).agg(*sums, F.count(F.lit(1)).alias("events"))
    both = minutes.withColumn("period", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("bucket_ms", F.when(F.col("period") == 1, F.col("bucket_ms")).otherwise(F.lit(0).cast("long")))
    return both.groupBy("period", "bucket_ms", *KEYS).agg(*sums, F.sum("events").alias("events"))


def apply_changes(rollups: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """rollups less those of the rows before a change, plus those after it; rows without events go."""
    minus = rollup(before).withColumns({c: -F.col(c) for c in (*MEASURES, "events")})
    keys = ["period", "bucket_ms", *KEYS]
    whole = rollups.unionByName(minus).unionByName(rollup(after))
    return whole.groupBy(*keys).agg(*(safe.sat_sum(F.col(c)).alias(c) for c in (*MEASURES, "events"))).where("events <> 0")


def hashes(revisions: DataFrame, version: int = 1) -> DataFrame:
    """Adds accounting_hash, of 15 parts of a fact, and revision_hash, of it and the cost if that is reported."""
    flag = lambda c: F.col(c).cast("int").cast("string")
    parts = [F.lit("accounting-fact"), F.lit(str(version)), *(F.col(c) for c in ("client", "provider", "model", "ts_ms", "input", "output", "cache_read", "cache_write", "reasoning")), F.coalesce("duration_ms", F.lit(-1)), F.col("message_count"), flag("is_turn_start"), flag("model_conflicted")]
    cost = F.when(F.col("cost_source") == "reported", F.col("reported_nanos").cast("string")).otherwise("no-reported-cost")
    own = revisions.withColumn("accounting_hash", safe.identity(*parts))
    return own.withColumn("revision_hash", safe.identity(F.lit("revision-v1"), F.lit(str(version)), F.col("accounting_hash"), cost))


def first_observation(revisions: DataFrame, most: int = 4) -> DataFrame:
    """Of each event (event) the revisions that are kept, with selected: the accounting that was seen first, by hash if
    several were; of its rows reported costs, then the generation, then the hash. At most so many are kept: the selected
    one and the oldest others."""
    own = revisions.withColumn("first__", F.min("generation").over(Window.partitionBy("event", "accounting_hash")))
    reported = (F.col("cost_source") != "reported").cast("int")
    best = Window.partitionBy("event").orderBy("first__", "accounting_hash", reported, "generation", "revision_hash")
    own = own.withColumn("selected", F.row_number().over(best) == 1)
    kept = Window.partitionBy("event").orderBy(F.col("selected").desc(), "generation", "revision_hash")
    return own.withColumn("place", F.row_number().over(kept)).where(F.col("place") <= most).drop("first__", "place")


_COUNTS = ("input", "output", "cache_read", "cache_write", "reasoning", "message_count")


def completed(revisions: DataFrame) -> DataFrame:
    """(event, revision_hash, conflict) of streamed records, whose counts only grow: generation by generation, the revision
    that extends all others of its generation and the one selected before; else it is a conflict and the one before stays.

    revisions: (event, revision_hash, generation, cost_rank, reported_nanos, duration_ms, same, is_turn_start, ...counts),
    where same stands for all that mustn't change. Null counts are 0, a null turn start is none. A generation is reduced
    to its least and greatest values and two of its revisions, so that only an event's generations, not its revisions,
    meet in a task, and nothing is compared in pairs.
    """
    numbers = (*_COUNTS, "turn")
    of = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    is_rank = lambda n: F.coalesce(F.col("cost_rank") == n, F.lit(False))
    turn = F.coalesce(F.col("is_turn_start"), F.lit(False)).cast("long")
    timed = F.struct(F.col("duration_ms").isNotNull().cast("long").alias("has"), of("duration_ms").alias("ms"))
    row = F.struct(F.col("revision_hash").cast("string").alias("hash"), "same", *(of(c).alias(c) for c in _COUNTS), turn.alias("turn"), timed.alias("timed"), is_rank(0).alias("free"), is_rank(2).alias("told"), F.col("reported_nanos").alias("nanos"))
    rows = revisions.select(F.col("event").cast("string").alias("event"), "generation", row.alias("r"))

    # a revision that extends all others has the greatest of each value: it is the first in this order if there is one
    down = [F.bitwise_not(F.col(f"r.{c}")) for c in (*numbers, "timed.has", "timed.ms")]
    order = F.struct(*(c.alias(f"k{i}") for i, c in enumerate(down)), (~F.col("r.told")).alias("untold"), "r")
    alike = lambda c, n: F.min(c).eqNullSafe(F.max(c)) & F.count(c).isin(F.lit(0).cast("long"), n)
    nanos, ranked = F.when(~F.col("r.free"), F.col("r.nanos")), F.count_if(~F.col("r.free"))
    bounds = [f(f"r.{c}").alias(f"{name}_{c}") for c in (*numbers, "timed") for f, name in ((F.min, "low"), (F.max, "high"))]
    groups = rows.groupBy("event", "generation").agg(
        F.min(order)["r"].alias("best"), F.min("r").alias("first"), *bounds, alike("r.same", F.count(F.lit(1))).alias("one"),
        F.bool_and("r.free").alias("free"), F.bool_and("r.told").alias("told"), alike(nanos, ranked).alias("level"),
    )
    greatest = [F.col(f"best.{c}") == F.col(f"high_{c}") for c in (*numbers, "timed")]
    extends_all = F.col("one") & reduce(and_, greatest) & (F.col("free") | (F.col("best.told") & F.col("level")))
    groups = groups.select("event", F.struct("generation", "one", "told", "level", *(f"low_{c}" for c in (*numbers, "timed")), F.when(extends_all, F.col("best")).alias("top"), "first").alias("g"))

    def step(state, g):
        now = state["now"]
        cost = now["free"] | (g["told"] & g["level"] & g["first"]["nanos"].eqNullSafe(now["nanos"]))
        grown = [g[f"low_{c}"] >= now[c] for c in (*numbers, "timed")]
        fits = now.isNull() | (g["one"] & g["first"]["same"].eqNullSafe(now["same"]) & reduce(and_, grown) & cost)
        chosen = F.when(fits, F.coalesce(g["top"], now, g["first"])).otherwise(now)
        return F.struct(chosen.alias("now"), (state["conflict"] | ~fits | g["top"].isNull()).alias("conflict"))

    kind = rows.schema["r"].dataType
    start = F.struct(F.lit(None).cast(kind).alias("now"), F.lit(False).alias("conflict"))
    found = groups.groupBy("event").agg(F.sort_array(F.collect_list("g")).alias("all")).select("event", F.aggregate("all", start, step).alias("z"))
    return found.select("event", F.col("z.now.hash").alias("revision_hash"), F.col("z.conflict").alias("conflict"))


def resolve(fresh: DataFrame, identities: DataFrame) -> DataFrame:
    """fresh (identity, confidence, alias, accounting) with event and how it was found: an identity that is known is the
    same event; else an alias with equal accounting attaches to its event, one with other accounting collides and makes
    a new event; else the only known event with equal accounting and another confidence is merged; else it is new.

    identities: (event, identity, confidence, alias, accounting).
    """
    by_id = identities.groupBy("identity").agg(F.min("event").alias("same"))
    by_alias = identities.where("alias is not null").groupBy("alias").agg(F.min(F.struct("event", "accounting")).alias("a")).select("alias", F.col("a.event").alias("kin"), F.col("a.accounting").alias("told"))
    twins = identities.groupBy("accounting").agg(F.count_distinct("event").alias("n"), F.min("event").alias("twin"), F.max("confidence").alias("trust")).where("n = 1").drop("n")
    own = fresh.join(by_id, "identity", "left").join(by_alias, "alias", "left").join(twins, "accounting", "left")
    attached, apart = F.col("kin").isNotNull() & F.col("told").eqNullSafe(F.col("accounting")), F.col("twin").isNotNull() & (F.col("trust") != F.col("confidence"))
    how = F.when(F.col("same").isNotNull(), "known").when(attached, "alias").when(F.col("kin").isNotNull(), "collision").when(apart, "twin").otherwise("new")
    event = F.when(how == "known", F.col("same")).when(how == "alias", F.col("kin")).when(how == "twin", F.col("twin")).otherwise(F.col("identity"))
    return own.select(*fresh.columns, event.alias("event"), how.alias("how"))


def conflicts(revisions: DataFrame) -> DataFrame:
    """(event, conflict): whether an event's revisions differ in accounting, streamed ones excepted, or in reported cost."""
    cost = F.when(F.col("cost_source") == "reported", F.col("reported_nanos"))
    streamed = F.bool_and((F.col("client") == "claude") | F.col("client").startswith("cc-mirror/"))
    differ = lambda c: F.coalesce(F.min(c) != F.max(c), F.lit(False))
    return revisions.groupBy("event").agg(((differ("accounting_hash") & ~streamed) | differ(cost)).alias("conflict"))


def capture(state: DataFrame, batch: DataFrame) -> DataFrame:
    """(client, first_ms, last_ms): what is known of each client's time of capture, widened by a batch's rows."""
    own = batch.groupBy("client").agg(F.min("ts_ms").alias("first_ms"), F.max("ts_ms").alias("last_ms"))
    return state.unionByName(own).groupBy("client").agg(F.min("first_ms").alias("first_ms"), F.max("last_ms").alias("last_ms"))


def forget(priced: DataFrame, ranges: list[tuple[int, int]]) -> DataFrame:
    """The rollups rebuilt without the events of the ranges."""
    from . import filters

    return rollup(filters.outside_ranges(priced, ranges))


def counters(before: DataFrame, after: DataFrame) -> DataFrame:
    """(events, tokens, reported, added, removed) of the archive after a batch, from events (fact_id, tokens, cost_source)."""
    both = before.select("fact_id", F.lit(1).alias("b")).join(after.select("fact_id", "tokens", "cost_source", F.lit(1).alias("a")), "fact_id", "full_outer")
    return both.agg(F.count("a").alias("events"), safe.sat_sum(F.col("tokens")).alias("tokens"), F.count_if(F.col("cost_source") == "reported").alias("reported"), F.count_if(F.col("b").isNull()).alias("added"), F.count_if(F.col("a").isNull()).alias("removed"))


def merge(stored: DataFrame, fresh: DataFrame, key: str = "fact_id", order: str = "event_id") -> DataFrame:
    """stored with fresh rows in place of those of the same identity: replays change nothing."""
    w = Window.partitionBy(key).orderBy(F.col(order).desc())
    newest = fresh.withColumn("n__", F.row_number().over(w)).where("n__ = 1").drop("n__")
    return stored.join(newest, key, "left_anti").unionByName(newest.select(*stored.columns))


def not_seen(sources: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Sources whose (source, revision) isn't checkpointed as complete."""
    return sources.join(checkpoints.where("complete"), ["source", "revision"], "left_anti")
