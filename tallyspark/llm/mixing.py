"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

WEIGHTS, SHARE, MOST, SEED = (5.0, 2.0, 1.0), 1.5, 2.0, 42
WORD = r"[^\x20\x09-\x0D]+"
#: Ranks have 52 bits: 4096 bins of 4096 bins of single ranks.
_BITS, _BIN = 52, 12
#: The lowest bits of a rank tell rows apart that repeat a document.
_TIE = 12


def size_of(text_col: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def measure_of(size: Column) -> Column:
    """The size measure that inclusion probabilities are proportional to: it falls with the doublings of the size, so
    that long documents are rarer. It has at most 64 values, whose index is class_of(size)."""
    return F.lit(1.0) / (class_of(size) + 1)


def class_of(size: Column) -> Column:
    return F.floor(F.log2(size + F.lit(1))).cast("int")


def rank_of(probability: Column, identity: str, place: str, seed: int = SEED) -> Column:
    """A row's Pareto rank: random odds u / (1 - u) divided by inclusion odds p / (1 - p), mapped in order to 52 bits.

    u is a hash of the document's identity, so reruns agree; a certain document (p = 1) has rank 0. The lowest bits come
    from the row's place and tell repeated rows apart.
    """
    u = (F.pmod(F.xxhash64(F.lit(seed), identity), F.lit(1 << 50)) + F.lit(0.5)) / F.lit(float(1 << 50))
    odds = u * (1 - probability) / ((1 - u) * probability)
    share = F.when(probability >= 1, F.lit(0.0)).when(probability <= 0, F.lit(1.0)).otherwise(odds / (1 + odds))
    top = F.least(F.floor(share * F.lit(float(1 << (_BITS - _TIE)))), F.lit((1 << (_BITS - _TIE)) - 1)).cast("long")
    tie = F.pmod(F.xxhash64(F.lit(seed), place), F.lit(1 << _TIE))
    return F.when(probability >= 1, F.lit(0).cast("long")).otherwise(F.shiftleft(top, _TIE) + tie)


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target): sources by code point, nulls last, weigh weights in turn; targets over most times
    the source's size stop there and the excess is shared again by weight.

    A source is at its limit if giving it and all with a larger limit per weight that much would stay within the total.
    """
    own = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    own = own.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(order) - 1) % len(weights) + 1))
    own = own.withColumn("limit", F.col("source_size") * F.lit(most)).withColumn("total", F.sum("source_size").over(Window.partitionBy()) * F.lit(share))
    rising = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("limit").over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(rising.rowsBetween(0, Window.unboundedFollowing))
    own = own.withColumn("full", before + F.col("limit") / F.col("weight") * rest <= F.col("total"))
    everyone = Window.partitionBy()
    spent = F.coalesce(F.sum(F.when(F.col("full"), F.col("limit"))).over(everyone), F.lit(0.0))
    open_weight = F.sum(F.when(~F.col("full"), F.col("weight"))).over(everyone)
    return own.select("source", "source_size", F.when(F.col("full"), F.col("limit")).otherwise((F.col("total") - spent) * F.col("weight") / open_weight).alias("target"))


def with_whole(plan: DataFrame) -> DataFrame:
    """Adds whole, the copies of every document that are certain, and need, the words still wanted after them."""
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    return plan.withColumn("whole", whole).withColumn("need", F.col("target") - F.col("whole") * F.col("source_size"))


def inclusion(sizes: DataFrame, plan: DataFrame) -> DataFrame:
    """(source, scale): a document's inclusion probability is min(1, scale * measure_of(size)), and the probabilities times
    sizes sum to the source's need.

    Classes of sizes with the largest measures become certain first: scale is need less the words of the certain
    classes, over the sum of measure times words of the others, for the fewest certain classes that leave no other above
    1. A source has at most 64 classes, so the windows are small however many documents it has.
    """
    classes = sizes.groupBy("source", class_of(F.col("size")).alias("class")).agg(F.sum("size").alias("words"))
    own = plan.select(F.col("source").alias("source_"), "need")
    classes = classes.join(own, F.col("source").eqNullSafe(F.col("source_"))).where("words > 0")
    rising = Window.partitionBy("source").orderBy("class")
    certain = F.coalesce(F.sum("words").over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum(F.col("words") / (F.col("class") + 1)).over(rising.rowsBetween(0, Window.unboundedFollowing))
    tried = classes.withColumn("scale", (F.col("need") - certain) / rest)
    fits = tried.where(F.col("scale") <= F.col("class") + 1)
    return fits.groupBy("source").agg(F.min_by("scale", "class").alias("scale")).select("source", F.greatest("scale", F.lit(0.0)).alias("scale"))


def sample_plan(sizes: DataFrame, plan: DataFrame) -> DataFrame:
    """(source, source_size, target, whole, cut): every document of the source is taken whole times, and once more if its
    rank is at most cut.

    sizes has (source, size, rank), plan the targets with whole and need. Words are summed in bins of ranks, then in bins of the bin where the target falls,
    then by single ranks; no task gets a source's rows together. cut leaves the words taken nearest to the target.
    """
    plan = common.cut(plan.withColumn("base", F.lit(0).cast("long")).withColumn("low", F.lit(0).cast("long")), "targets")
    n = plan.count()
    grown = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    near = Window.partitionBy("source").orderBy(F.abs(F.col("base") + F.col("upto") - F.col("need")), "bin")
    for width in (_BITS - _BIN, _BITS - 2 * _BIN, 0):
        own = plan.select(F.col("source").alias("source_"), "need", "base", "low")
        inside = sizes.join(common.maybe_broadcast(own, n), F.col("source").eqNullSafe(F.col("source_")))
        if width < _BITS - _BIN:
            inside = inside.where((F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("low") + F.lit(1 << (width + _BIN if width else _BITS - 2 * _BIN))))
        bins = inside.groupBy("source", F.shiftright("rank", width).alias("bin")).agg(F.sum("size").alias("words"), F.first("need").alias("need"), F.first("base").alias("base"))
        bins = bins.withColumn("before", F.coalesce(F.sum("words").over(grown), F.lit(0)))
        if width:
            hit = bins.where((F.col("base") + F.col("before") < F.col("need")) & (F.col("base") + F.col("before") + F.col("words") >= F.col("need")))
            hit = hit.select(F.col("source").alias("source_"), (F.col("base") + F.col("before")).alias("base_"), F.shiftleft("bin", width).alias("low_"))
            # without a hit (nothing needed, or sums that end below by rounding) there is no further bin to search
            plan = plan.join(common.maybe_broadcast(hit, n), F.col("source").eqNullSafe(F.col("source_")), "left").drop("source_")
            plan = plan.withColumn("base", F.coalesce("base_", "base")).withColumn("low", F.coalesce("low_", F.when(F.col("need") > 0, F.lit(1 << _BITS)).otherwise(F.lit(0)))).drop("base_", "low_")
            plan = common.cut(plan, "targets")
        else:
            none = bins.where("before = 0").select("source", "need", "base", (F.col("bin") - 1).alias("bin"), F.lit(0).cast("long").alias("upto"))
            steps = none.unionByName(bins.select("source", "need", "base", "bin", (F.col("before") + F.col("words")).alias("upto")))
            best = steps.withColumn("n", F.row_number().over(near)).where("n = 1").select(F.col("source").alias("source_"), F.col("bin").alias("cut_"))
            plan = plan.join(common.maybe_broadcast(best, n), F.col("source").eqNullSafe(F.col("source_")), "left")
            ends = F.when(F.col("need") <= 0, F.lit(-1)).otherwise(F.coalesce("cut_", F.col("low")))
            plan = plan.select("source", "source_size", "target", "whole", ends.cast("long").alias("cut"))
    return common.cut(plan, "plan")


def _sizes(docs: DataFrame, id_col: str, text_col: str, source_col: str, place) -> DataFrame:
    sizes = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), size_of(text_col).alias("size"), F.xxhash64(id_col, text_col).alias("identity"), place.alias("place"))
    return common.cut(sizes, "sizes")


def _planned(sizes: DataFrame, **targets) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """(doc_id, source, size, rank) of every row, each source's plan, its inclusion scale, and the number of sources."""
    own = common.cut(with_whole(source_targets(sizes, **targets)), "own")
    n = own.count()
    scales = common.cut(inclusion(sizes, own).withColumnRenamed("source", "source_"), "scales")
    ranked = sizes.join(common.maybe_broadcast(scales, n), F.col("source").eqNullSafe(F.col("source_")), "left")
    ranked = common.cut(ranked.select("doc_id", "source", "size", rank_of(probability_of(F.col("scale"), F.col("size")), "identity", "place").alias("rank")), "ranked")
    return ranked, sample_plan(ranked, own).withColumnRenamed("source", "source_"), scales, n


def probability_of(scale: Column, size: Column) -> Column:
    return F.least(F.lit(1.0), F.coalesce(scale, F.lit(0.0)) * measure_of(size))


def _copies() -> Column:
    return F.col("whole") + F.when(F.col("rank") <= F.col("cut"), 1).otherwise(0)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **targets) -> DataFrame:
    """(doc_id, size, source_size, target, taken): a row per row of docs.

    Null texts have size 0 and take nothing. A null source is a source of its own, last. Repeated rows have the same
    random odds; ties are broken by the rows' places. An empty table, or one without words, has targets of 0.
    """
    ranked, plan, _, n = _planned(_sizes(docs, id_col, text_col, source_col, F.monotonically_increasing_id()), **targets)
    joined = ranked.join(common.maybe_broadcast(plan, n), F.col("source").eqNullSafe(F.col("source_")))
    return joined.select("doc_id", "size", "source_size", F.col("target").cast("double").alias("target"), (_copies() * F.col("size")).cast("long").alias("taken"), _copies().cast("int").alias("copies"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **targets) -> DataFrame:
    """The mix itself: each row of docs as often as it is taken, with all columns. Texts are not shuffled.

    Ranks are computed again where the texts are; if documents repeat, the rows are written with their places first.
    """
    columns, place = docs.columns, F.lit(0).cast("long")
    sizes = _sizes(docs, id_col, text_col, source_col, place)
    if sizes.groupBy("identity").count().where("count > 1").limit(1).count():
        docs, place = common.cut(docs.withColumn("place__", F.monotonically_increasing_id()), "placed"), F.col("place__")
        sizes = _sizes(docs, id_col, text_col, source_col, place)
    _, plan, scales, n = _planned(sizes, **targets)
    plan = plan.join(common.maybe_broadcast(scales.withColumnRenamed("source_", "other_"), n), F.col("source_").eqNullSafe(F.col("other_")), "left")
    plan = plan.select(*(F.col(c).alias(f"{c}__") for c in ("source_", "whole", "cut", "scale")))
    joined = docs.withColumn("identity__", F.xxhash64(id_col, text_col)).withColumn("place__", place).withColumn("size__", size_of(text_col)).join(common.maybe_broadcast(plan, n), F.col(source_col).cast("string").eqNullSafe(F.col("source___")))
    rank = rank_of(probability_of(F.col("scale__"), F.col("size__")), "identity__", "place__")
    copies = F.col("whole__") + F.when(rank <= F.col("cut__"), 1).otherwise(0)
    return joined.withColumn("copy__", F.explode(F.array_repeat(F.lit(1), copies.cast("int")))).select(*columns)
