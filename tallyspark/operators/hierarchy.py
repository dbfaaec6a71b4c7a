"""Trees of sessions, and a total dealt over days in proportion."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _cut(df: DataFrame) -> DataFrame:
    """df written once in the folder of spark.checkpoint.dir and read back, so that rounds don't pile up in one plan."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tallyspark-"))
    return df.checkpoint()


def descendants(spark: SparkSession, edges: DataFrame, rounds: int = 64) -> DataFrame:
    """(root, node, depth) from edges (node, parent), one row per node; parent is null at roots.

    Nodes on or behind cycles, and those whose parents lead out of the table, belong to no root. Each round doubles how
    far back every node looks, so a chain of n nodes takes log2(n) rounds, each an equality join.
    """
    at = edges.select("node", "parent", F.when(F.col("parent").isNull(), F.col("node")).alias("root"), F.when(F.col("parent").isNull(), 0).otherwise(1).alias("depth"))
    at, most = _cut(at), None
    for _ in range(rounds):
        left = at.where("parent is not null").count()
        if not left or left == most:
            break
        # a node that looks as far back as there are nodes stands on a cycle or behind one
        most = left if at.agg(F.max("depth") > F.count(F.lit(1))).first()[0] else None
        back = at.select(F.col("node").alias("parent"), F.col("parent").alias("before"), F.col("root").alias("found"), F.col("depth").alias("more"))
        moved = at.where("parent is not null").join(back, "parent").select("node", F.col("before").alias("parent"), F.col("found").alias("root"), (F.col("depth") + F.col("more")).alias("depth"))
        at = _cut(at.where("parent is null").unionByName(moved))
    return at.where("parent is null").select("root", "node", "depth")


def tree_order(rows: DataFrame) -> DataFrame:
    """(node, depth, place): parents before their children, children in the rows' order; rows: (node, parent, position).

    A parent that isn't among the rows, and every member of a cycle, makes a root. Positions from root to node, as
    fixed-width text, sort in this order; a path grows by doubling like descendants().
    """
    known = rows.select(F.col("node").alias("parent"))
    own = rows.join(known, "parent", "left_semi").select("node", "parent", "position")
    own = own.unionByName(rows.join(own.select("node"), "node", "left_anti").select("node", F.lit(None).cast(rows.schema["parent"].dataType).alias("parent"), "position"))
    members = own.join(cycle_members(own.select("node", "parent")).select("node", F.lit(True).alias("cyclic")), "node", "left")
    own = members.select("node", F.when(F.col("cyclic").isNull(), F.col("parent")).alias("parent"), F.lpad(F.col("position").cast("string"), 12, "0").alias("path"), F.lit(0).alias("depth"))
    at = _cut(own)
    for _ in range(64):
        if not at.where("parent is not null").limit(1).count():
            break
        back = at.select(F.col("node").alias("parent"), F.col("parent").alias("before"), F.col("path").alias("head"), F.col("depth").alias("more"))
        moved = at.where("parent is not null").join(back, "parent").select("node", F.col("before").alias("parent"), F.concat_ws("/", "head", "path").alias("path"), (F.col("depth") + F.col("more") + 1).alias("depth"))
        at = _cut(at.where("parent is null").unionByName(moved))
    return at.select("node", "depth", "path")


def cycle_members(edges: DataFrame) -> DataFrame:
    """(node) of edges (node, parent), one row per node, that lie on a cycle: what is left when nodes are kept that some
    node steps back to after as many steps as there are nodes."""
    step = _cut(edges.where("parent is not null").select("node", F.col("parent").alias("to")))
    n, far = step.count(), step
    for _ in range(max(1, n).bit_length()):
        far = _cut(far.join(far.select(F.col("node").alias("to"), F.col("to").alias("next")), "to").select("node", F.col("next").alias("to")))
    return far.select(F.col("to").alias("node")).distinct()


def deal_over_days(rows: DataFrame, total: str, group: str = "session_id", day: str = "date") -> DataFrame:
    """Each group's greatest total over its days by their number of rows, in whole units; the last day has what is left."""
    days = rows.groupBy(group, day).agg(F.count(F.lit(1)).alias("n"), F.max(total).alias("t"))
    own = Window.partitionBy(group)
    share = F.floor(F.max("t").over(own) * F.col("n") / F.sum("n").over(own)).cast("long")
    last = F.row_number().over(own.orderBy(F.col(day).desc())) == 1
    days = days.withColumn("whole", F.max("t").over(own)).withColumn("share", share).withColumn("last", last)
    rest = F.greatest(F.col("whole") - F.coalesce(F.sum(F.when(~F.col("last"), F.col("share"))).over(own), F.lit(0)), F.lit(0))
    return days.select(group, day, F.when(F.col("last"), rest).otherwise(F.col("share")).alias("share"))
