"""Node trees: parents from label depths, the walk from every node to its root, orphans and cycles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trivalent.plans.lineage import written

#: The deepest label that opens a level of its own.
DEEPEST = 9


def parents(rows: DataFrame, key: str, order: str, depth: Column) -> DataFrame:
    """rows with parent: the order of the nearest earlier row of the key that is shallower, or null.

    A row closes all open levels as deep as its own. One without a depth goes below the
    deepest level that is open, which is the nearest earlier row with a depth. A window per
    level keeps the last row seen there, so there is no fold and no list.
    """
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    held = rows.withColumn("_depth", F.when(depth.isNotNull(), F.least(depth, F.lit(DEEPEST))))
    last = [F.last(F.when(F.col("_depth") == level, F.col(order)), ignorenulls=True).over(before) for level in range(1, DEEPEST + 1)]
    shallower = [F.when(F.col("_depth").isNull() | (F.col("_depth") > level), seen) for level, seen in enumerate(last, 1)]
    return held.withColumn("parent", F.greatest(*shallower)).drop("_depth")


def walked(nodes: DataFrame, node: str = "node", parent: str = "parent") -> DataFrame:
    """node, root, depth (1 at a root), state: rooted, orphan (the walk ends at a name that is no node) or cycle.

    Every round doubles the steps known, so a tree of depth d takes log2(d) rounds; what
    still moves after log2(nodes) rounds is on a cycle or leads into one, and has no depth.
    A round writes the nodes that still move, and only those: a node that has arrived stays where it was written.
    """
    up = F.col(parent)
    # up: the node `depth` above; null once the root is passed. root: the last node met.
    now = written(nodes.select(F.col(node).alias("node"), up.alias("up"), F.lit(1).cast("long").alias("depth"), F.col(node).alias("root"), F.when(up.isNull(), "rooted").alias("state")))
    done, moving = [now.where("state is not null")], now.where("state is null")
    for _ in range(moving.count().bit_length() + 2):
        if moving.isEmpty():
            break
        above = reduce(DataFrame.unionByName, done, moving).select(F.col("node").alias("up"), F.col("up").alias("_up"), F.col("depth").alias("_depth"), F.col("root").alias("_root"), F.col("state").alias("_state"))
        lost = F.col("_root").isNull()
        now = written(moving.join(above, "up", "left").select("node", F.col("_up").alias("up"), (F.col("depth") + F.coalesce("_depth", F.lit(0).cast("long"))).alias("depth"), F.coalesce("_root", "root").alias("root"), F.when(lost, "orphan").otherwise(F.col("_state")).alias("state")))
        done, moving = [*done, now.where("state is not null")], now.where("state is null")
    none = moving.select("node", F.lit(None).cast(moving.schema["root"].dataType).alias("root"), F.lit(None).cast("long").alias("depth"), F.lit("cycle").alias("state"))
    return reduce(DataFrame.unionByName, [rows.select("node", "root", "depth", "state") for rows in done], none)
