"""Sets, multisets and coverage: differences both ways, matched copies, reconciliation, inventories, misses with reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def multiset_diff(left: DataFrame, right: DataFrame, value: str) -> DataFrame:
    """value, side, n: how many more copies one side has than the other. Counts meet before the shuffle of the values."""
    counted = left.groupBy(value).agg(F.count("*").alias("l")).join(right.groupBy(value).agg(F.count("*").alias("r")), value, "full").fillna(0, ["l", "r"])
    more = F.col("l") - F.col("r")
    return counted.where("l <> r").select(value, F.when(more > 0, "left").otherwise("right").alias("side"), F.abs(more).alias("n"))


def multiset_match(left: DataFrame, right: DataFrame, value: str, order: str) -> DataFrame:
    """The nth copy of a value on the left with the nth on the right: value, nth, left and right order keys (null where there is none)."""
    nth = lambda side, name: side.select(value, F.row_number().over(Window.partitionBy(value).orderBy(order)).alias("nth"), F.col(order).alias(name))
    return nth(left, "left_id").join(nth(right, "right_id"), [value, "nth"], "full")


def reconcile(a: DataFrame, b: DataFrame, key: str, verdict: str) -> DataFrame:
    """key, verdict_a, verdict_b, outcome of two independent passes: agreed, conflict, only_a or only_b."""
    joined = a.select(key, F.col(verdict).alias("verdict_a"), F.lit(True).alias("in_a")).join(b.select(key, F.col(verdict).alias("verdict_b"), F.lit(True).alias("in_b")), key, "full")
    outcome = F.when(F.col("in_b").isNull(), "only_a").when(F.col("in_a").isNull(), "only_b").when(F.col("verdict_a").eqNullSafe(F.col("verdict_b")), "agreed").otherwise("conflict")
    return joined.select(key, "verdict_a", "verdict_b", outcome.alias("outcome"))


def inventory(wanted: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """key, state: missing (wanted and not present), extra (present and not wanted) or covered; each key once."""
    joined = wanted.select(key).distinct().withColumn("w", F.lit(1)).join(present.select(key).distinct().withColumn("p", F.lit(1)), key, "full")
    return joined.select(key, F.when(F.col("p").isNull(), "missing").when(F.col("w").isNull(), "extra").otherwise("covered").alias("state"))


def with_miss_reason(rows: DataFrame, facts: DataFrame, key: str, fact: str, checks: list[tuple[Column, str]]) -> DataFrame:
    """rows left-joined with facts; reason names why a row has no usable fact, null where it has one. No row is dropped."""
    joined = rows.join(facts.withColumn("found", F.lit(True)), key, "left")
    reason = F.when(F.col("found").isNull(), "NO_RECORD").when(F.col(fact).isNull(), "EMPTY")
    for wrong, name in checks:
        reason = reason.when(wrong, name)
    return joined.withColumn("reason", reason).drop("found")


def first_wins(rows: DataFrame, identity: Column, order: list) -> DataFrame:
    """rows with kept_of: of equal identities the first in order is kept; the rest name it.

    The smallest order key is aggregated before the shuffle, so a large group of copies is no task's load.
    """
    own = rows.withColumn("identity", identity)
    firsts = own.groupBy("identity").agg(F.min(F.struct(*order)).alias("first"), F.count("*").alias("copies"))
    return own.join(firsts, "identity")
