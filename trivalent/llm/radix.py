"""The k greatest rows of every key by radix select: histograms over value bits, then over the item's bytes.

A round counts the open rows of each key by their next digit (DIGIT bits of the value, from the
highest), sums the counts from the greatest digit down and keeps the digit in which the k-th row
lies. What lies above is in, what lies below is out. A key whose digit holds just as many rows as
it still needs is settled. Rows that tie in all bits are told apart by the UTF-8 bytes of their
item, smallest first: two bytes, then four, then eight, so that long common beginnings take few
rounds. A histogram holds at most 1024 rows a key (65,793 for two bytes) and is summed before
the shuffle, so that no task gets the rows of a key; thresholds are a row a key, written to
the shared folder after each round.

Cases: keys of fewer than k rows keep them all; an empty table gives no rows; items of a key
must be distinct, of items that repeat at the very threshold none or all stay; null keys meet
as one; null values or items aren't allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trivalent.llm.shared import materialize

#: Bits of the value that a round looks at.
DIGIT = 10


def _same(keys: list[str], left: DataFrame, right: DataFrame) -> list[Column]:
    return [left[k].eqNullSafe(right[k]) for k in keys]


def _join(rows: DataFrame, marks: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    return rows.join(marks, _same(keys, rows, marks), how).drop(*(marks[k] for k in keys))


def _chosen(counted: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """Of each key the digit in which the row that is `need`-th in order lies, with what is needed within it."""
    upto = F.sum("n").over(Window.partitionBy(*keys).orderBy(order))
    return counted.withColumn("upto", upto).where("upto >= need and upto - n < need").withColumn("need", F.expr("need - (upto - n)")).drop("upto")


def top_rows(rows: DataFrame, keys: list[str], value: str, item: str, k: int, bits: int = 30) -> DataFrame:
    """rows (value, a long from 0 below 2**bits, and item, a string) with a rank within keys, from 1 to k."""
    part = rows.select(*keys, F.col(value).alias("v"), F.col(item).cast("binary").alias("b"))
    digits = range(DIGIT * ((bits - 1) // DIGIT), -1, -DIGIT)
    marks, settled = None, []
    for shift in digits:
        high = F.shiftright("v", shift)
        if marks is None:
            open_rows = part.withColumn("need", F.lit(k).cast("long"))
        else:
            open_rows = _join(part, marks.where("n > need").select(*keys, "prefix", "need"), keys).where(F.shiftright("v", shift + DIGIT) == F.col("prefix"))
        counted = open_rows.groupBy(*keys, "need", high.alias("prefix")).agg(F.count("*").alias("n"))
        marks = materialize(_chosen(counted, keys, F.desc("prefix")), "marks")
        settled.append(marks.where("n = need").select(*keys, F.expr(f"shiftleft(prefix, {shift})").alias("least"), F.lit(None).cast("binary").alias("first")))
    # Ties in the whole value: need of n rows with this value, by bytes.
    marks = marks.select(*keys, F.col("prefix").alias("least"), "need", "n", F.unhex(F.lit("")).alias("first"))
    width, done = 2, 0
    while not marks.where("n > need").isEmpty():
        held = F.expr(f"substring(b, 1, {done})")
        open_rows = _join(part, marks.where("n > need").drop("n"), keys).where((F.col("v") == F.col("least")) & (held == F.col("first")))
        counted = open_rows.groupBy(*keys, "least", "need", F.expr(f"substring(b, 1, {done + width})").alias("first")).agg(F.count("*").alias("n"))
        marks = materialize(_chosen(counted, keys, F.asc("first")), "marks")
        done, width = done + width, 2 * width
        settled.append(marks.where("n = need").select(*keys, "least", "first"))
    bounds = settled[0]
    for more in settled[1:]:
        bounds = bounds.unionByName(more)
    # A key without bounds has fewer than k rows.
    found = _join(rows, bounds, keys, "left")
    tie = F.expr(f"substring(cast(`{item}` as binary), 1, length(first)) <= first")
    inside = F.col("least").isNull() | (F.col(value) > F.col("least")) | ((F.col(value) == F.col("least")) & F.coalesce(tie, F.lit(True)))
    ranked = Window.partitionBy(*keys).orderBy(F.desc(value), F.asc(item))
    return found.where(inside).drop("least", "first").withColumn("rank", F.row_number().over(ranked))
