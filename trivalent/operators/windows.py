"""Ordered work: continuation edges, bundles, chunk order, leases, overlap marks, newest-first choice, page slices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Characters that end a sentence; a page that ends otherwise runs on.
TERMINAL = ".!?:;؟؛۔"
BUNDLES = "array<struct<first:int,last:int,pages:int,bytes:bigint>>"


def continuation_edges(pages: DataFrame, key: str, place: str, text: str) -> DataFrame:
    """key, from_place, to_place of adjacent pages of which the first ends without terminal punctuation."""
    following = F.lead(place).over(Window.partitionBy(key).orderBy(place))
    last = F.substring(F.rtrim(text), -1, 1)
    marked = pages.select(key, F.col(place).alias("from_place"), following.alias("to_place"), last.alias("last"))
    return marked.where((F.col("to_place") == F.col("from_place") + 1) & (F.col("last") != "") & (F.instr(F.lit(TERMINAL), F.col("last")) == 0)).select(key, "from_place", "to_place")


def bundles(pages: Column, max_pages: int, max_bytes: int) -> Column:
    """Greedy bundles of one document's pages, an array of (bytes, runs_on); bytes null: a page without a package.

    A bundle closes at a page without package, at max_pages, and before a page that would
    exceed max_bytes; a larger page stands alone. If the page before runs on into a bundle's
    first page and both fit, that page comes along, so that a sentence is whole somewhere.
    The fold stays in the JVM, an array of one document at a time.
    """
    none = F.struct(F.lit(-1).alias("first"), F.lit(-1).alias("last"), F.lit(0).alias("pages"), F.lit(0).cast("bigint").alias("bytes"))
    start = F.struct(F.lit(0).alias("at"), none.alias("open"), F.lit(None).cast("bigint").alias("before"), F.lit(False).alias("runs_on"), F.array().cast(BUNDLES).alias("done"))

    def bundle(first: Column, last: Column, pages: Column, size: Column) -> Column:
        return F.struct(first.cast("int").alias("first"), last.cast("int").alias("last"), pages.cast("int").alias("pages"), size.cast("bigint").alias("bytes"))

    def step(s: Column, page: Column) -> Column:
        size, opened = page["bytes"], s["open"]["pages"] > 0
        fits = opened & (s["open"]["pages"] < max_pages) & (s["open"]["bytes"] + size <= max_bytes)
        overlap = s["runs_on"] & s["before"].isNotNull() & (s["before"] + size <= max_bytes) & F.lit(max_pages >= 2)
        fresh = F.when(overlap, bundle(s["at"] - 1, s["at"], F.lit(2), s["before"] + size)).otherwise(bundle(s["at"], s["at"], F.lit(1), size))
        grown = bundle(s["open"]["first"], s["at"], s["open"]["pages"] + 1, s["open"]["bytes"] + size)
        following = F.when(size.isNull(), none).when(fits, grown).otherwise(fresh)
        closes = opened & (size.isNull() | ~fits)
        return F.struct((s["at"] + 1).alias("at"), following.alias("open"), size.alias("before"), page["runs_on"].alias("runs_on"), F.when(closes, F.concat(s["done"], F.array(s["open"]))).otherwise(s["done"]).alias("done"))

    every = F.aggregate(pages, start, step, lambda s: F.when(s["open"]["pages"] > 0, F.concat(s["done"], F.array(s["open"]))).otherwise(s["done"]))
    return F.filter(every, lambda b: b["bytes"] > 0)


def numbered(rows: DataFrame, keys: list[str], order: list, name: str = "ordinal") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def leased(rows: DataFrame, keys: list[str], order: list, pending: Column, limit: int) -> DataFrame:
    """The first `limit` pending rows of each key, in order."""
    return numbered(rows.where(pending), keys, order).where(F.col("ordinal") <= limit)


def overlap_marked(rows: DataFrame, keys: list[str], order: list, start: str, end: str) -> DataFrame:
    """rows with overlaps: whether a row starts before or where the row before it ends."""
    before = F.lag(end).over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("overlaps", F.coalesce(F.col(start) <= before, F.lit(False)))


def newest(rows: DataFrame, keys: list[str], order: list, chosen: str = "chosen", others: str = "superseded") -> DataFrame:
    """rows with state: the first in order of each key is chosen, the rest are superseded."""
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) == 1
    return rows.withColumn("state", F.when(first, chosen).otherwise(others))


def page_slice(rows: DataFrame, order: list, page: int, size: int = 20, most: int = 100) -> DataFrame:
    """One page of an ordered list; sizes above `most` are refused."""
    if not 1 <= size <= most or page < 1:
        raise ValueError("page or size out of range")
    return rows.orderBy(*order).offset((page - 1) * size).limit(size)
