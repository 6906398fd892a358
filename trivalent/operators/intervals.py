"""Ranges of pages and what lies in them, without products: ranges are cut into spans of powers of two.

A range of n pages is at most 2 * log2(n) spans, each (level, number) of 2**level pages that
start at a multiple of it; a page lies in one span of each level. Ranges meet pages by an equi-join
on document, level and number, whatever their lengths, and each range meets each of its pages once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _levels(ranges: DataFrame, first: str, last: str) -> int:
    longest = ranges.agg(F.max(F.expr(f"{last} - {first} + 1"))).first()[0]
    return max(1, int(longest or 1)).bit_length()


def _spans(levels: int, first: str, last: str):
    """Spans that together make up the pages first to last (both included), disjoint; none for an empty range."""
    s, e = f"shiftright({first} + shiftleft(1L, l) - 1, l)", f"shiftright({last} + 1, l)"
    left, right = f"{s} < {e} and pmod({s}, 2) = 1", f"{s} < {e} and pmod({e}, 2) = 1"
    per_level = f"array(if({left}, struct(l as level, {s} as number), null), if({right}, struct(l as level, {e} - 1 as number), null))"
    return F.expr(f"array_compact(flatten(transform(sequence(0, {levels - 1}), l -> {per_level})))")


def pages_in_ranges(points: DataFrame, ranges: DataFrame, key: str, page: str, first: str, last: str) -> DataFrame:
    """Each point with each range of its document that holds its page: the columns of both, key once.

    Ranges whose last is before their first, and null bounds or pages, meet nothing. Names other than key must differ.
    """
    levels = _levels(ranges, first, last)
    cut = ranges.where(F.expr(f"{first} <= {last}")).withColumn("_span", F.explode(_spans(levels, f"cast({first} as long)", f"cast({last} as long)")))
    cut = cut.withColumn("_level", F.col("_span.level")).withColumn("_number", F.col("_span.number")).drop("_span")
    at = points.withColumn("_level", F.explode(F.sequence(F.lit(0), F.lit(levels - 1)))).withColumn("_number", F.expr(f"shiftright(cast({page} as long), _level)"))
    return at.join(cut, [key, "_level", "_number"]).drop("_level", "_number")


def first_containing(jobs: DataFrame, bundles: DataFrame, key: str) -> DataFrame:
    """jobs (key, job, start, end) with sequence: the first bundle (key, sequence, first, last) that holds all pages of the job, null without one.

    Bundles that hold the job's start are found by its page, those that also reach its end stay, the smallest sequence is taken.
    """
    met = pages_in_ranges(jobs.select(key, "job", "start", "end"), bundles.select(key, "sequence", "first", "last"), key, "start", "first", "last").where(F.col("last") >= F.col("end"))
    found = met.groupBy(key, "job").agg(F.min("sequence").alias("sequence"))
    return jobs.join(found, [key, "job"], "left")


def assembled(bundles: DataFrame, pages: DataFrame, nodes: DataFrame, records: dict[str, DataFrame], edges: DataFrame, key: str) -> DataFrame:
    """Bundles (key, sequence, first, last) with what they hold: pages, nodes, records by name, edges, and the first and last page there is.

    pages, nodes and records have (key, page); an edge (key, from_page, to_page) belongs to a bundle
    that holds either end, once. Counts are 0 where nothing lies in the range. Several rows of a
    page are counted before they meet ranges.
    """
    held = bundles
    spans = bundles.select(key, "sequence", "first", "last")

    def counted(rows: DataFrame, name: str) -> DataFrame:
        per_page = rows.groupBy(key, "page").agg(F.count("*").alias("rows"))
        return pages_in_ranges(per_page, spans, key, "page", "first", "last").groupBy(key, "sequence").agg(F.sum("rows").alias(name))

    present = pages_in_ranges(pages.select(key, "page").distinct(), spans, key, "page", "first", "last").groupBy(key, "sequence").agg(F.count("*").alias("pages"), F.min("page").alias("first_page"), F.max("page").alias("last_page"))
    counts = {"nodes": nodes} | records
    # An edge lies in the bundles of its one end and in those of its other; one that lies with both ends in a bundle counts once.
    ends = edges.select(key, F.col("from_page").alias("page"), F.lit(1).alias("rows")).unionByName(edges.select(key, F.col("to_page").alias("page"), F.lit(1).alias("rows")))
    one_end = pages_in_ranges(ends.groupBy(key, "page").agg(F.sum("rows").alias("rows")), spans, key, "page", "first", "last").groupBy(key, "sequence").agg(F.sum("rows").alias("ends"))
    pairs = edges.groupBy(key, "from_page", "to_page").agg(F.count("*").alias("rows"))
    inside = pages_in_ranges(pairs, spans, key, "from_page", "first", "last").where("to_page between first and last").groupBy(key, "sequence").agg(F.sum("rows").alias("whole"))
    held = held.join(present, [key, "sequence"], "left")
    for name, rows in counts.items():
        held = held.join(counted(rows, name), [key, "sequence"], "left")
    held = held.join(one_end, [key, "sequence"], "left").join(inside, [key, "sequence"], "left")
    edges_held = (F.coalesce("ends", F.lit(0)) - F.coalesce("whole", F.lit(0))).alias("edges")
    return held.select(key, "sequence", "first", "last", "first_page", "last_page", *(F.coalesce(n, F.lit(0)).alias(n) for n in ("pages", *counts)), edges_held)
