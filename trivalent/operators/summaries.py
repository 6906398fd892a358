"""Summaries that decide something: anchors and whether they may be published, graph counts, import counters, declared counts, guards, pages of lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ANCHOR_STATES = ("anchored", "already_anchored", "ambiguous", "unmatched", "invalid_existing_anchor")
CHANGES = ("inserted", "updated", "unchanged", "kept", "refused")
IN_FLIGHT = ("PENDING", "RUNNING")


def anchor_summary(anchors: DataFrame) -> DataFrame:
    """Per document records by status and publishable: all its records are anchored, now or before."""
    counts = anchors.groupBy("document").agg(*(F.count_if(F.col("status") == s).alias(s) for s in ANCHOR_STATES), F.count("*").alias("records"))
    return counts.withColumn("publishable", F.col("anchored") + F.col("already_anchored") == F.col("records"))


def graph_counts(nodes: DataFrame, pages: DataFrame, records: DataFrame) -> DataFrame:
    """Per document pages, nodes, roots (nodes without parent), records; 0 where a document of any of the tables lacks something."""
    tall = nodes.select("document", F.lit(0).alias("p"), F.lit(1).alias("n"), F.col("parent").isNull().cast("int").alias("r"), F.lit(0).alias("k"))
    tall = tall.unionByName(pages.select("document", F.lit(1).alias("p"), F.lit(0).alias("n"), F.lit(0).alias("r"), F.lit(0).alias("k")))
    tall = tall.unionByName(records.select("document", F.lit(0).alias("p"), F.lit(0).alias("n"), F.lit(0).alias("r"), F.lit(1).alias("k")))
    return tall.groupBy("document").agg(F.sum("p").alias("pages"), F.sum("n").alias("nodes"), F.sum("r").alias("roots"), F.sum("k").alias("records"))


def manifest_counts(counts: DataFrame) -> DataFrame:
    """The sums over all documents, in one row."""
    return counts.agg(F.count("*").alias("documents"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("pages", "nodes", "roots", "records")))


def import_counts(merged: DataFrame) -> DataFrame:
    """How many rows of a merge came out in which way, in one row; 0 where none did."""
    return merged.agg(*(F.count_if(F.col("change") == c).alias(c) for c in CHANGES))


def false_counts(declared: DataFrame, rows: DataFrame, state: str) -> DataFrame:
    """state, declared, counted wherever declared counts (state, jobs) aren't those of the rows, whichever side lacks a state."""
    counted = rows.groupBy(state).agg(F.count("*").alias("counted"))
    both = declared.select(state, F.col("jobs").cast("long").alias("declared")).join(counted, state, "full").fillna(0, ["declared", "counted"])
    return both.where("declared <> counted")


def reasons_by(drafts: DataFrame, key: str, reason: str, reasons: list[str]) -> DataFrame:
    """Per key how many drafts were rejected for which reason, how many weren't (accepted), and how many for a reason that isn't listed (other)."""
    r = F.col(reason)
    return drafts.groupBy(key).agg(F.count_if(r.isNull()).alias("accepted"), *(F.count_if(r == x).alias(x) for x in reasons), F.count_if(r.isNotNull() & ~r.isin(reasons)).alias("other"))


def admitted(requests: DataFrame, runs: DataFrame, key: str) -> DataFrame:
    """requests with in_flight (runs of their key that aren't over) and admitted: none is, and the request is the first of its key."""
    busy = runs.where(F.col("status").isin(*IN_FLIGHT)).groupBy(key).agg(F.count("*").alias("in_flight"))
    first = requests.groupBy(key).agg(F.min("request").alias("_first"))
    joined = requests.join(busy, key, "left").fillna(0, ["in_flight"]).join(first, key)
    return joined.withColumn("admitted", (F.col("in_flight") == 0) & (F.col("request") == F.col("_first"))).drop("_first")


def counted_page(rows: DataFrame, order: list, page: int, size: int = 20, most: int = 100) -> tuple[DataFrame, int]:
    """One page of an ordered list, from 1, and the number of all rows; a size beyond `most` is cut to it, a page that isn't there is refused."""
    size, total = min(size, most), rows.count()
    if size < 1 or page < 1 or page > max(1, -(-total // size)):
        raise ValueError("no such page")
    return rows.orderBy(*order).offset((page - 1) * size).limit(size), total
