"""Transcripts: records under qualified names, their items, owners of overlaps, anchors in line sequences, collapsed drafts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def qualified(records: DataFrame, scope: str, kind: str, name: str, order: str, columns: list[str]) -> DataFrame:
    """scope, record (kind:name), name and columns; of records that repeat a name within a kind the last one stands."""
    last = records.groupBy(scope, kind, name).agg(F.max(F.struct(order, *columns)).alias("row"))
    return last.select(scope, F.concat_ws(":", kind, F.col(name).cast("string")).alias("record"), F.col(name).cast("string").alias("bare"), *(F.col(f"row.{c}") for c in columns))


def with_items(records: DataFrame, items: DataFrame, scope: str, item: str, outcome: str) -> DataFrame:
    """Each record's outcome: that of the item of its qualified name, or else of its bare one if no other record shares that; `unprocessed` without either.

    An item that repeats has no outcome of its own: its record is `repeated_item`, and repeated_items() names it.
    """
    items = items.groupBy(scope, item).agg(F.when(F.count("*") == 1, F.min(outcome)).otherwise("repeated_item").alias(outcome))
    alone = records.groupBy(scope, "bare").agg(F.count("*").alias("alike"))
    named = items.select(scope, F.col(item).alias("record"), F.col(outcome).alias("by_record"))
    bare = items.select(scope, F.col(item).alias("bare"), F.col(outcome).alias("by_bare"))
    joined = records.join(named, [scope, "record"], "left").join(alone, [scope, "bare"]).join(bare, [scope, "bare"], "left")
    return joined.select(scope, "record", F.coalesce("by_record", F.when(F.col("alike") == 1, F.col("by_bare")), F.lit("unprocessed")).alias("outcome"))


def repeated_items(items: DataFrame, scope: str, item: str) -> DataFrame:
    """Items that a scope has more than once: violations."""
    return items.groupBy(scope, item).agg(F.count("*").alias("n")).where("n > 1")


def unmatched_items(records: DataFrame, items: DataFrame, scope: str, item: str) -> DataFrame:
    """Items that no record's qualified or bare name answers to: violations."""
    names = records.select(scope, F.col("record").alias(item)).union(records.select(scope, F.col("bare"))).distinct()
    return items.join(names, [scope, item], "left_anti")


def owners(claims: DataFrame, page: str, order: str, content: Column) -> DataFrame:
    """page, owner (its earliest claim), claims, and disagreeing: later claims whose content is known to differ from the owner's."""
    text = claims.select(page, order, content.alias("content"))
    first = text.groupBy(page).agg(F.min(F.struct(order, "content")).alias("first"), F.count("*").alias("claims"))
    joined = text.join(first, page)
    return joined.groupBy(page, F.col(f"first.{order}").alias("owner"), "claims").agg(F.count_if(F.col("content") != F.col("first.content")).alias("disagreeing"))


def anchors(lines: DataFrame, key: str, place: str, line: str, width: int) -> DataFrame:
    """Every run of `width` lines of a key, how often it stands anywhere, and whether it anchors (exactly once).

    Runs meet by a digest, counted before the shuffle; nothing is compared with everything.
    """
    window = Window.partitionBy(key).orderBy(place)
    following = [F.lead(line, n).over(window) for n in range(width)]
    runs = lines.select(key, place, *(x.alias(f"_{n}") for n, x in enumerate(following))).dropna(subset=[f"_{n}" for n in range(width)])
    runs = runs.select(key, place, F.sha2(F.concat_ws("\n", *(f"_{n}" for n in range(width))), 256).alias("run"))
    counts = runs.groupBy("run").agg(F.count("*").alias("places"))
    return runs.join(counts, "run").select(key, place, "places", (F.col("places") == 1).alias("anchored"))


def collapsed(items: DataFrame, key: str, reason: str) -> DataFrame:
    """key, items, distinct_reasons, with_reason, templated: more than one item, a reason on each, and one wording for all."""
    told = F.when(F.col(reason) != "", F.col(reason))
    counts = items.groupBy(key).agg(F.count("*").alias("items"), F.count_distinct(told).alias("distinct_reasons"), F.count(told).alias("with_reason"))
    return counts.withColumn("templated", (F.col("items") > 1) & (F.col("with_reason") == F.col("items")) & (F.col("distinct_reasons") <= 1))
