"""Checks of transcribed pages: token scores, table-like regions, bundle ranges, states, repeated assertions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trivalent.functions.text import digit_count

#: Below either a page is read again, densely.
FEWEST_TOKENS, LEAST_CONFIDENCE = 20, 6000
#: A page with this many shapes, or lines of this many digits, holds a table-like region.
MANY_SHAPES, NUMERIC_LINES, LINE_DIGITS = 8, 4, 3


def token_scores(pages: DataFrame, tokens: DataFrame, key: str, confidence: str) -> DataFrame:
    """Per page its tokens, their mean confidence rounded down (0 without tokens), and whether it needs a dense reading."""
    scores = tokens.groupBy(key).agg(F.count(confidence).alias("tokens"), F.expr(f"sum({confidence}) div count({confidence})").alias("mean_confidence"))
    scored = pages.select(key).join(scores, key, "left").fillna(0, ["tokens", "mean_confidence"])
    return scored.withColumn("dense", (F.col("tokens") < FEWEST_TOKENS) | (F.col("mean_confidence") < LEAST_CONFIDENCE))


def table_reasons(shapes: Column, lines: Column) -> Column:
    """Why a page is taken to hold a table, in fixed order; empty: it is not."""
    numeric = F.size(F.filter(lines, lambda line: digit_count(line) >= LINE_DIGITS))
    return F.array_compact(F.array(F.when(shapes >= MANY_SHAPES, "MANY_VECTOR_SHAPES"), F.when(numeric >= NUMERIC_LINES, "MULTIPLE_NUMERIC_LINES")))


def bundle_breaches(bundles: DataFrame, pages: DataFrame, document: str) -> DataFrame:
    """document, breach, number: what is wrong with the bundles (sequence, first, last) of documents with pages (page, failed).

    SEQUENCE: a bundle's place is not its number. OVERLAP: it starts before the last one's end.
    GAP: a page left out between two bundles that has not failed, or is no page. UNCOVERED: a
    page that has not failed and is in no bundle. Ranges are opened into their pages, so that
    all joins are on (document, page) and no document is one task's load.
    """
    order = Window.partitionBy(document).orderBy("sequence", "first")
    placed = bundles.select(document, "sequence", "first", "last", F.row_number().over(order).alias("place"), F.lag("last").over(order).alias("before"))
    page = F.col("page").alias("number")
    left_out = placed.where("first > before + 1").select(document, F.explode(F.sequence(F.col("before") + 1, F.col("first") - 1)).alias("page"))
    covered = bundles.select(document, F.explode(F.sequence("first", "last")).alias("page"))
    rows = [
        placed.where("sequence <> place").select(document, F.lit("SEQUENCE").alias("breach"), F.col("sequence").cast("long").alias("number")),
        placed.where("first < before").select(document, F.lit("OVERLAP").alias("breach"), F.col("first").cast("long").alias("number")),
        left_out.join(pages.where("failed"), [document, "page"], "left_anti").select(document, F.lit("GAP").alias("breach"), page.cast("long").alias("number")),
        pages.where("not failed").join(covered, [document, "page"], "left_anti").select(document, F.lit("UNCOVERED").alias("breach"), page.cast("long").alias("number")),
    ]
    found = rows[0]
    for more in rows[1:]:
        found = found.unionByName(more)
    return found


def state_summary(rows: DataFrame, keys: list[str], state: str, states: dict[str, str]) -> DataFrame:
    """Per key how many rows are in each state, 0 where none is, and the total; states maps value to column name."""
    return rows.groupBy(*keys).agg(*(F.count_if(F.col(state) == value).alias(name) for value, name in states.items()), F.count("*").alias("total"))


def assertions(rows: DataFrame, identity: list[str], key: str) -> DataFrame:
    """Per assertion (rows of equal identity) its digest, its occurrences, the least key among them, and what collapsed."""
    joined = F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in identity))
    counted = rows.select(F.sha2(joined, 256).alias("assertion_id"), key).groupBy("assertion_id")
    return counted.agg(F.count("*").alias("occurrences"), F.min(key).alias("first_key"), (F.count("*") - 1).alias("collapsed"))
