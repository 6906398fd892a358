"""Rows of recognised tokens: boxes, confidences, row grouping, right-to-left reading order.

Tokens of a page are taken from top to bottom. A token joins the most recent of the last three
rows whose mean centre is near its own (within 0.6 of the taller of token and row), or opens a
row. This is a fold whose state is three rows; it runs over sorted tokens as they stream through
a task, so that no page is held as a whole. Rows stand in the order of their tops, tokens
within a row from right to left.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that a token may join, and how far from a row's centre, by height.
LAST_ROWS, REACH = 3, 0.6
#: Fixed value: the greatest confidence.
FULL = 10_000
BLANK = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0"


def confidence(score: Column) -> Column:
    """A score from 0 to 1 as a whole number to FULL, half to even, clamped; null and NaN are 0."""
    known = F.nanvl(F.coalesce(score.cast("double"), F.lit(0.0)), F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(float(FULL)), F.rint(known * FULL))).cast("int")


def box(points: Column) -> Column:
    """left, top, right, bottom (never below 0, half to even) of an array of points, each of two numbers at least; zeros without one.

    A box of four numbers is the points (left, top) and (right, bottom), as corners() gives them.
    """
    usable = F.filter(points, lambda p: F.coalesce((F.size(p) >= 2) & p[0].isNotNull() & p[1].isNotNull(), F.lit(False)))
    side = lambda pick, i: F.coalesce(F.greatest(F.lit(0), F.rint(pick(F.transform(usable, lambda p: p[i]))).cast("int")), F.lit(0))
    return F.struct(side(F.array_min, 0).alias("left"), side(F.array_min, 1).alias("top"), side(F.array_max, 0).alias("right"), side(F.array_max, 1).alias("bottom"))


def flat_box(four: Column) -> Column:
    """left, top, right, bottom of an array of four numbers, in that order as they are; zeros where it has not four."""
    side = lambda i: F.when(F.size(four) == 4, F.coalesce(F.greatest(F.lit(0), F.rint(four[i]).cast("int")), F.lit(0))).otherwise(0)
    return F.struct(side(0).alias("left"), side(1).alias("top"), side(2).alias("right"), side(3).alias("bottom"))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Row numbers of tokens sorted by page, top, left and place. A row is [number, sum of centres, tokens, top, bottom]."""
    page, rows, opened = None, [], 0
    for batch in batches:
        numbers = []
        for key, top, bottom in zip(batch.column("page").to_pylist(), batch.column("top").to_pylist(), batch.column("bottom").to_pylist()):
            if key != page:
                page, rows, opened = key, [], 0
            centre, height = (top + bottom) / 2, max(1, bottom - top)
            for row in reversed(rows):
                if abs(centre - row[1] / row[2]) <= max(height, 1, row[4] - row[3]) * REACH:
                    row[1], row[2], row[3], row[4] = row[1] + centre, row[2] + 1, min(row[3], top), max(row[4], bottom)
                    break
            else:
                row = [opened, centre, 1, top, bottom]
                rows, opened = [*rows[1 - LAST_ROWS :], row], opened + 1
            numbers.append(row[0])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(numbers, pa.int64())], [*batch.schema.names, "line"])


def token_lines(tokens: DataFrame) -> DataFrame:
    """tokens with line (from 0 within a page) and position (from 0 within a page, in reading order).

    tokens: page (string), place (order of recognition), text, left, top, right, bottom, confidence.
    Tokens of null or blank text are dropped, texts are trimmed. Tokens of equal top and left keep
    the order of recognition, and so do tokens of equal left within a row.
    """
    given = tokens.select("page", F.col("place").cast("long").alias("place"), F.btrim("text", F.lit(BLANK)).alias("text"), *(F.col(c).cast("int").alias(c) for c in ("left", "top", "right", "bottom", "confidence"))).where("text <> ''")
    sorted_ = given.repartition("page").sortWithinPartitions("page", "top", "left", "place")
    lined = sorted_.mapInArrow(_rows, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in given.schema) + ", line long")
    reading = Window.partitionBy("page").orderBy("line", F.desc("left"), "top", "place")
    return lined.withColumn("position", F.row_number().over(reading) - 1)


def lines(tokens: DataFrame) -> DataFrame:
    """page, line, text (tokens right to left), box, mean confidence rounded down, tokens, first (position of its first token)."""
    grouped = token_lines(tokens).groupBy("page", "line").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "text"))), lambda t: t["text"]), " ").alias("text"), F.min("left").alias("left"), F.min("top").alias("top"), F.max("right").alias("right"), F.max("bottom").alias("bottom"),
        F.expr("cast(sum(confidence) div count(*) as int)").alias("confidence"), F.count("*").alias("tokens"), F.min("position").alias("first"),
    )
    return grouped
