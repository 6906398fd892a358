"""Files of any length in byte ranges: lines with their numbers, and statements that end outside strings and comments.

Spark splits a file into ranges and reads each range's own lines, so a file is many tasks' work. What
a row needs to know of the ranges before it (how many lines, in a string or not) is found from one row a range and
joined back; the rows themselves are read twice and never gathered.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Inside of what a piece of text begins or ends.
PLAIN, STRING, COMMENT = 0, 1, 2
MARKS = re.compile(r"'|/\*|\*/")


def _ranges(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """file, start (of the range), row (rising within a range), value."""
    rows = spark.read.option("lineSep", separator).text(path)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("row"), "value")


def numbered_lines(spark: SparkSession, path: str, separator: str = "\n") -> DataFrame:
    """file, line (from 1), value of every line of all files below path.

    A range's rows are numbered as they are read; the lines of the ranges before it come from a count of each.
    """
    rows = _ranges(spark, path, separator)
    ranges = rows.groupBy("file", "start").agg(F.min("row").alias("least"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = ranges.select("file", "start", (before - F.col("least") + 1).alias("shift"))
    return rows.join(shifts, ["file", "start"]).select("file", (F.col("row") + F.col("shift")).alias("line"), "value")


def passed(text: str, state: int) -> int:
    """The state behind a text that begins in `state`: a quote opens and closes a string (a doubled one does both), comments don't nest."""
    for mark in MARKS.findall(text):
        if state == PLAIN:
            state = STRING if mark == "'" else COMMENT if mark == "/*" else PLAIN
        elif state == STRING and mark == "'" or state == COMMENT and mark == "*/":
            state = PLAIN
    return state


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each piece, for each of the three states that its range may begin in: the number of statements ended before it in the range, and the state behind it."""
    at, states, ended = None, [PLAIN, STRING, COMMENT], [0, 0, 0]
    for batch in batches:
        numbers, behind = [], []
        for file, start, value in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist(), batch.column("value").to_pylist()):
            if (file, start) != at:
                at, states, ended = (file, start), [PLAIN, STRING, COMMENT], [0, 0, 0]
            numbers.append(list(ended))
            states = [passed(value, s) for s in states]
            ended = [n + (s == PLAIN) for n, s in zip(ended, states)]
            behind.append(list(states))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(numbers, pa.list_(pa.int64())), pa.array(behind, pa.list_(pa.int32()))], [*batch.schema.names, "numbers", "behind"])


def statements(spark: SparkSession, path: str, end: str = ";") -> DataFrame:
    """file, statement (from 0), text of everything that ends with `end` outside strings ('...') and comments (/* */).

    Pieces between marks are read in ranges. What a range does to each of the three states that it may
    begin in is a function of three values; the functions of a file's ranges, one row each, are
    applied in order, and pieces of one statement are joined, across ranges too.
    """
    rows = _ranges(spark, path, end).mapInArrow(_walked, "file string, start long, row long, value string, numbers array<long>, behind array<int>")
    last = rows.groupBy("file", "start").agg(F.max_by("behind", "row").alias("behind"), F.max_by("numbers", "row").alias("numbers"))
    # A row a range, so that a file's list is as short as the file has ranges.
    files = last.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("start", "behind", "numbers"))).alias("ranges"))
    step = "struct(r.behind[a.state] as state, a.done + r.numbers[a.state] + if(r.behind[a.state] = 0, 1, 0) as done, array_append(a.seen, struct(r.start as start, a.state as state, a.done as done)) as seen)"
    begins = files.select("file", F.inline(F.expr(f"aggregate(ranges, struct(0 as state, 0L as done, cast(array() as array<struct<start:bigint,state:int,done:bigint>>) as seen), (a, r) -> {step}).seen")))
    placed = rows.join(begins, ["file", "start"]).select("file", "start", "row", "value", F.expr("done + numbers[state]").alias("statement"))
    joined = placed.groupBy("file", "statement").agg(F.array_sort(F.collect_list(F.struct("start", "row", "value"))).alias("pieces"))
    return joined.select("file", "statement", F.array_join("pieces.value", end).alias("text"))
