"""JSON Lines as rows: file, line number, the object as text, or why the line was refused."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trivalent.functions.identity import json_object_error
from trivalent.sources.pieces import numbered_lines


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """file, line (from 1), record, error. Blank lines are no records; whatever isn't one object, or repeats a key, has an error that names it.

    A file is read in ranges, so one file is many tasks' work.
    """
    lines = numbered_lines(spark, path).where("trim(value) <> ''")
    checked = lines.select("file", "line", F.rtrim(F.regexp_replace("value", "\r$", "")).alias("record"))
    reason = json_object_error(F.col("record"))
    return checked.withColumn("error", F.when(reason.isNotNull(), F.concat(F.lit("line "), F.col("line").cast("string"), F.lit(": "), reason)))
