"""Reports for readers: results with labels beside their codes, the lines of each model's document, and the documents as files.

Stored results stay as they are; labels are added to a copy. Every document says what it was made from
and that what was not evaluated is no compliance. Wording is a parameter; DEFAULT is in English.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trivalent.functions.status import established_nothing
from trivalent.functions.text import table_cell
from trivalent.operators.report_text import label
from trivalent.plans.lineage import written

DEFAULT = {
    "title": "# Report on %s", "made_from": "Made from the model %s and %d specifications. What was not evaluated is undecided, not compliant.", "total": "**%s**: %d specifications passed, %d failed, %d undecided.",
    "heading": "## %d. %s", "verdict": "%s (%s)", "plain_verdict": "%s", "counts": "%d matched: %d passed, %d failed, %d undecided.", "nothing": "Nothing was established here.", "columns": "| Element | Status | Reason |", "rule": "|---|---|---|", "row": "| %s | %s | %s |", "omitted": "%d more are not listed.",
}


def localised(results: DataFrame, labels: dict[str, str]) -> DataFrame:
    """results with reason_label (the code's, or the code itself without one, null without a code) and nothing_established."""
    return results.withColumn("reason_label", label(F.col("reason_code"), labels)).withColumn("nothing_established", established_nothing(F.col("reason_code")))


def _lines(rows: DataFrame, section: Column, first: int, lines: Column) -> DataFrame:
    return rows.select("model", section.cast("long").alias("section"), F.posexplode(lines).alias("at", "line")).where("line is not null").select("model", "section", (F.col("at").cast("long") + first).alias("place"), "line")


def report_lines(results: DataFrame, reports: DataFrame, items: DataFrame, labels: dict[str, str], wording: dict[str, str] = DEFAULT) -> DataFrame:
    """model, section, place, line: the document of each model, in the order of section and place.

    results: check.specification_results. reports: check.report. items: check.itemised over entity outcomes by model, ids and
    ordinal (entity_id, status, reason_code, rank, omitted). Names and labels are made safe for a table's cells.
    Section 0 is the head; a specification's section is its place by ids and ordinal. Entities come by rank behind place 100.
    """
    results, items = written(results), written(items)  # many parts of the document read them
    say = lambda name, *values: F.format_string(wording[name], *values)
    numbered = localised(results, labels).withColumn("section", F.row_number().over(Window.partitionBy("model").orderBy("ids", "ordinal")))
    count = numbered.groupBy("model").agg(F.count("*").alias("specifications"))
    head = reports.join(count, "model")
    top = F.array(say("title", table_cell(F.col("model"))), F.lit(""), say("made_from", table_cell(F.col("model")), F.col("specifications")), F.lit(""), say("total", F.col("status"), *(F.col(f"specifications_{s}") for s in ("passed", "failed", "indeterminate"))))
    verdict = F.when(F.col("reason_label").isNull(), say("plain_verdict", F.col("status"))).otherwise(say("verdict", F.col("status"), table_cell(F.coalesce("reason_label", F.lit("")))))
    body = F.array(F.lit(""), say("heading", F.col("section"), table_cell(F.col("name"))), F.lit(""), verdict, F.when(F.col("nothing_established"), wording["nothing"]), F.when(F.col("matched") > 0, say("counts", *(F.col(c) for c in ("matched", "passed", "failed", "indeterminate")))))
    own = items.join(numbered.select("model", "ids", "ordinal", "section"), ["model", "ids", "ordinal"])
    listed = own.withColumn("_label", F.coalesce(label(F.col("reason_code"), labels), F.lit("")))
    rows = listed.select("model", F.col("section").cast("long").alias("section"), (F.col("rank").cast("long") + 102).alias("place"), say("row", F.col("entity_id").cast("string"), F.col("status"), table_cell(F.col("_label"))).alias("line"))
    tables = own.groupBy("model", "section").agg(F.max("omitted").alias("omitted"), F.max("rank").alias("last"))
    heads = _lines(tables, F.col("section"), 100, F.array(F.lit(""), F.lit(wording["columns"]), F.lit(wording["rule"])))
    more = tables.where("omitted > 0").select("model", F.col("section").cast("long").alias("section"), (F.col("last").cast("long") + 103).alias("place"), say("omitted", F.col("omitted")).alias("line"))
    return _lines(head, F.lit(0), 0, top).unionByName(_lines(numbered, F.col("section"), 0, body)).unionByName(heads).unionByName(rows).unionByName(more)


def documents(lines: DataFrame) -> DataFrame:
    """model, markdown, sha256 of each document; a document is as long as its specifications and itemised entities are many."""
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section", "place", "line"))), lambda x: x["line"]), "\n")
    return lines.groupBy("model").agg(F.concat(whole, F.lit("\n")).alias("markdown")).withColumn("sha256", F.sha2("markdown", 256))


def write_documents(made: DataFrame, folder: str) -> None:
    """Adds the documents that aren't there yet, by model and hash, so that writing again changes nothing."""
    from trivalent.operators.projection import existing

    known = existing(made.sparkSession, folder)
    new = made if known is None else made.join(known.select("model", "sha256"), ["model", "sha256"], "left_anti")
    new.write.mode("append").parquet(folder)
