"""Books assembled from the readings of their chunks: which queue may be assembled at all, who owns each page, what is complete.

documents: document, state, sha256, page_count. jobs: job, document, chunk_order, source_sha256.
job_pages: job, place (order in the job), page, page_id, overlap (the page is the last chunk's, read again).
ledger: job, status. readings: job, place, page_id, text. Everything meets by document, job or page; a
book is never one value.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trivalent.functions.identity import page_id


def _named(rows: DataFrame, fault: str, item: str) -> DataFrame:
    return rows.select(F.col("document").cast("string").alias("document"), F.lit(fault).alias("fault"), F.col(item).cast("string").alias("item"))


def queue_faults(documents: DataFrame, jobs: DataFrame, job_pages: DataFrame, ledger: DataFrame, readings: DataFrame) -> DataFrame:
    """document, fault, item: why nothing may be assembled. Completed jobs must have readings of just their pages, in order."""
    several = documents.groupBy("document").agg(F.count("*").alias("n")).where("n > 1")
    known = documents.dropDuplicates(["document"])
    own = jobs.join(known.select("document", "sha256", "page_count"), "document")
    pages = job_pages.join(own.select("job", "document", "sha256", "page_count"), "job")
    counted = pages.where("not overlap").groupBy("document", "page").agg(F.count("*").alias("n"))
    expected = known.select("document", F.explode(F.sequence(F.lit(1).cast("long"), F.col("page_count"))).alias("page")).where("page <= page_count")
    orders = jobs.groupBy("chunk_order").agg(F.count("*").alias("n"), F.min("document").alias("document"), F.min("job").alias("job"))
    total = jobs.agg(F.count("*").alias("jobs"))
    done = ledger.where("status = 'completed'").select("job").join(jobs.select("job", "document"), "job")
    asked = done.join(job_pages.select("job", "place", F.col("page_id").alias("asked")), "job")
    given = done.join(readings.select("job", "place", F.col("page_id").alias("given")), "job")
    differing = asked.join(given.drop("document"), ["job", "place"], "left").where("not (asked <=> given)").select("document", "job").union(given.join(asked.drop("document"), ["job", "place"], "left_anti").select("document", "job")).distinct()
    limit = orders.join(F.broadcast(total), F.col("chunk_order").isNull() | (F.col("chunk_order") < 1) | (F.col("chunk_order") > F.col("jobs")) | (F.col("n") > 1))
    rows = [
        _named(documents.where("not (state <=> 'ready')"), "UNAVAILABLE", "document"), _named(several, "REPEATED_DOCUMENT", "document"), _named(known.join(jobs, "document", "left_anti"), "NOT_QUEUED", "document"), _named(jobs.join(known, "document", "left_anti"), "UNKNOWN_DOCUMENT", "job"),
        _named(own.where("not (source_sha256 <=> sha256)"), "SOURCE_DIFFERS", "job"), _named(pages.where(~F.col("page_id").eqNullSafe(page_id(F.col("sha256"), F.col("page").cast("int")))), "PAGE_ID_DIFFERS", "page"),
        _named(expected.join(counted, ["document", "page"], "left_anti"), "PAGE_MISSING", "page"), _named(counted.where("n > 1"), "PAGE_REPEATED", "page"), _named(counted.join(expected, ["document", "page"], "left_anti"), "UNKNOWN_PAGE", "page"),
        _named(jobs.join(ledger, "job", "left_anti"), "NOT_IN_LEDGER", "job"), _named(limit, "CHUNK_ORDER", "job"), _named(differing, "RESPONSE_PAGES", "job"),
    ]
    return reduce(DataFrame.unionByName, rows)


def book_pages(jobs: DataFrame, job_pages: DataFrame, ledger: DataFrame, readings: DataFrame) -> DataFrame:
    """Every page read by a completed chunk: document, page, page_id, chunk_order, overlap, text_sha256, agrees.

    agrees: of an overlap, whether it is the reading of its owner, an earlier completed chunk; null without one.
    """
    done = ledger.where("status = 'completed'").select("job").join(jobs.select("job", "document", "chunk_order"), "job")
    read = done.join(job_pages, "job").join(readings.select("job", "page_id", F.sha2("text", 256).alias("text_sha256")), ["job", "page_id"]).select("document", "page", "page_id", "chunk_order", "overlap", "text_sha256")
    owners = read.where("not overlap").groupBy("document", "page").agg(F.min_by("text_sha256", "chunk_order").alias("_text"), F.min("chunk_order").alias("_order"))
    joined = read.join(owners, ["document", "page"], "left")
    agrees = F.when(F.col("overlap") & (F.col("_order") < F.col("chunk_order")), F.col("text_sha256").eqNullSafe(F.col("_text")))
    return joined.select("document", "page", "page_id", "chunk_order", "overlap", "text_sha256", agrees.alias("agrees"))


def books(documents: DataFrame, pages: DataFrame) -> DataFrame:
    """document, page_count, pages (owned and read), overlaps, disagreements, complete (all pages from 1 on are read)."""
    read = pages.groupBy("document").agg(F.count_if(~F.col("overlap")).alias("pages"), F.count_if("overlap").alias("overlaps"), F.count_if(~F.coalesce("agrees", F.lit(True))).alias("disagreements"))
    found = documents.select("document", "page_count").join(read, "document", "left").fillna(0, ["pages", "overlaps", "disagreements"])
    return found.withColumn("complete", F.col("pages") == F.col("page_count"))


def assembly_report(found: DataFrame, ledger: DataFrame) -> DataFrame:
    """One row: chunks and documents expected and done, pages expected and done, disagreements, and whether all is complete."""
    chunks = ledger.agg(F.count("*").alias("chunks_expected"), F.count_if(F.col("status") == "completed").alias("chunks_completed"))
    sums = found.agg(F.count("*").alias("documents_expected"), F.count_if("complete").alias("documents_complete"), F.coalesce(F.sum("page_count"), F.lit(0)).alias("pages_expected"), F.coalesce(F.sum("pages"), F.lit(0)).alias("pages_completed"), F.coalesce(F.sum("disagreements"), F.lit(0)).alias("disagreements"))
    one = lambda df: df.withColumn("_one", F.lit(1))
    joined = one(chunks).join(one(sums), "_one").drop("_one")
    return joined.withColumn("complete", (F.col("chunks_expected") == F.col("chunks_completed")) & (F.col("documents_expected") == F.col("documents_complete")))
