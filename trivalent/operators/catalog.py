"""Catalogues against what is stored: selections, inventories with states and errors, their coherence, summaries and blockers.

catalog: key, path, media_type, sha256, bytes, pages, review_status, review_flags. files: path, media_type, sha256, bytes,
pages (of PDFs). Paths are unique on each side. Records are the full outer join of both by path, with a state
and the first error that holds; every check is a predicate on a record, every summary one aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PDF = "application/pdf"
MISSING, UNACCOUNTED = "EXPECTED_ARTIFACT_MISSING", "UNACCOUNTED_ARTIFACT"
HASH_DIFFERS = "SOURCE_HASH_MISMATCH"
COUNTS = ("expected_artifacts", "files_discovered", "artifacts_accounted", "valid_pdfs", "quarantined", "missing", "unaccounted", "needs_review", "pdf_pages", "bytes")


def selected(artifacts: DataFrame, keys: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The artifacts that keys name (all, if there are no keys), and faults of the keys: key, fault (REPEATED or UNKNOWN)."""
    repeated = keys.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(key, F.lit("REPEATED").alias("fault"))
    unknown = keys.select(key).distinct().join(artifacts.select(key), key, "left_anti").select(key, F.lit("UNKNOWN").alias("fault"))
    chosen = artifacts if keys.isEmpty() else artifacts.join(keys.select(key).distinct(), key, "left_semi")
    return chosen, repeated.unionByName(unknown)


def range_faults(ranges: DataFrame, documents: DataFrame, key: str) -> DataFrame:
    """key, start, end, fault of page ranges (key, start, end): not from 1 on, turned, not disjoint in order, or beyond the document's page_count."""
    before = F.max("end").over(Window.partitionBy(key).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1))
    placed = ranges.withColumn("_before", before).join(documents.select(key, "page_count"), key, "left")
    fault = F.when(F.col("start") < 1, "NOT_POSITIVE").when(F.col("end") < F.col("start"), "TURNED").when(F.col("start") <= F.col("_before"), "NOT_DISJOINT").when(F.col("page_count").isNull(), "UNKNOWN_DOCUMENT").when(F.col("end") > F.col("page_count"), "BEYOND_THE_END")
    return placed.withColumn("fault", fault).where("fault is not null").select(key, "start", "end", "fault")


def selected_pages(ranges: DataFrame, documents: DataFrame, key: str) -> DataFrame:
    """key, page of every page of the ranges; of documents without a range all pages."""
    whole = documents.join(ranges.select(key).distinct(), key, "left_anti").where("page_count > 0").select(key, F.lit(1).cast("long").alias("start"), F.col("page_count").cast("long").alias("end"))
    every = ranges.select(key, F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end")).where("start <= end").unionByName(whole)
    return every.select(key, F.explode(F.sequence("start", "end")).alias("page"))


def records(catalog: DataFrame, files: DataFrame) -> DataFrame:
    """key, path, present, media_type, sha256, bytes, pages, expected ones, review, state and error of every artifact and file."""
    wanted = catalog.select("path", "key", F.col("media_type").alias("expected_media_type"), F.col("sha256").alias("expected_sha256"), F.col("bytes").alias("expected_bytes"), F.col("pages").alias("expected_pages"), "review_status", "review_flags")
    found = files.select("path", "media_type", "sha256", "bytes", F.when(F.col("media_type") == PDF, F.col("pages")).alias("pages"), F.lit(True).alias("present"))
    both = wanted.join(found, "path", "full").withColumn("present", F.coalesce("present", F.lit(False)))
    differs = lambda name: ~F.col(name).eqNullSafe(F.col(f"expected_{name}"))
    error = F.when(~F.col("present"), MISSING).when(F.col("key").isNull(), UNACCOUNTED).when(differs("media_type"), "MEDIA_TYPE_MISMATCH").when(differs("sha256"), HASH_DIFFERS).when(differs("bytes"), "BYTE_COUNT_MISMATCH").when(differs("pages"), "PAGE_COUNT_MISMATCH")
    out = both.withColumn("error", error).withColumn("state", F.when(F.col("error").isNull(), "ready").otherwise("quarantined"))
    return out.withColumn("review_status", F.coalesce("review_status", F.lit("needs_review"))).withColumn("review_flags", F.coalesce("review_flags", F.when(F.col("key").isNull(), F.array(F.lit("not in the catalogue"))), F.array().cast("array<string>")))


def _listed(rows: DataFrame, name: str, rules: dict[str, Column], *columns: str) -> DataFrame:
    return rows.select(*columns, F.explode(F.array_compact(F.array(*(F.when(F.coalesce(rule, F.lit(False)), code) for code, rule in rules.items())))).alias(name))


def incoherent(rows: DataFrame) -> DataFrame:
    """path, fault of records whose state, error, metadata and review don't go together."""
    c = F.col
    ready, no_pdf = c("state") == "ready", ~c("media_type").eqNullSafe(PDF)
    rules = {
        "READY_WITH_ERROR": ready & c("error").isNotNull(),
        "READY_NOT_A_PRESENT_PDF": ready & (~c("present") | no_pdf),
        "READY_WITHOUT_FACTS": ready & (c("pages").isNull() | c("sha256").isNull() | c("bytes").isNull()),
        "READY_UNAPPROVED": ready & ~(c("sha256").eqNullSafe(c("expected_sha256")) & c("bytes").eqNullSafe(c("expected_bytes")) & c("pages").eqNullSafe(c("expected_pages"))),
        "QUARANTINED_WITHOUT_ERROR": (c("state") == "quarantined") & c("error").isNull(),
        "PENDING_WITH_ERROR": (c("state") == "pending") & c("error").isNotNull(),
        "ABSENT_WITHOUT_REASON": ~c("present") & ~c("error").eqNullSafe(MISSING),
        "ABSENT_WITH_FACTS": ~c("present") & (c("media_type").isNotNull() | c("pages").isNotNull() | c("sha256").isNotNull() | c("bytes").isNotNull()),
        "PAGES_OF_NO_PDF": no_pdf & c("pages").isNotNull(),
        "UNAPPROVED_BYTES": c("present") & (c("sha256") != c("expected_sha256")) & ((c("state") != "quarantined") | ~c("error").eqNullSafe(HASH_DIFFERS)),
        "ACCEPTED_WITH_FLAGS": (c("review_status") == "accepted") & (F.size("review_flags") > 0),
        "REVIEW_WITHOUT_FLAGS": (c("review_status") == "needs_review") & (F.coalesce(F.size("review_flags"), F.lit(0)) <= 0),
    }
    return _listed(rows, "fault", rules, "path")


def blockers(rows: DataFrame) -> DataFrame:
    """path, code of everything that keeps a record out of a published corpus: its error (or a state that isn't final), and an open review."""
    state = F.when(F.col("state") != "ready", F.coalesce("error", F.lit("NONTERMINAL_STATE")))
    review = F.when(F.col("review_status") == "needs_review", "NEEDS_REVIEW")
    return rows.select("path", F.explode(F.array_compact(F.array(state, review))).alias("code"))


def summary(rows: DataFrame) -> DataFrame:
    """One row with COUNTS, in one pass."""
    c = F.col
    valid = (c("state") == "ready") & (c("media_type") == PDF)
    counts = {
        "expected_artifacts": F.count("key"), "files_discovered": F.count_if("present"), "artifacts_accounted": F.count_if(c("present") & c("key").isNotNull()), "valid_pdfs": F.count_if(valid), "quarantined": F.count_if(c("state") == "quarantined"),
        "missing": F.count_if(c("error") == MISSING), "unaccounted": F.count_if(c("error") == UNACCOUNTED), "needs_review": F.count_if(c("review_status") == "needs_review"),
        "pdf_pages": F.coalesce(F.sum(F.when(valid, c("pages")).cast("long")), F.lit(0)), "bytes": F.coalesce(F.sum(F.when(valid, c("bytes")).cast("long")), F.lit(0)),
    }
    return rows.agg(*(counts[name].cast("long").alias(name) for name in COUNTS))


def false_summary(declared: DataFrame, rows: DataFrame) -> DataFrame:
    """count, declared, counted wherever a declared summary isn't what the records come to."""
    long = lambda df, name: df.select(F.inline(F.array(*(F.struct(F.lit(n).alias("count"), F.col(n).cast("long").alias(name)) for n in COUNTS))))
    return long(declared, "declared").join(long(summary(rows), "counted"), "count").where("not (declared <=> counted)")
