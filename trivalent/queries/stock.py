"""Queries of catalogues and inventories: documents as artifacts, with files that are missing, foreign or different."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trivalent.operators import catalog
from trivalent.queries.rules import table


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"))
    path, d = F.concat(F.lit("f/"), F.col("doc_id").cast("string")), F.col("doc_id")
    review = F.when(d % 6 == 0, "needs_review").otherwise("accepted")
    flags = F.when((d % 6 == 0) & (d % 4 != 0), F.array(F.lit("edition"))).when(d % 25 == 1, F.array(F.lit("stray"))).otherwise(F.array().cast("array<string>"))
    wanted = docs.where("doc_id % 7 <> 0").select(d.cast("string").alias("key"), path.alias("path"), F.lit(catalog.PDF).alias("media_type"), "sha256", F.col("n_chars").alias("bytes"), (d % 50 + 1).alias("pages"), review.alias("review_status"), flags.alias("review_flags"))
    there = docs.where("doc_id % 5 <> 0").select(path.alias("path"), F.when(d % 13 == 1, "text/html").otherwise(catalog.PDF).alias("media_type"), F.when(d % 11 == 2, F.upper("sha256")).otherwise(F.col("sha256")).alias("sha256"), F.when(d % 17 == 3, F.col("n_chars") + 1).otherwise(F.col("n_chars")).alias("bytes"), F.when(d % 19 == 4, 0).otherwise(d % 50 + 1).alias("pages"))
    return wanted, there


def inventory_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.records(*_sides(spark, sf_dir)).select("path", "key", "present", "pages", "state", "error", "review_status", F.array_join("review_flags", ",").alias("flags"))


def inventory_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.summary(catalog.records(*_sides(spark, sf_dir)))


def inventory_blockers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.blockers(catalog.records(*_sides(spark, sf_dir)))


def inventory_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records after someone set every eighth ready and every tenth absent."""
    rows = catalog.records(*_sides(spark, sf_dir)).withColumn("_n", F.regexp_extract("path", "([0-9]+)", 1).cast("long"))
    return catalog.incoherent(rows.withColumn("state", F.expr("if(_n % 8 = 0, 'ready', state)")).withColumn("present", F.expr("present and _n % 10 <> 1")))


def page_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of documents of up to 50 pages, by two ranges, or whole where there is none."""
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 50).alias("page_count"))
    ranges = docs.where("doc_id % 3 <> 0").select("doc_id", F.inline(F.array(F.struct(F.lit(1).cast("long").alias("start"), F.expr("page_count div 4").alias("end")), F.struct(F.expr("page_count div 2").alias("start"), F.expr("page_count").alias("end")))))
    return catalog.selected_pages(ranges, docs, "doc_id")


def range_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 50).alias("page_count"))
    ranges = docs.select("doc_id", F.inline(F.array(F.struct(F.expr("doc_id % 4").alias("start"), F.expr("doc_id % 9").alias("end")), F.struct(F.expr("doc_id % 12").alias("start"), F.expr("doc_id % 12 + doc_id % 41").alias("end")))))
    return catalog.range_faults(ranges, docs.where("doc_id % 23 <> 0"), "doc_id")


QUERIES = {"inventory_records": inventory_records, "inventory_summary": inventory_summary, "inventory_blockers": inventory_blockers, "inventory_faults": inventory_faults, "page_selection": page_selection, "range_faults": range_faults}
_R = """with d as (select doc_id as n, doc_id % 7 <> 0 as w, doc_id % 5 <> 0 as f, n_chars from documents),
 r as (select n, 'f/' || n as path, if(w, n::varchar, null) as key, f as present, if(f and n % 13 <> 1, if(n % 19 = 4, 0, n % 50 + 1), null) as pages, if(f, if(n % 17 = 3, n_chars + 1, n_chars), null) as bytes, n % 13 = 1 as html,
  case when not f then 'EXPECTED_ARTIFACT_MISSING' when not w then 'UNACCOUNTED_ARTIFACT' when n % 13 = 1 then 'MEDIA_TYPE_MISMATCH' when n % 11 = 2 then 'SOURCE_HASH_MISMATCH' when n % 17 = 3 then 'BYTE_COUNT_MISMATCH' when n % 19 = 4 then 'PAGE_COUNT_MISMATCH' end as error,
  if(not w or n % 6 = 0, 'needs_review', 'accepted') as review_status, case when not w then 'not in the catalogue' when n % 6 = 0 and n % 4 <> 0 then 'edition' when n % 25 = 1 then 'stray' else '' end as flags from d where w or f)"""
ORACLES = {
    "inventory_records": f"{_R} select path, key, present, pages, if(error is null, 'ready', 'quarantined') as state, error, review_status, flags from r",
    "inventory_summary": f"""{_R} select count(key) as expected_artifacts, count(*) filter (present) as files_discovered, count(*) filter (present and key is not null) as artifacts_accounted, count(*) filter (error is null) as valid_pdfs, count(*) filter (error is not null) as quarantined, count(*) filter (not present) as missing,
 count(*) filter (error = 'UNACCOUNTED_ARTIFACT') as unaccounted, count(*) filter (review_status = 'needs_review') as needs_review, coalesce(sum(pages) filter (error is null), 0)::bigint as pdf_pages, coalesce(sum(bytes) filter (error is null), 0)::bigint as bytes from r""",
    "inventory_blockers": f"{_R} select path, error as code from r where error is not null union all select path, 'NEEDS_REVIEW' from r where review_status = 'needs_review'",
    "inventory_faults": f"""{_R}, s as (select *, present as was, present and n % 10 <> 1 as there, n % 8 = 0 or error is null as ready, n % 8 = 0 as forced from r)
 select path, 'READY_WITH_ERROR' as fault from s where ready and error is not null union all select path, 'READY_NOT_A_PRESENT_PDF' from s where ready and (not there or not was or html) union all select path, 'READY_WITHOUT_FACTS' from s where ready and (pages is null or not was)
 union all select path, 'READY_UNAPPROVED' from s where ready and (not was or key is null or n % 11 = 2 or n % 17 = 3 or html or n % 19 = 4) union all select path, 'ABSENT_WITHOUT_REASON' from s where not there and error is distinct from 'EXPECTED_ARTIFACT_MISSING'
 union all select path, 'ABSENT_WITH_FACTS' from s where not there and was union all select path, 'UNAPPROVED_BYTES' from s where there and key is not null and n % 11 = 2 and (ready or error <> 'SOURCE_HASH_MISMATCH')
 union all select path, 'ACCEPTED_WITH_FLAGS' from s where review_status = 'accepted' and flags <> '' union all select path, 'REVIEW_WITHOUT_FLAGS' from s where review_status = 'needs_review' and flags = ''""",
    "page_selection": """with d as (select doc_id, doc_id % 50 as n from documents), r as (select doc_id, 1 as a, n // 4 as b from d where doc_id % 3 <> 0 union all select doc_id, n // 2, n from d where doc_id % 3 <> 0 union all select doc_id, 1, n from d where doc_id % 3 = 0)
 select doc_id, unnest(range(a, b + 1)) as page from r where a <= b""",
    "range_faults": """with d as (select doc_id, doc_id % 50 as n from documents), r as (select doc_id, n, doc_id % 4 as start, doc_id % 9 as "end" from d union all select doc_id, n, doc_id % 12, doc_id % 12 + doc_id % 41 from d),
 o as (select *, lag("end") over (partition by doc_id order by start, "end") as before from r),
 f as (select doc_id, start, "end", case when start < 1 then 'NOT_POSITIVE' when "end" < start then 'TURNED' when start <= before then 'NOT_DISJOINT' when doc_id % 23 = 0 then 'UNKNOWN_DOCUMENT' when "end" > n then 'BEYOND_THE_END' end as fault from o) select * from f where fault is not null""",
}
