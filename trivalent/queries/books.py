"""Queries of book assembly: documents as books of their lines, read in chunks of four pages that share one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trivalent.functions.identity import page_id
from trivalent.operators import books
from trivalent.queries.corpus import LINES, document_lines


def _tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """One document in two has a fault, by its number modulo 22; one chunk in seven isn't completed; one document in five is read otherwise the second time."""
    lines = document_lines(spark, sf_dir).withColumn("m", F.col("doc_id") % 22)
    sizes = lines.groupBy("doc_id", "m").agg(F.count("*").alias("n"))
    sha = F.sha2(F.col("doc_id").cast("string"), 256)
    documents = sizes.select(F.col("doc_id").alias("document"), F.when(F.col("m") == 1, "failed").otherwise("ready").alias("state"), sha.alias("sha256"), F.when(F.col("m") == 2, F.col("n") + 1).otherwise(F.col("n")).alias("page_count"))
    chunks = sizes.where("m <> 3").select("doc_id", "m", "n", F.explode(F.expr("sequence(0L, greatest(0, n - 2) div 3)")).alias("k"))
    name = F.concat_ws("-", F.col("doc_id").cast("string"), F.col("k").cast("string"))
    order = F.expr("doc_id * 1000000 + k")  # orders are places in the sort of all chunks
    jobs = chunks.select(name.alias("job"), F.col("doc_id").alias("document"), order.alias("chunk_order"), F.when(F.col("m") == 4, F.lit("other")).otherwise(sha).alias("source_sha256"))
    spread = chunks.select("doc_id", "m", "n", "k", name.alias("job"), F.explode(F.expr("sequence(3 * k + 1, least(n, 3 * k + 4))")).alias("page"))
    number = F.when((F.col("m") == 5) & (F.col("page") == 1), F.lit(999)).otherwise(F.col("page")).cast("int")
    job_pages = spread.where("not (m = 6 and page = 2)").select("job", (F.col("page") - 3 * F.col("k")).alias("place"), "page", page_id(sha, number).alias("page_id"), ((F.col("k") > 0) & (F.col("page") == 3 * F.col("k") + 1) & (F.col("m") != 7)).alias("overlap"))
    ledger = chunks.where("not (m = 8 and k = 0)").select(name.alias("job"), F.when((F.col("doc_id") + F.col("k")) % 7 == 0, "failed").otherwise("completed").alias("status"))
    texts = spread.join(lines.select("doc_id", (F.col("place") + 1).alias("page"), "line"), ["doc_id", "page"])
    text = F.when((F.col("doc_id") % 5 == 0) & (F.col("k") > 0) & (F.col("page") == 3 * F.col("k") + 1), F.concat("line", F.lit("?"))).otherwise(F.col("line"))
    readings = texts.where("not (m = 6 and page = 2) and not (m = 9 and page = 1)").select("job", (F.col("page") - 3 * F.col("k")).alias("place"), page_id(sha, number).alias("page_id"), text.alias("text"))
    return {"documents": documents, "jobs": jobs, "job_pages": job_pages, "ledger": ledger, "readings": readings}


def book_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk orders here aren't places from 1 on, so that check is left to the tests."""
    return books.queue_faults(**_tables(spark, sf_dir)).where("fault <> 'CHUNK_ORDER'")


def _pages(t: dict[str, DataFrame]) -> DataFrame:
    return books.book_pages(t["jobs"], t["job_pages"], t["ledger"], t["readings"])


def book_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(_tables(spark, sf_dir)).select("document", "page", "chunk_order", "overlap", "text_sha256", "agrees")


def book_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _tables(spark, sf_dir)
    return books.books(t["documents"], _pages(t))


def assembly_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _tables(spark, sf_dir)
    return books.assembly_report(books.books(t["documents"], _pages(t)), t["ledger"])


QUERIES = {"book_faults": book_faults, "book_pages": book_pages, "book_list": book_list, "assembly_report": assembly_report}
_T = f"""with l as (select doc_id, doc_id % 22 as m, place + 1 as page, line from {LINES}), s as (select doc_id, m, count(*) as n from l group by 1, 2), d as (select doc_id, m, n + (m = 2)::int as page_count, n from s),
 c as (select doc_id, m, n, unnest(range(greatest(0, n - 2) // 3 + 1)) as k from s where m <> 3), led as (select *, (doc_id + k) % 7 <> 0 as done from c where not (m = 8 and k = 0)),
 p as (select doc_id, m, k, unnest(range(3 * k + 1, least(n, 3 * k + 4) + 1)) as page from c), jp as (select *, k > 0 and page = 3 * k + 1 and m <> 7 as overlap from p where not (m = 6 and page = 2)),
 r as (select p.doc_id, p.m, k, p.page, if(p.doc_id % 5 = 0 and k > 0 and p.page = 3 * k + 1, line || '?', line) as text from p join l on l.doc_id = p.doc_id and l.page = p.page where not (p.m = 6 and p.page = 2) and not (p.m = 9 and p.page = 1)),
 bp as (select jp.doc_id, jp.page, jp.k, overlap, sha256(text) as t from jp join led using (doc_id, k) join r on r.doc_id = jp.doc_id and r.k = jp.k and r.page = jp.page where done),
 o as (select doc_id, page, arg_min(t, k) as t, min(k) as k from bp where not overlap group by 1, 2), pages as (select bp.*, if(overlap and o.k < bp.k, bp.t = o.t, null) as agrees from bp left join o on o.doc_id = bp.doc_id and o.page = bp.page),
 bl as (select doc_id as document, page_count, count(page) filter (not overlap) as pages, count(page) filter (overlap) as overlaps, count(page) filter (not agrees) as disagreements from d left join pages using (doc_id) group by 1, 2)"""
ORACLES = {
    "book_faults": f"""{_T}, counted as (select doc_id, page, count(*) as n from jp where not overlap group by 1, 2), e as (select doc_id, unnest(range(1, page_count + 1)) as page from d)
 select doc_id::varchar as document, 'UNAVAILABLE' as fault, doc_id::varchar as item from d where m = 1 union all select doc_id::varchar, 'NOT_QUEUED', doc_id::varchar from d where m = 3 union all select doc_id::varchar, 'SOURCE_DIFFERS', doc_id || '-' || k from c where m = 4
 union all select doc_id::varchar, 'PAGE_ID_DIFFERS', '1' from jp where m = 5 and page = 1 union all select e.doc_id::varchar, 'PAGE_MISSING', e.page::varchar from e anti join counted using (doc_id, page) union all select doc_id::varchar, 'PAGE_REPEATED', page::varchar from counted where n > 1
 union all select doc_id::varchar, 'NOT_IN_LEDGER', doc_id || '-0' from c where m = 8 and k = 0 union all select doc_id::varchar, 'RESPONSE_PAGES', doc_id || '-0' from led where m = 9 and k = 0 and done""",
    "book_pages": f"{_T} select doc_id as document, page, doc_id * 1000000 + k as chunk_order, overlap, t as text_sha256, agrees from pages",
    "book_list": f"{_T} select *, pages = page_count as complete from bl",
    "assembly_report": f"""{_T}, ch as (select count(*) as chunks_expected, count(*) filter (done) as chunks_completed from led), su as (select count(*) as documents_expected, count(*) filter (pages = page_count) as documents_complete, sum(page_count)::bigint as pages_expected, sum(pages)::bigint as pages_completed, sum(disagreements)::bigint as disagreements from bl)
 select *, chunks_expected = chunks_completed and documents_expected = documents_complete as complete from ch cross join su""",
}
