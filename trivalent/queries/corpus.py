"""Documents, pages and lines: routing, text views, edges, bundles, copies, multisets, thresholds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trivalent.functions import text, values
from trivalent.operators import pages, sets, windows
from trivalent.queries.rules import table

LINES = r"(select doc_id, generate_subscripts(a, 1) - 1 as place, unnest(a) as line from (select doc_id, string_split(text, e'\n') as a from documents))"
#: Two multisets of lines that together hold every document.
EVEN, ODD = f"(select * from {LINES} where doc_id % 2 = 0)", f"(select * from {LINES} where doc_id % 2 = 1)"


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.lines_of(table(spark, sf_dir, "documents"), "doc_id", "text")


def page_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digits of a text stand for a page's characters, its length and key for bitmaps and ink."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.length(F.regexp_replace("text", "[^0-9]", "")).alias("chars"), F.pmod(F.col("n_chars") * 7, F.lit(10_000)).alias("bitmap"), F.pmod("doc_id", F.lit(60)).alias("ink"))
    return docs.withColumn("r", pages.route(F.col("chars"), F.col("bitmap"), F.col("ink"))).select("doc_id", "r.classification", "r.route", "r.state")


ROUTE = """with p as (select doc_id, length(regexp_replace(text, '[^0-9]', '', 'g')) as chars, n_chars * 7 % 10000 as bitmap, doc_id % 60 as ink from documents),
 c as (select doc_id, case when chars = 0 and bitmap >= 8000 then 'image_scan' when chars = 0 and ink <= 30 then 'blank' when chars = 0 then 'degraded_photo' when chars < 20 then 'suspect_native' when bitmap >= 1000 then 'mixed' else 'native_text' end as classification from p)
 select doc_id, classification, case when classification in ('image_scan', 'degraded_photo') then 'ocr' when classification = 'blank' then 'none' when classification = 'native_text' then 'native' else 'native_plus_ocr' end as route,
 if(classification in ('degraded_photo', 'suspect_native'), 'needs_review', 'ready') as state from c"""


def route_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_route(spark, sf_dir).groupBy("classification", "route", "state").agg(F.count("*").alias("pages"))


def digit_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of documents written in Persian, Arabic and ASCII digits by turns, beside letters and separators, and the ASCII view of them."""
    plain = F.expr("cast(doc_id * 7919 + n_chars as string)")
    written = F.when(F.col("doc_id") % 3 == 0, F.translate(plain, "0123456789", text.PERSIAN_DIGITS)).when(F.col("doc_id") % 3 == 1, F.translate(plain, "0123456789", text.ARABIC_DIGITS)).otherwise(plain)
    return table(spark, sf_dir, "documents").select("doc_id", text.ascii_digits(F.concat(F.lit("ص "), written, F.lit("٫ م²"))).alias("digits"))


def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(text.normalize_search_text(F.col("text")), 256).alias("normalized_sha256"), text.normalization_changes(F.col("text"))["whitespace"].alias("lines_changed"))


def html_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1).alias("title"), F.size(pages.html_links(F.col("html"))).cast("long").alias("links"), F.length(pages.html_text(F.col("html"))).cast("long").alias("text_chars"))


def page_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").groupBy(values.canonical_origin(F.col("url")).alias("origin")).agg(F.count("*").alias("n_pages"), F.sum(F.octet_length("html")).alias("html_bytes"))


def link_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = document_lines(spark, sf_dir)
    return sets.multiset_diff(lines.where("doc_id % 2 = 0"), lines.where("doc_id % 2 = 1"), "line")


def multiset_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that occur on both sides, the nth copy with the nth."""
    lines = document_lines(spark, sf_dir).where("trim(line) <> ''").withColumn("at", F.col("doc_id") * 1_000_000 + F.col("place"))
    return sets.multiset_match(lines.where("doc_id % 2 = 0"), lines.where("doc_id % 2 = 1"), "line", "at").where("left_id is not null and right_id is not null")


def continuation_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.continuation_edges(document_lines(spark, sf_dir), "doc_id", "place", "line")


def bundle_pack(spark: SparkSession, sf_dir: str, max_pages: int = 3, max_bytes: int = 400) -> DataFrame:
    """Each document's lines as pages, empty ones without a package."""
    runs_on = lambda x: ~F.substring(F.rtrim(x), -1, 1).isin(list(windows.TERMINAL))
    lines = F.transform(F.split("text", "\n"), lambda x: F.struct(F.when(F.trim(x) != "", F.octet_length(x).cast("bigint")).alias("bytes"), ((F.trim(x) != "") & runs_on(x)).alias("runs_on")))
    docs = table(spark, sf_dir, "documents").where("text is not null")
    return docs.select("doc_id", F.posexplode(windows.bundles(lines, max_pages, max_bytes)).alias("bundle", "b")).select("doc_id", "bundle", F.col("b.first").alias("first_page"), F.col("b.last").alias("last_page"), "b.pages", "b.bytes")


def running_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.repeated_lines(document_lines(spark, sf_dir), "doc_id", 3)


def templated_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source the share of documents, in ten-thousandths, that hold a line which at least 3 documents of the source share."""
    docs = table(spark, sf_dir, "documents")
    lines = docs.select("source", "doc_id", F.explode(F.split("text", "\n")).alias("line")).where("trim(line) <> ''").distinct()
    shared = lines.groupBy("source", "line").agg(F.count("*").alias("n")).where("n >= 3").drop("n")
    hit = lines.join(shared, ["source", "line"]).select("source", "doc_id").distinct().groupBy("source").agg(F.count("*").alias("templated"))
    total = docs.groupBy("source").agg(F.count("*").alias("documents"))
    return total.join(hit, "source", "left").fillna(0, ["templated"]).withColumn("permyriad", F.floor(F.col("templated") * 10_000 / F.col("documents")))


def dedup_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sets.first_wins(table(spark, sf_dir, "documents").select("doc_id", "text"), F.sha2("text", 256), ["doc_id"])
    return rows.select("doc_id", F.col("first.doc_id").alias("kept_of"), "copies")


def dup_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("sha256")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc")).where("copies > 1")


def otsu_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    histogram = table(spark, sf_dir, "part").groupBy(F.col("p_size").cast("long").alias("level")).agg(F.count("*").alias("n"))
    return pages.otsu(histogram, "level", "n")


def turn_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per conversation: turns, and changes of role between neighbouring turns."""
    marked = table(spark, sf_dir, "conversations").withColumn("before", F.expr("lag(role) over (partition by conv_id order by turn)"))
    return marked.groupBy("conv_id").agg(F.count("*").alias("turns"), F.count_if(F.col("before") != F.col("role")).alias("changes"))


TEXT_SQL = r"""trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '[ \t\r\n\f]+', ' ', 'g'))"""
QUERIES = {
    "page_route": page_route, "route_counts": route_counts, "digit_view": digit_view, "normalize_text": normalize_text, "html_project": html_project, "page_hosts": page_hosts, "link_diff": link_diff, "multiset_merge": multiset_merge,
    "continuation_edges": continuation_edges, "bundle_pack": bundle_pack, "running_headers": running_headers, "templated_sources": templated_sources, "dedup_first_wins": dedup_first_wins, "dup_groups": dup_groups, "otsu_threshold": otsu_threshold, "turn_edges": turn_edges,
}
ORACLES = {
    "page_route": ROUTE,
    "route_counts": f"select classification, route, state, count(*) as pages from ({ROUTE}) group by all",
    "digit_view": "select doc_id, 'ص ' || (doc_id * 7919 + n_chars) || '٫ م²' as digits from documents",
    "html_project": f"select page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) as title, len(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) as links, length({TEXT_SQL}) as text_chars from pages",
    "page_hosts": "select lower(regexp_extract(url, '^(https?://[^/?#]+)', 1)) as origin, count(*) as n_pages, sum(strlen(html))::bigint as html_bytes from pages group by 1",
    "link_diff": f"with l as (select line from {EVEN}), r as (select line from {ODD}) select line, 'left' as side, count(*) as n from (select * from l except all select * from r) group by 1 union all select line, 'right', count(*) from (select * from r except all select * from l) group by 1",
    "multiset_merge": f"""with l as (select line, doc_id * 1000000 + place as key from {EVEN} where trim(line) <> ''), r as (select line, doc_id * 1000000 + place as key from {ODD} where trim(line) <> '')
 select a.line, a.nth, a.key as left_id, b.key as right_id from (select *, row_number() over (partition by line order by key) as nth from l) a join (select *, row_number() over (partition by line order by key) as nth from r) b using (line, nth)""",
    "continuation_edges": f"select doc_id, place as from_place, place + 1 as to_place from (select *, lead(place) over (partition by doc_id order by place) as after from {LINES}) where after is not null and rtrim(line) <> '' and strpos('.!?:;؟؛۔', right(rtrim(line), 1)) = 0",
    "running_headers": f"select line, count(distinct doc_id) as n_keys from {LINES} where trim(line) <> '' group by 1 having count(distinct doc_id) >= 3",
    "templated_sources": r"""with l as (select distinct source, doc_id, unnest(string_split(text, e'\n')) as line from documents), k as (select source, line from l where trim(line) <> '' group by 1, 2 having count(*) >= 3),
 h as (select source, count(distinct doc_id) as templated from l join k using (source, line) group by 1) select source, count(*) as documents, coalesce(any_value(templated), 0) as templated, floor(coalesce(any_value(templated), 0) * 10000 / count(*))::bigint as permyriad from documents left join h using (source) group by 1""",
    "dedup_first_wins": "select doc_id, min(doc_id) over (partition by text) as kept_of, count(*) over (partition by text) as copies from documents",
    "dup_groups": "select sha256(text) as sha256, count(*) as copies, min(doc_id) as first_doc, max(doc_id) as last_doc from documents group by 1 having count(*) > 1",
    "otsu_threshold": """with h as (select p_size::bigint as level, count(*) as n from part group by 1), w as (select level, sum(n) over (order by level) as n0, sum(n * level) over (order by level) as m0, sum(n) over () as n, sum(n * level) over () as m from h)
 select level as threshold from w where n0 < n order by (m * n0 - m0 * n)::double ^ 2 / (n0 * (n - n0))::double desc, level limit 1""",
    "turn_edges": "select conv_id, count(*) as turns, count(*) filter (before <> role) as changes from (select *, lag(role) over (partition by conv_id order by turn) as before from conversations) group by 1",
}
