"""Queries of projections, histories, releases and publication, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trivalent.operators import projection, publication, release
from trivalent.queries.rules import table


def projection_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four pages of five as a snapshot, one of three as a delta with other titles and sizes; one of 21 claims another source."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.sha2("url", 256).alias("source_sha256"), F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1).alias("title"), F.octet_length("html").cast("long").alias("bytes"), F.regexp_extract("html", 'lang="(..)"', 1).alias("lang"))
    delta = pages.where("page_id % 3 = 0").select("page_id", F.expr("if(page_id % 21 = 0, upper(source_sha256), source_sha256)").alias("source_sha256"), F.expr("if(page_id % 9 = 0, '', title)").alias("title"), F.expr("if(page_id % 12 = 0, bytes + 1, bytes)").alias("bytes"), "lang")
    return projection.merged(pages.where("page_id % 5 <> 0"), delta, ["page_id"], ["source_sha256"], ["title", "bytes", "lang"])


def document_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources as documents, each told of by all its texts."""
    rows = table(spark, sf_dir, "documents").select(
        F.col("source").alias("document"), "doc_id", F.sha2(F.expr("if(source = 'src3' and doc_id % 2 = 0, 'other', source)"), 256).alias("sha256"), F.expr("case n_chars % 3 when 0 then '' when 1 then source else substring(text, 1, 12) end").alias("title"),
        F.expr("if(doc_id % 4 = 0, null, lang)").alias("language"), F.expr("if(doc_id % 2 = 0, map(concat('k', cast(doc_id % 5 as string)), lang), null)").alias("metadata"),
    )
    found = projection.document_rows(rows, "document", "doc_id", "sha256", ["title", "language"], "metadata", title="title")
    told = F.array_join(F.transform(F.map_entries("metadata"), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return found.select("document", "sha256", "title", "language", told.alias("metadata"), "sources", "conflict")


def origin_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts as stored paths, the first parts of their URLs' paths as origins; hosts of every fiftieth page are current, some pages tell another size."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "//([^/]*)", 1).alias("path"), F.regexp_extract("url", "//[^/]*/([^/?#]*)", 1).alias("first"))
    entries = pages.select("path", F.sha2("path", 256).alias("sha256"), (F.length("path") + F.when(F.col("page_id") % 97 == 0, 1).otherwise(0)).cast("long").alias("bytes"), F.to_json(F.struct(F.col("first").alias("area"))).alias("origin"))
    return projection.history(entries, pages.where("page_id % 50 = 0").select("path", F.sha2("path", 256).alias("sha256")), "path", "sha256", "bytes", "origin")


def rules_of_documents(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Documents as compiled rules, and a manifest of them; by number modulo 31 rules lack on either side, have other bytes, repeat, or aren't attested."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", (F.col("doc_id") % 31).alias("m"))
    text = F.coalesce("text", F.lit(""))
    right = docs.select(
        "m", F.concat(F.lit("rule-"), F.col("doc_id").cast("string")).alias("rule_id"), F.concat(F.lit("<ids>"), text, F.lit("</ids>")).alias("ids_xml"), F.concat(F.lit('{"lang":"'), F.coalesce("lang", F.lit("")), F.lit('"}')).alias("sidecar"), F.concat(F.lit('{"page":'), F.col("doc_id").cast("string"), F.lit("}")).alias("citation"),
        F.coalesce("source", F.lit("")).alias("document_key"), F.sha2(F.coalesce("source", F.lit("")), 256).alias("document_sha256"), F.expr("doc_id div 10").alias("page"), F.array(F.concat(F.lit("s"), F.expr("cast(doc_id div 2 as string)"))).alias("spans"),
    )
    manifest = right.where("m <> 2").drop("m")
    compiled = right.where("m <> 1").select(
        F.expr("if(m = 9, concat('../', rule_id), rule_id)").alias("rule_id"), F.expr("if(m = 3, concat(ids_xml, ' '), ids_xml)").alias("ids_xml"), F.expr("if(m = 4, lower(concat(sidecar, ' ')), sidecar)").alias("sidecar"), "citation", "document_key", "document_sha256", "page", "spans",
        F.expr("if(m = 10, 'other', null)").alias("declared_id"), F.expr("if(m = 11, 'other', null)").alias("declared_ids_sha256"), F.expr("case m when 6 then null when 8 then 'guessed' when 12 then 'transcript' when 13 then 'transcript' else 'anchored' end").alias("decision"),
        F.expr("case m when 6 then null when 7 then 'other' else document_sha256 end").alias("attested_sha256"), F.expr("if(m = 14, null, document_sha256)").alias("report_sha256"), F.expr("if(m = 13, 'transcript', 'source')").alias("evidence"), F.lit("r1").alias("attested_revision"), F.lit("r1").alias("revision"), "m",
    )
    compiled = compiled.withColumn("m", F.explode(F.expr("if(m = 5, array(1, 2), array(1))"))).drop("m")
    return compiled, release.entries(manifest)


def release_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return release.releasable(*rules_of_documents(spark, sf_dir))


def release_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    return release.root(rules_of_documents(spark, sf_dir)[1])


def release_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return release.coverage(rules_of_documents(spark, sf_dir)[1])


def passes(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Labelled documents as candidates of two passes in bundles of 20, and decisions on them: toxic ones are rejected, poor ones deferred, others merged by four; some bundles have faults."""
    rows = table(spark, sf_dir, "labels").select("doc_id", F.expr("cast(doc_id div 20 as string)").alias("bundle"), F.expr("(doc_id div 20) % 13").alias("fault"), F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("candidate"), F.concat(F.lit("t"), F.expr("cast(doc_id div 4 as string)")).alias("target"),
        F.expr("case when doc_id % 29 = 0 then 'none' when toxic = 1 then 'rejected' when quality = 0 then 'deferred' else 'merged' end").alias("decision"))
    both = rows.withColumn("pass", F.explode(F.expr("if(fault = 5 and doc_id % 20 < 3, array('a', 'b'), if(doc_id % 3 = 0, array('b'), array('a')))"))).select("bundle", "pass", "candidate")
    groups = rows.where("decision = 'merged'").groupBy("bundle", "target", "fault").agg(F.array_sort(F.collect_list("candidate")).alias("sources"), F.min("doc_id").alias("least"))
    at = F.expr("least div 4")
    accepted = groups.where("not (fault = 4 and (least div 4) % 5 = 0)").select("bundle", F.col("target").alias("candidate"), F.when(at % 7 == 0, F.array(F.lit("U"))).otherwise(F.array().cast("array<string>")).alias("uncertainty"), F.when(at % 11 == 0, F.array(F.lit("Q"))).otherwise(F.array().cast("array<string>")).alias("quality"))
    merges = groups.select("bundle", F.when(F.col("fault") == 3, F.lit("m")).otherwise(F.concat(F.lit("m-"), "target")).alias("merge"), F.col("target").alias("accepted"), F.when((F.col("fault") == 2) & (at % 5 == 1), F.concat("sources", F.array(F.lit("ghost")))).otherwise(F.col("sources")).alias("sources"))
    rejected = rows.where("decision = 'rejected' or (fault = 1 and decision = 'merged' and doc_id % 20 < 5)").select("bundle", "candidate")
    return {"candidates": both, "accepted": accepted, "merges": merges, "rejected": rejected, "deferred": rows.where("decision = 'deferred'").select("bundle", "candidate")}


def publication_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return publication.faults(**passes(spark, sf_dir))


def publication_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return publication.outcomes(**passes(spark, sf_dir))


def publication_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return publication.summary(**passes(spark, sf_dir))


QUERIES = {
    "projection_upsert": projection_upsert, "document_merge": document_merge, "origin_history": origin_history, "release_problems": release_problems, "release_root": release_root, "release_coverage": release_coverage,
    "publication_faults": publication_faults, "publication_outcomes": publication_outcomes, "publication_summary": publication_summary,
}

_RIGHT = """select doc_id % 31 as m, 'rule-' || doc_id as rule_id, '<ids>' || coalesce(text, '') || '</ids>' as ids_xml, '{"lang":"' || coalesce(lang, '') || '"}' as sidecar, '{"page":' || doc_id || '}' as citation, coalesce(source, '') as document_key, sha256(coalesce(source, '')) as document_sha256, doc_id // 10 as page, ['s' || (doc_id // 2)] as spans from documents"""
_ENTRIES = f"select rule_id, sha256(ids_xml) as ids_sha256, sha256(sidecar) as sidecar_sha256, sha256(citation) as citation_sha256, document_key, document_sha256, page, spans from ({_RIGHT}) where m <> 2"
_PASSES = """with l as (select doc_id, (doc_id // 20)::varchar as bundle, doc_id // 20 % 13 as fault, 'c' || doc_id as candidate, 't' || (doc_id // 4) as target, case when doc_id % 29 = 0 then 'none' when toxic = 1 then 'rejected' when quality = 0 then 'deferred' else 'merged' end as decision from labels),
 c as (select bundle, unnest(if(fault = 5 and doc_id % 20 < 3, ['a', 'b'], if(doc_id % 3 = 0, ['b'], ['a']))) as pass, candidate from l), g as (select bundle, target, fault, list(candidate order by candidate) as sources, min(doc_id) // 4 as place from l where decision = 'merged' group by 1, 2, 3),
 acc as (select bundle, target as candidate, place % 7 = 0 as uncertain, place % 11 = 0 as poor from g where not (fault = 4 and place % 5 = 0)), mer as (select bundle, if(fault = 3, 'm', 'm-' || target) as merge, target as accepted, if(fault = 2 and place % 5 = 1, list_append(sources, 'ghost'), sources) as sources from g),
 rej as (select bundle, candidate from l where decision = 'rejected' or (fault = 1 and decision = 'merged' and doc_id % 20 < 5)), def as (select bundle, candidate from l where decision = 'deferred'),
 refs as (select bundle, unnest(sources) as candidate, 'merged' as decision, accepted as target from mer union all select bundle, candidate, 'rejected', null from rej union all select bundle, candidate, 'deferred', null from def),
 faults as (select bundle, 'PASSES_OVERLAP' as fault, candidate as item from c group by bundle, candidate having count(distinct pass) > 1 union all select bundle, 'REPEATED_MERGE', merge from mer group by bundle, merge having count(*) > 1
  union all select bundle, 'TARGETS_DO_NOT_COVER', accepted from mer where (bundle, accepted) not in (select (bundle, candidate) from acc) union all select bundle, 'CLASSIFIED_TWICE', candidate from refs group by bundle, candidate having count(*) > 1
  union all select distinct bundle, 'UNKNOWN_CANDIDATE', candidate from refs where (bundle, candidate) not in (select (bundle, candidate) from c)),
 outcomes as (select bundle, candidate, case when reason is not null then 'deferred' when decision = 'rejected' then 'rejected' else 'rule' end as outcome, reason, if(wrong, null, target) as target from (select *, case when wrong then 'VALIDATOR_RECONCILIATION_FAILED' when decision is null then 'VALIDATOR_UNACCOUNTED_SOURCE_CANDIDATE'
   when decision = 'deferred' then 'VALIDATOR_DEFERRED' when decision = 'rejected' then null when poor then 'ACCEPTED_CANDIDATE_FAILED_QUALITY_GATE' when uncertain then 'ACCEPTED_CANDIDATE_HAS_UNCERTAINTY' end as reason
  from (select s.*, r.decision, r.target, a.uncertain, a.poor, s.bundle in (select bundle from faults) as wrong from (select distinct bundle, candidate from c) s left join (select bundle, candidate, min(decision) as decision, min(target) as target from refs group by 1, 2) r using (bundle, candidate) left join acc a on a.bundle = s.bundle and a.candidate = r.target)))"""
ORACLES = {
    "projection_upsert": """with p as (select page_id, sha256(url) as s, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) as t, octet_length(encode(html))::bigint as b, regexp_extract(html, 'lang="(..)"', 1) as l from pages),
 o as (select * from p where page_id % 5 <> 0), n as (select page_id, if(page_id % 21 = 0, upper(s), s) as s, if(page_id % 9 = 0, '', t) as t, if(page_id % 12 = 0, b + 1, b) as b, l from p where page_id % 3 = 0)
 select coalesce(o.page_id, n.page_id) as page_id, coalesce(o.s, n.s) as source_sha256, if(n.page_id is null or coalesce(o.s <> n.s, false), o.t, n.t) as title, if(n.page_id is null or coalesce(o.s <> n.s, false), o.b, n.b) as bytes, if(n.page_id is null or coalesce(o.s <> n.s, false), o.l, n.l) as lang,
 case when o.page_id is null then 'inserted' when n.page_id is null then 'kept' when o.s <> n.s then 'refused' when o.t is not distinct from n.t and o.b = n.b and o.l is not distinct from n.l then 'unchanged' else 'updated' end as change from o full join n on o.page_id = n.page_id""",
    "document_merge": """with r as (select source, doc_id, sha256(if(source = 'src3' and doc_id % 2 = 0, 'other', source)) as h, case n_chars % 3 when 0 then '' when 1 then source else substr(text, 1, 12) end as title, if(doc_id % 4 = 0, null, lang) as language, if(doc_id % 2 = 0, 'k' || doc_id % 5, null) as k, lang from documents),
 m as (select source, string_agg(k || '=' || v, ',' order by k) as metadata from (select source, k, arg_max(lang, doc_id) as v from r where k is not null group by 1, 2) group by 1)
 select source as document, min(h) as sha256, coalesce(arg_min(title, doc_id) filter (title <> '' and title <> source), arg_min(title, doc_id) filter (title <> '')) as title, arg_min(language, doc_id) filter (coalesce(language, '') <> '') as language, any_value(metadata) as metadata, count(*) as sources, min(h) <> max(h) as conflict from r left join m using (source) group by 1""",
    "origin_history": """with p as (select page_id, regexp_extract(url, '//([^/]*)', 1) as path, regexp_extract(url, '//[^/]*/([^/?#]*)', 1) as area from pages), e as (select path, length(path) + (page_id % 97 = 0)::int as bytes, to_json({'area': area})::varchar as origin from p),
 k as (select path, min(bytes) as bytes, count(distinct origin) as origins, min(bytes) <> max(bytes) as odd from e group by 1)
 select distinct path, origin, sha256(path) as sha256, k.bytes, origins, case when odd then 'conflict' when path in (select path from p where page_id % 50 = 0) then 'current' else 'history' end as state from e join k using (path)""",
    "release_problems": f"""with r as ({_RIGHT}), made as (select *, if(m = 9, '../' || rule_id, rule_id) as id, if(m = 3, ids_xml || ' ', ids_xml) as x, if(m = 4, lower(sidecar || ' '), sidecar) as y from r where m <> 1)
 select id as rule_id, unnest(case m when 6 then ['NO_ATTESTATION'] when 7 then ['ATTESTED_DOCUMENT_DIFFERS'] when 8 then ['NOT_ANCHORED'] when 9 then ['UNSAFE_ID'] when 10 then ['SIDECAR_ID_DIFFERS'] when 11 then ['IDS_HASH_DIFFERS'] when 12 then ['TRANSCRIPT_DIFFERS'] when 14 then ['NO_REPORT_HASH'] when 5 then ['REPEATED_RULE'] else [] end) as problem from made
 union all select rule_id, 'NOT_COMPILED' from r where m in (1, 9) union all select id, 'NOT_IN_MANIFEST' from made where m in (2, 9) union all select id, 'IDS_DIFFERS' from made where m = 3 union all select id, 'SIDECAR_DIFFERS' from made where m = 4""",
    "release_root": f"""with e as ({_ENTRIES}), a as (select sha256(rule_id) as d, to_json({{'rule_id': rule_id, 'ids_sha256': ids_sha256, 'sidecar_sha256': sidecar_sha256, 'citation_sha256': citation_sha256, 'document_key': document_key, 'document_sha256': document_sha256, 'page': page, 'spans': spans}})::varchar as x from e),
 b as (select d[:5] as d, sha256(string_agg(d || ' ' || x, e'\\n' order by d || ' ' || x)) as x, count(*) as n from a group by d[:5]), c as (select d[:2] as d, sha256(string_agg(d || ' ' || x, e'\\n' order by d || ' ' || x)) as x, sum(n) as n from b group by d[:2])
 select sha256(string_agg(d || ' ' || x, e'\\n' order by d || ' ' || x)) as root, sum(n)::bigint as rules from c""",
    "release_coverage": f"select count(*) as rules, count(distinct document_key) as documents, count(distinct spans[1]) as source_spans from ({_ENTRIES})",
    "publication_faults": f"{_PASSES} select bundle, fault, item from faults",
    "publication_outcomes": f"{_PASSES} select * from outcomes",
    "publication_summary": f"""{_PASSES}, s as (select bundle, count(*) as sources, count(*) filter (reason = 'VALIDATOR_UNACCOUNTED_SOURCE_CANDIDATE') as unaccounted, bundle in (select bundle from faults) as wrong from outcomes group by 1)
 select bundle, sources, if(wrong, 0, a) as accepted, if(wrong, 0, m) as merges, if(wrong, 0, r) as rejected, if(wrong, 1, d) as deferred, if(wrong, sources, unaccounted) as unaccounted, if(wrong or d > 0 or unaccounted > 0, 'needs_review', 'published') as state
 from (select *, (select count(*) from acc x where x.bundle = s.bundle) as a, (select count(*) from mer x where x.bundle = s.bundle) as m, (select count(*) from rej x where x.bundle = s.bundle) as r, (select count(*) from def x where x.bundle = s.bundle) as d from s)""",
}
