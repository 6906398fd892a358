"""Queries of citations and observation contracts made from documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trivalent.operators import contracts, release, sidecars
from trivalent.queries.rules import table


def cited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with citations of themselves as JSON; nearly one in two has a fault, by its number modulo 26."""
    d, m = F.col("doc_id"), F.col("doc_id") % 26
    text = F.concat(F.lit("text "), d.cast("string"))
    some = lambda bad, value: F.when(m == bad, None).otherwise(value)
    anchors = F.array(F.concat(F.lit("s"), d.cast("string")))
    none = F.array().cast("array<string>")
    made = F.to_json(F.struct(
        F.when(m == 1, "").otherwise(F.lit("book")).alias("document_key"), F.sha2(F.lit("book"), 256).alias("document_sha256"), F.when(m == 2, 0).otherwise(1 + d % 9).alias("pdf_page"), F.when(m.isin(3, 10, 11, 12), none).otherwise(anchors).alias("source_node_ids"), F.when(m.isin(4, 10, 11, 12), none).otherwise(anchors).alias("source_span_ids"),
        text.alias("exact_text_fa"), F.sha2(F.when(m == 5, F.lit("other")).otherwise(text), 256).alias("exact_text_sha256"), F.when(m == 6, "lost").when(m == 7, "needs_review").otherwise("verified").alias("citation_status"), F.when(m == 8, "hearsay").when(m == 12, "transcript").alias("evidence_kind"),
        F.when(m == 10, "r1").alias("transcript_revision_id"), F.when(m.isin(10, 12), F.sha2(text, 256)).alias("transcript_sha256"),
    ))
    return table(spark, sf_dir, "documents").select("doc_id", some(9, F.when(m == 13, "[]").otherwise(made)).alias("citation"))


def citation_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contracts.citation_faults(cited(spark, sf_dir), "doc_id", "citation")


def contracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as rules that need two observations, of kinds by turns; some have none, repeated or unknown ones."""
    d = F.col("doc_id")
    kind = lambda shift: F.element_at(F.array(*map(F.lit, contracts.KINDS)), F.expr(f"cast((doc_id + {shift}) % 6 + 1 as int)"))
    first = F.struct(F.when(d % 17 == 1, "").otherwise("width").alias("observation_key"), F.when(d % 17 == 2, "smell").otherwise(kind(0)).alias("kind"), F.lit("mm").alias("unit"))
    second = F.struct(F.when(d % 17 == 3, "width").otherwise("height").alias("observation_key"), kind(1).alias("kind"), F.lit(None).cast("string").alias("unit"))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.format_string('{"rule_key": "r-%d"}', d).alias("rule"), F.format_string('{"pdf_page": %d, "book": "b"}', d % 9).alias("citation"), F.when(d % 17 != 4, F.array(first, second)).alias("observations"))
    return contracts.contracts(rows, "doc_id")


def observation_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contracted(spark, sf_dir).select("doc_id", "record_id", "citation_sha256", "status", "reason", "fault")


def contract_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values: a document's length as width, twice for one in five; a word or a truth value as height. One contract in 19 was tampered with."""
    made = contracted(spark, sf_dir).withColumn("record_id", F.expr("if(doc_id % 19 = 0, upper(record_id), record_id)"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    width = docs.select("doc_id", F.lit("width").alias("observation_key"), F.explode(F.array_repeat(F.col("n_chars").cast("string"), F.expr("if(doc_id % 5 = 0, 2, 1)"))).alias("value"))
    height = docs.select("doc_id", F.lit("height").alias("observation_key"), F.expr("if(n_chars % 2 = 0, 'true', 'word')").alias("value"))
    return contracts.resolve_contracts(made, width.unionByName(height), "doc_id").select("doc_id", "status", "available", "needed")


def compiled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as compiled rules; one in three cites a transcript, half of these without saying so."""
    d = F.col("doc_id")
    transcript = F.format_string('{"document_key":"b","document_sha256":"h","pdf_page":%d,"transcript_revision_id":"r%d","transcript_sha256":"t"%s}', d % 9, d % 5, F.when(d % 6 == 0, ',"evidence_kind":"transcript"').otherwise(""))
    graph = F.format_string('{"document_key":"b","document_sha256":"h","pdf_page":%d,"source_node_ids":["n"],"source_span_ids":["s"]}', d % 9)
    rows = table(spark, sf_dir, "documents").select("doc_id", F.format_string('{"rule_key":"r-%d","bounds":{"max":%d}}', d, d % 7).alias("rule"), F.concat(F.lit("<ids>"), F.coalesce("text", F.lit("")), F.lit("</ids>")).alias("ids_xml"), F.when(d % 3 == 0, transcript).otherwise(graph).alias("citation"))
    return sidecars.sidecars(rows, "doc_id", "1.2")


def rule_sidecars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compiled(spark, sf_dir).select("doc_id", "rule_id", F.sha2("sidecar", 256).alias("sidecar_sha256"), "evidence", "decision", "revision")


def sidecar_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules that their sidecar alone doesn't release: those of the source graph have no attestation."""
    return release.faults(compiled(spark, sf_dir)).groupBy("fault").agg(F.count("*").alias("rules"))


QUERIES = {"rule_sidecars": rule_sidecars, "sidecar_faults": sidecar_faults, "citation_faults": citation_faults, "observation_contracts": observation_contracts, "contract_status": contract_status}
_RULES = """with d as (select doc_id, n_chars, doc_id % 17 as m, ['geometry', 'formula', 'table', 'numeric', 'text', 'boolean'][doc_id % 6 + 1] as k1, ['geometry', 'formula', 'table', 'numeric', 'text', 'boolean'][(doc_id + 1) % 6 + 1] as k2 from documents),
 r as (select *, case m when 4 then 'NO_OBSERVATIONS' when 1 then 'INVALID_KEY' when 3 then 'REPEATED_KEY' when 2 then 'UNSUPPORTED_KIND' end as fault,
  e'{\\n  "book": "b",\\n  "pdf_page": ' || (doc_id % 9) || e'\\n}\\n' as c,
  e'{\\n  "required_observations": [\\n    {\\n      "kind": "' || k1 || e'",\\n      "observation_key": "width",\\n      "status": "PENDING",\\n      "unit": "mm"\\n    },\\n    {\\n      "kind": "' || k2 || e'",\\n      "observation_key": "height",\\n      "status": "PENDING",\\n      "unit": null\\n    }\\n  ],\\n  "rule": {\\n    "rule_key": "r-' || doc_id || e'"\\n  },\\n  "source_citation": {\\n    "book": "b",\\n    "pdf_page": ' || (doc_id % 9) || e'\\n  }\\n}\\n' as p from d)"""
_SIDECARS = """with d as (select doc_id, doc_id % 3 = 0 as tr, '<ids>' || coalesce(text, '') || '</ids>' as x, e'{\\n  "bounds": {\\n    "max": ' || (doc_id % 7) || e'\\n  },\\n  "rule_key": "r-' || doc_id || e'"\\n}\\n' as r from documents),
 c as (select *, sha256(r) as id, if(tr, e'{\\n  "document_key": "b",\\n  "document_sha256": "h",\\n  "evidence_kind": "transcript",\\n  "pdf_page": ' || (doc_id % 9) || e',\\n  "transcript_revision_id": "r' || (doc_id % 5) || e'",\\n  "transcript_sha256": "t"\\n}\\n',
  e'{\\n  "document_key": "b",\\n  "document_sha256": "h",\\n  "pdf_page": ' || (doc_id % 9) || e',\\n  "source_node_ids": [\\n    "n"\\n  ],\\n  "source_span_ids": [\\n    "s"\\n  ]\\n}\\n') as c from d),
 s as (select *, e'{\\n  "canonical_rule": ' || replace(trim(r, e'\\n'), e'\\n', e'\\n  ') || e',\\n  "compiler_version": "1.2",\\n  "ids_sha256": "' || sha256(x) || e'",\\n  "rule_id": "' || id || e'",\\n  "schema_version": "compiled-rule-1.0.0",\\n'
  || if(tr, e'  "source_attestation": {\\n    "decision": "transcript",\\n    "document_sha256": "h",\\n    "transcript_revision_id": "r' || (doc_id % 5) || e'",\\n    "transcript_sha256": "t"\\n  },\\n', '')
  || e'  "source_citation": ' || replace(trim(c, e'\\n'), e'\\n', e'\\n  ') || e',\\n  "source_citation_sha256": "' || sha256(c) || e'"\\n}\\n' as j from c)"""
ORACLES = {
    "rule_sidecars": f"{_SIDECARS} select doc_id, id as rule_id, sha256(j) as sidecar_sha256, if(tr, 'transcript', 'source_graph') as evidence, if(tr, 'transcript', null) as decision, if(tr, 'r' || (doc_id % 5), null) as revision from s",
    "sidecar_faults": "select 'NO_ATTESTATION' as fault, count(*) as rules from documents where doc_id % 3 <> 0",
    "citation_faults": """select doc_id, unnest(case doc_id % 26 when 1 then ['NO_DOCUMENT'] when 2 then ['NO_PAGE'] when 3 then ['NO_NODES'] when 4 then ['NO_SPANS'] when 5 then ['TEXT_HASH_DIFFERS'] when 6 then ['UNKNOWN_STATUS'] when 7 then ['NOT_VERIFIED'] when 8 then ['UNKNOWN_EVIDENCE'] when 9 then ['NO_CITATION']
 when 11 then ['NO_NODES', 'NO_SPANS'] when 12 then ['NO_REVISION'] when 13 then ['NOT_AN_OBJECT'] else [] end) as fault from documents""",
    "observation_contracts": f"{_RULES} select doc_id, if(fault is null, sha256(p), null) as record_id, if(fault is null, sha256(c), null) as citation_sha256, if(fault is null, 'DEFERRED', null) as status, if(fault is null, 'REQUIRES_DERIVED_OBSERVATIONS', null) as reason, fault from r",
    "contract_status": f"""{_RULES}, v as (select doc_id, (doc_id % 5 <> 0 and k1 in ('numeric', 'text'))::bigint + ((k2 = 'text') or (k2 = 'boolean' and n_chars % 2 = 0))::bigint as available from r where fault is null)
 select doc_id, if(doc_id % 19 = 0, 'CONTRACT_DIFFERS', if(available = 2, 'AVAILABLE', 'INDETERMINATE')) as status, available, 2::bigint as needed from v""",
}
