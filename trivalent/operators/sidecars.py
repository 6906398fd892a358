"""Sidecars of compiled rules: what a rule file was made from, in canonical JSON, with the hashes that a release derives anew."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trivalent.functions.identity import canonical_json
from trivalent.operators.contracts import CITATION, evidence_kind

#: Fixed value: the form of a sidecar.
FORM = "compiled-rule-1.0.0"


def _text(value: Column) -> Column:
    """A JSON string of a value, or null."""
    return F.coalesce(F.regexp_extract(F.to_json(F.struct(value.cast("string").alias("x"))), r'(?s)^\{"x":(.*)\}$', 1), F.lit("null"))


def rule_id(rule: Column) -> Column:
    """A rule's identity: the hash of its canonical JSON."""
    return F.sha2(canonical_json(rule), 256)


def sidecars(compiled: DataFrame, key: str, compiler_version: str) -> DataFrame:
    """key, rule_id, sidecar (canonical JSON) and what a release reads of it: ids_xml, citation, document_key, document_sha256, page, spans, declared_id,
    declared_ids_sha256, decision, attested_sha256, attested_revision, revision, evidence, report_sha256 (null: the sidecar attests transcripts alone).

    compiled: key, rule and citation (JSON objects as texts), ids_xml. A citation that infers its transcript says so in the sidecar.
    """
    read = compiled.withColumn("_c", F.from_json("citation", CITATION))
    kind = evidence_kind(F.col("_c"))
    told = F.coalesce(F.col("_c.evidence_kind") != "", F.lit(False))
    said = F.when((kind == "transcript") & ~told, F.regexp_replace(F.rtrim("citation"), r"\}$", ',"evidence_kind":"transcript"}')).otherwise(F.col("citation"))
    read = read.withColumn("_citation", canonical_json(said)).withColumn("rule_id", rule_id(F.col("rule"))).withColumn("evidence", kind)
    attested = F.col("evidence") == "transcript"
    attestation = F.concat(F.lit(',"source_attestation":{"decision":"transcript","document_sha256":'), _text(F.col("_c.document_sha256")), F.lit(',"transcript_revision_id":'), _text(F.col("_c.transcript_revision_id")), F.lit(',"transcript_sha256":'), _text(F.col("_c.transcript_sha256")), F.lit("}"))
    made = F.concat(
        F.lit(f'{{"schema_version":"{FORM}","rule_id":'), _text(F.col("rule_id")), F.lit(',"compiler_version":'), _text(F.lit(compiler_version)), F.lit(',"ids_sha256":'), _text(F.sha2("ids_xml", 256)), F.lit(',"canonical_rule":'), F.col("rule"),
        F.lit(',"source_citation":'), F.col("_citation"), F.lit(',"source_citation_sha256":'), _text(F.sha2("_citation", 256)), F.when(attested, attestation).otherwise(""), F.lit("}"),
    )
    only = lambda name: F.when(attested, F.col(name))
    return read.select(
        key, "rule_id", canonical_json(made).alias("sidecar"), "ids_xml", F.col("_citation").alias("citation"), F.col("_c.document_key").alias("document_key"), F.col("_c.document_sha256").alias("document_sha256"), F.col("_c.pdf_page").cast("long").alias("page"), F.col("_c.source_span_ids").alias("spans"),
        F.col("rule_id").alias("declared_id"), F.sha2("ids_xml", 256).alias("declared_ids_sha256"), F.when(attested, "transcript").alias("decision"), only("_c.document_sha256").alias("attested_sha256"), only("_c.transcript_revision_id").alias("attested_revision"), F.col("_c.transcript_revision_id").alias("revision"), "evidence", F.lit(None).cast("string").alias("report_sha256"),
    )
