"""Citations and observation contracts: what a rule rests on, in canonical form, and whether what it needs is there.

A citation and a contract are known by the hash of their canonical JSON (sorted keys, two spaces, a
line feed at the end). Citations come as JSON texts; parts are read from them in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trivalent.functions.identity import canonical_json, is_sha256, json_object_error
from trivalent.operators.rule_ir import resolved

#: Kinds of observations, and the kinds of evidence and statuses that a citation may have.
KINDS = ("geometry", "formula", "table", "numeric", "text", "boolean")
EVIDENCE = ("source_graph", "transcript")
STATUSES = ("verified", "needs_review", "rejected")
CITATION = "document_key string, document_sha256 string, pdf_page int, source_node_ids array<string>, source_span_ids array<string>, exact_text_fa string, exact_text_sha256 string, citation_status string, evidence_kind string, transcript_revision_id string, transcript_sha256 string"


def evidence_kind(citation: Column) -> Column:
    """What a citation (as struct) names; without a name a transcript, if it has its revision and hash and no anchors, or else the source graph."""
    nothing = lambda name: F.coalesce(F.size(citation[name]) <= 0, F.lit(True))
    told = lambda name: F.coalesce(citation[name] != "", F.lit(False))
    inferred = nothing("source_node_ids") & nothing("source_span_ids") & told("transcript_revision_id") & told("transcript_sha256")
    return F.when(told("evidence_kind"), citation["evidence_kind"]).when(inferred, "transcript").otherwise("source_graph")


def citation_faults(rows: DataFrame, key: str, citation: str) -> DataFrame:
    """key, fault of citations (JSON texts) that no executable rule may rest on; a citation may have several. A null one has NO_CITATION."""
    c, kind = F.col("_c"), F.col("_kind")
    graph, transcript = kind == "source_graph", kind == "transcript"
    empty = lambda name: F.coalesce(F.size(c[name]) <= 0, F.lit(True)) | F.coalesce(F.exists(c[name], lambda x: x.isNull() | (x == "")), F.lit(False))
    rules = {
        "NOT_AN_OBJECT": F.col("_error").isNotNull(),
        "NO_DOCUMENT": F.coalesce(c["document_key"] == "", F.lit(True)) | ~is_sha256(c["document_sha256"]),
        "NO_PAGE": F.coalesce(c["pdf_page"] < 1, F.lit(True)),
        "TEXT_HASH_DIFFERS": ~F.sha2(c["exact_text_fa"], 256).eqNullSafe(c["exact_text_sha256"]),
        "UNKNOWN_STATUS": ~F.coalesce(c["citation_status"].isin(*STATUSES), F.lit(False)),
        "NOT_VERIFIED": c["citation_status"].isin(*STATUSES) & (c["citation_status"] != "verified"),
        "UNKNOWN_EVIDENCE": ~kind.isin(*EVIDENCE),
        "NO_NODES": graph & empty("source_node_ids"),
        "NO_SPANS": graph & empty("source_span_ids"),
        "NO_REVISION": transcript & F.coalesce(c["transcript_revision_id"] == "", F.lit(True)),
        "NO_TRANSCRIPT_HASH": transcript & ~is_sha256(c["transcript_sha256"]),
    }
    read = rows.select(key, F.col(citation).alias("_text")).withColumn("_error", json_object_error("_text")).withColumn("_c", F.from_json("_text", CITATION))
    read = read.withColumn("_kind", evidence_kind(c))
    told = F.when(F.col("_text").isNull(), F.array(F.lit("NO_CITATION"))).when(F.col("_error").isNotNull(), F.array(F.lit("NOT_AN_OBJECT"))).otherwise(F.array_compact(F.array(*(F.when(F.coalesce(rule, F.lit(False)), name) for name, rule in rules.items() if name != "NOT_AN_OBJECT"))))
    return read.select(key, F.explode(told).alias("fault"))


def contracts(rules: DataFrame, key: str) -> DataFrame:
    """key, record_id, citation_sha256, status, reason, fault, observations of rules that need observations.

    rules: rule and citation (JSON objects as texts, valid ones), observations (array of observation_key, kind, unit).
    A rule that can't have a contract has a fault instead of an identity: NO_OBSERVATIONS, INVALID_KEY, REPEATED_KEY, UNSUPPORTED_KIND.
    """
    names = F.transform("observations", lambda o: o["observation_key"])
    fault = (
        F.when(F.coalesce(F.size("observations"), F.lit(0)) <= 0, "NO_OBSERVATIONS").when(F.exists("observations", lambda o: F.coalesce(o["observation_key"] == "", F.lit(True))), "INVALID_KEY")
        .when(F.size(F.array_distinct(names)) < F.size(names), "REPEATED_KEY").when(F.exists("observations", lambda o: ~F.coalesce(o["kind"].isin(*KINDS), F.lit(False))), "UNSUPPORTED_KIND")
    )
    listed = F.to_json(F.transform("observations", lambda o: F.struct(o["observation_key"].alias("observation_key"), o["kind"].alias("kind"), F.lit("PENDING").alias("status"), o["unit"].alias("unit"))), {"ignoreNullFields": "false"})
    payload = F.concat(F.lit('{"rule":'), F.col("rule"), F.lit(',"source_citation":'), F.col("citation"), F.lit(',"required_observations":'), listed, F.lit("}"))
    made = rules.withColumn("fault", fault)
    good = F.col("fault").isNull()
    made = made.withColumn("_payload", F.when(good, payload)).withColumn("record_id", F.sha2(canonical_json("_payload"), 256)).withColumn("citation_sha256", F.sha2(canonical_json("citation"), 256))
    return made.select(key, "record_id", F.when(good, F.col("citation_sha256")).alias("citation_sha256"), F.when(good, "DEFERRED").alias("status"), F.when(good, "REQUIRES_DERIVED_OBSERVATIONS").alias("reason"), "fault", "rule", "citation", "observations")


def resolve_contracts(made: DataFrame, values: DataFrame, key: str) -> DataFrame:
    """key, record_id, status, available, needed: a contract is AVAILABLE when each of its observations has just one valid value.

    values: key, observation_key, value (text), any number of rows. Several values are ambiguous, equal ones too;
    observations of geometry, formulas and tables have no value of their own and stay INDETERMINATE. A contract whose
    citation or identity isn't what its parts hash to is refused: status CONTRACT_DIFFERS.
    """
    counted = values.groupBy(key, "observation_key").agg(F.array_repeat(F.min("value"), F.least(F.count("*"), F.lit(2)).cast("int")).alias("values"))
    again = contracts(made.select(key, "rule", "citation", "observations"), key).select(key, F.col("record_id").alias("_record"), F.col("citation_sha256").alias("_citation"))
    asked = made.where("fault is null").select(key, F.explode("observations").alias("o")).select(key, "o.observation_key", "o.kind")
    found = asked.join(counted, [key, "observation_key"], "left").withColumn("r", resolved(F.col("kind"), F.coalesce("values", F.array().cast("array<string>"))))
    sums = found.groupBy(key).agg(F.count("*").alias("needed"), F.count_if(F.col("r.status") == "AVAILABLE").alias("available"))
    joined = made.where("fault is null").select(key, "record_id", "citation_sha256").join(again, key).join(sums, key)
    same = F.col("record_id").eqNullSafe(F.col("_record")) & F.col("citation_sha256").eqNullSafe(F.col("_citation"))
    return joined.select(key, "record_id", F.when(~same, "CONTRACT_DIFFERS").when(F.col("available") == F.col("needed"), "AVAILABLE").otherwise("INDETERMINATE").alias("status"), "available", "needed")
