"""Queries of summaries over what the other queries make."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trivalent.operators import anchoring, summaries
from trivalent.queries import publication, sources
from trivalent.queries.rules import table

REASONS = ["short", "noise"]


def anchor_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.anchor_summary(anchoring.record_anchors(sources.source_records(spark, sf_dir), sources.source_nodes(spark, sf_dir), sources.plain))


def graph_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = sources.planted_graph(spark, sf_dir)
    return summaries.graph_counts(made["nodes"], made["pages"], made["records"])


def manifest_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.manifest_counts(graph_counts(spark, sf_dir))


def import_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.import_counts(publication.projection_upsert(spark, sf_dir))


def rejected_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as drafts of their sources: short ones, junk ones and ones of a language that isn't listed are rejected."""
    reason = F.when(F.col("n_chars") < 500, "short").when(F.col("doc_id") % 9 == 0, "noise").when(F.col("lang") == "es", "language")
    return summaries.reasons_by(table(spark, sf_dir, "documents").select("source", reason.alias("reason")), "source", "reason", REASONS)


def admitted_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as requests for their conversation; documents of equal number are its runs."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("request")).distinct()
    state = F.element_at(F.array(*map(F.lit, ("SUCCEEDED", "PENDING", "FAILED", "RUNNING", "SUCCEEDED"))), F.expr("cast(n_chars % 5 + 1 as int)"))
    runs = table(spark, sf_dir, "documents").select((F.col("doc_id") % 400).alias("conv_id"), state.alias("status"))
    return summaries.admitted(turns, runs, "conv_id")


QUERIES = {"anchor_summary": anchor_summary, "graph_counts": graph_counts, "manifest_counts": manifest_counts, "import_counts": import_counts, "rejected_drafts": rejected_drafts, "admitted_requests": admitted_requests}
_STATES = ", ".join(f"count(*) filter (status = '{s}') as {s}" for s in summaries.ANCHOR_STATES)
_GRAPH = f"""select doc_id as document, count(distinct page) as pages, count(*) as nodes, count(*) filter (root) as roots, count(*) filter (numeric) as records from
 (select doc_id, place // {sources.PAGE_LINES} as page, (place = 0 and not (doc_id % 26 = 9 and n > 1)) or (doc_id % 26 = 3 and place = 2) as root, regexp_matches(line, '[0-9]') as numeric from (select *, count(*) over (partition by doc_id) as n from {sources.LINES})) group by 1"""
ORACLES = {
    "anchor_summary": f"""select doc_id as document, {_STATES}, count(*) as records, count(*) filter (status in ('anchored', 'already_anchored')) = count(*) as publishable from ({sources.ORACLES["record_anchors"]}) group by 1""",
    "graph_counts": _GRAPH,
    "manifest_counts": f"select count(*) as documents, sum(pages)::bigint as pages, sum(nodes)::bigint as nodes, sum(roots)::bigint as roots, sum(records)::bigint as records from ({_GRAPH})",
    "import_counts": "select {} from ({})".format(", ".join(f"count(*) filter (change = '{c}') as {c}" for c in summaries.CHANGES), publication.ORACLES["projection_upsert"]),
    "rejected_drafts": """with d as (select source, case when n_chars < 500 then 'short' when doc_id % 9 = 0 then 'noise' when lang = 'es' then 'language' end as r from documents)
 select source, count(*) filter (r is null) as accepted, count(*) filter (r = 'short') as short, count(*) filter (r = 'noise') as noise, count(*) filter (r = 'language') as other from d group by 1""",
    "admitted_requests": """with t as (select distinct conv_id, turn from conversations), b as (select doc_id % 400 as conv_id, count(*) as n from documents where n_chars % 5 in (1, 3) group by 1)
 select t.conv_id, turn as request, coalesce(n, 0) as in_flight, coalesce(n, 0) = 0 and turn = min(turn) over (partition by t.conv_id) as admitted from t left join b on b.conv_id = t.conv_id""",
}
