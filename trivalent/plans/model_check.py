"""A model check from files: facts, specifications, results and report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trivalent.operators import check
from trivalent.plans.lineage import cut
from trivalent.sources.ids_xml import read_ids
from trivalent.sources.ifc_step import open_entities, read_ifc, schemas


def run_check(spark: SparkSession, ifc_path: str, ids_path: str) -> DataFrame:
    """Specification results of every model against every rule file; rule files are read, and refused, first."""
    specifications = read_ids(spark, ids_path)
    facts = cut(read_ifc(spark, ifc_path))
    return check.specification_results(facts.where("kind <> 'model'"), specifications, schemas(facts), open_entities(facts))


def run_report(spark: SparkSession, ifc_path: str, ids_path: str) -> DataFrame:
    return check.report(run_check(spark, ifc_path, ids_path))
