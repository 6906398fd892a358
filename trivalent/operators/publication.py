"""Publication of candidates: each candidate of two passes is accounted for once by the decisions on its bundle, many to one by merges.

Candidates and the references of decisions to them meet as counts by (bundle, candidate), so that a decision that
names very many sources, or a bundle that holds a third of all, is no task's load. A bundle with any fault
publishes nothing: all its candidates are deferred for review.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ["bundle", "candidate"]


def _named(rows: DataFrame, fault: str, item: str = "candidate") -> DataFrame:
    return rows.select("bundle", F.lit(fault).alias("fault"), F.col(item).alias("item"))


def references(merges: DataFrame, rejected: DataFrame, deferred: DataFrame) -> DataFrame:
    """Each reference of a decision to a source candidate: bundle, candidate, decision, target (what it was merged into)."""
    opened = merges.select("bundle", F.explode("sources").alias("candidate"), F.lit("merged").alias("decision"), F.col("accepted").alias("target"))
    others = [rows.select("bundle", "candidate", F.lit(name).alias("decision"), F.lit(None).cast("string").alias("target")) for rows, name in ((rejected, "rejected"), (deferred, "deferred"))]
    return reduce(DataFrame.unionByName, [opened, *others])


def faults(candidates: DataFrame, accepted: DataFrame, merges: DataFrame, rejected: DataFrame, deferred: DataFrame) -> DataFrame:
    """bundle, fault, item: why the decisions on a bundle don't reconcile with its candidates.

    candidates: bundle, pass, candidate. accepted, rejected, deferred: bundle, candidate. merges: bundle, merge, accepted, sources.
    """
    twice = lambda rows, *keys: rows.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1")
    told = references(merges, rejected, deferred)
    passes = candidates.groupBy(*KEY).agg(F.count_distinct("pass").alias("_passes"))
    within = twice(candidates, "bundle", "pass", "candidate")
    targets = merges.select("bundle", F.col("accepted").alias("candidate"))
    empty = merges.where("sources is null or size(sources) = 0 or exists(sources, s -> s is null or s = '')")
    missed = accepted.select(*KEY).distinct().withColumn("_a", F.lit(1)).join(targets.distinct().withColumn("_t", F.lit(1)), KEY, "full").where("_a is null or _t is null")
    unknown = told.select(*KEY).distinct().join(candidates.select(*KEY).distinct(), KEY, "left_anti")
    rows = [
        _named(passes.where("_passes > 1"), "PASSES_OVERLAP"), _named(within, "REPEATED_CANDIDATE"),
        *(_named(twice(df, *KEY), f"REPEATED_{n}") for df, n in ((accepted, "ACCEPTED"), (rejected, "REJECTED"), (deferred, "DEFERRED"))),
        _named(twice(merges, "bundle", "merge"), "REPEATED_MERGE", "merge"), _named(twice(targets, *KEY), "REPEATED_TARGET"),
        _named(empty, "INVALID_SOURCES", "merge"), _named(missed, "TARGETS_DO_NOT_COVER"), _named(twice(told, *KEY), "CLASSIFIED_TWICE"), _named(unknown, "UNKNOWN_CANDIDATE"),
    ]
    return reduce(DataFrame.unionByName, rows)


def outcomes(candidates: DataFrame, accepted: DataFrame, merges: DataFrame, rejected: DataFrame, deferred: DataFrame) -> DataFrame:
    """bundle, candidate, outcome, reason, target of every source candidate, each once.

    outcome: rule (merged into an accepted candidate without uncertainty or quality codes), deferred, rejected.
    accepted also has uncertainty and quality (arrays of codes). reasons of deferral are fixed values.
    """
    wrong = faults(candidates, accepted, merges, rejected, deferred).select("bundle").distinct().withColumn("_wrong", F.lit(True))
    told = references(merges, rejected, deferred).groupBy(*KEY).agg(F.min("decision").alias("decision"), F.min("target").alias("target"))
    codes = accepted.groupBy("bundle", F.col("candidate").alias("target")).agg(F.max(F.size("uncertainty") > 0).alias("_uncertain"), F.max(F.size("quality") > 0).alias("_poor"), F.max(F.col("uncertainty").isNull()).alias("_odd"))
    joined = candidates.select(*KEY).distinct().join(told, KEY, "left").join(codes, ["bundle", "target"], "left").join(wrong, "bundle", "left")
    reason = (
        F.when(F.col("_wrong"), "VALIDATOR_RECONCILIATION_FAILED").when(F.col("decision").isNull(), "VALIDATOR_UNACCOUNTED_SOURCE_CANDIDATE").when(F.col("decision") == "deferred", "VALIDATOR_DEFERRED")
        .when(F.col("decision") == "rejected", None).when(F.col("_poor"), "ACCEPTED_CANDIDATE_FAILED_QUALITY_GATE").when(F.col("_uncertain") | F.col("_odd"), "ACCEPTED_CANDIDATE_HAS_UNCERTAINTY")
    )
    joined = joined.withColumn("reason", reason)
    outcome = F.when(F.col("reason").isNotNull(), "deferred").when(F.col("decision") == "rejected", "rejected").otherwise("rule")
    return joined.select(*KEY, outcome.alias("outcome"), "reason", F.when(F.col("_wrong").isNull(), F.col("target")).alias("target"))


def summary(candidates: DataFrame, accepted: DataFrame, merges: DataFrame, rejected: DataFrame, deferred: DataFrame) -> DataFrame:
    """Per bundle: sources, accepted, merges, rejected, deferred, unaccounted and state (published or needs_review).

    A bundle that doesn't reconcile counts one deferral, no decisions, and all its candidates as unaccounted.
    """
    counts = [df.groupBy("bundle").agg(F.count("*").alias(name)) for df, name in ((accepted, "accepted"), (merges, "merges"), (rejected, "rejected"), (deferred, "deferred"))]
    found = outcomes(candidates, accepted, merges, rejected, deferred).groupBy("bundle").agg(F.count("*").alias("sources"), F.count_if(F.col("reason") == "VALIDATOR_UNACCOUNTED_SOURCE_CANDIDATE").alias("unaccounted"), F.max(F.coalesce(F.col("reason") == "VALIDATOR_RECONCILIATION_FAILED", F.lit(False))).alias("_wrong"))
    for df in counts:
        found = found.join(df, "bundle", "left")
    count = lambda name, wrong: F.when(F.col("_wrong"), wrong).otherwise(F.coalesce(name, F.lit(0))).alias(name)
    named = [count("accepted", F.lit(0)), count("merges", F.lit(0)), count("rejected", F.lit(0)), count("deferred", F.lit(1)), count("unaccounted", F.col("sources"))]
    return found.select("bundle", "sources", *named, F.when(F.col("_wrong") | (F.coalesce("deferred", F.lit(0)) > 0) | (F.col("unaccounted") > 0), "needs_review").otherwise("published").alias("state"))
