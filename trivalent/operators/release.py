"""Rule releases: entries with re-derived hashes, faults that forbid a release, exact cover of manifest and artifacts, a root over all entries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Decisions that attest a source.
ANCHORED = ("anchored", "already_anchored", "transcript")
ENTRY = ("ids_sha256", "sidecar_sha256", "citation_sha256", "document_key", "document_sha256", "page", "spans")


def entries(compiled: DataFrame) -> DataFrame:
    """rule_id with its entry: hashes of the rule file, the sidecar and the citation (their texts as they are stored), and the source.

    compiled: rule_id, ids_xml, sidecar and citation (canonical JSON texts), document_key, document_sha256, page, spans.
    """
    hashes = (F.sha2(F.col(c), 256).alias(f"{n}_sha256") for c, n in (("ids_xml", "ids"), ("sidecar", "sidecar"), ("citation", "citation")))
    return compiled.select("rule_id", *hashes, "document_key", "document_sha256", "page", F.coalesce("spans", F.array().cast("array<string>")).alias("spans"))


def faults(compiled: DataFrame) -> DataFrame:
    """rule_id, fault of every compiled rule that mustn't be released; a rule may have several.

    Also read: declared_id and declared_ids_sha256 (the sidecar's own, null where it has none), decision,
    attested_sha256, report_sha256, evidence, attested_revision, revision (attestation and citation, null without them).
    """
    own = compiled.withColumn("_ids", F.sha2("ids_xml", 256))
    transcript = F.col("decision") == "transcript"
    rules = {
        "UNSAFE_ID": F.col("rule_id").rlike("[/\\\\\\x00]") | F.col("rule_id").isin("", ".", "..") | F.col("rule_id").isNull(),
        "NO_ARTIFACTS": F.col("ids_xml").isNull() | F.col("sidecar").isNull(),
        "SIDECAR_ID_DIFFERS": F.col("declared_id") != F.col("rule_id"),
        "NO_CITATION": F.col("citation").isNull(),
        "NO_ATTESTATION": F.col("decision").isNull() & F.col("attested_sha256").isNull(),
        "ATTESTED_DOCUMENT_DIFFERS": F.col("attested_sha256").isNotNull() & ~F.col("attested_sha256").eqNullSafe(F.col("document_sha256")),
        "NOT_ANCHORED": ~F.coalesce(F.col("decision"), F.lit("none")).isin(*ANCHORED) & (F.col("decision").isNotNull() | F.col("attested_sha256").isNotNull()),
        "TRANSCRIPT_DIFFERS": transcript & ((F.coalesce("evidence", F.lit("")) != "transcript") | ~F.col("attested_revision").eqNullSafe(F.col("revision"))),
        "NO_REPORT_HASH": F.col("decision").isin(*ANCHORED) & ~transcript & (F.coalesce(F.length("report_sha256"), F.lit(0)) != 64),
        "IDS_HASH_DIFFERS": F.col("declared_ids_sha256") != F.col("_ids"),
    }
    told = F.array_compact(F.array(*(F.when(F.coalesce(rule, F.lit(False)), name) for name, rule in rules.items())))
    repeated = compiled.groupBy("rule_id").agg(F.count("*").alias("n")).where("n > 1").select("rule_id", F.lit("REPEATED_RULE").alias("fault"))
    return own.select("rule_id", F.explode(told).alias("fault")).unionByName(repeated)


def exact_cover(manifest: DataFrame, compiled: DataFrame) -> DataFrame:
    """rule_id, breach wherever a manifest (rule_id and its entry) and the compiled rules aren't the same rules with the same bytes.

    NOT_COMPILED and NOT_IN_MANIFEST both ways, IDS_DIFFERS, SIDECAR_DIFFERS, CITATION_DIFFERS by hashes derived anew; LISTED_TWICE.
    """
    listed = manifest.groupBy("rule_id").agg(F.count("*").alias("_n"), *(F.min(f"{n}_sha256").alias(f"_{n}") for n in ("ids", "sidecar", "citation")))
    made = entries(compiled).groupBy("rule_id").agg(*(F.min(f"{n}_sha256").alias(n) for n in ("ids", "sidecar", "citation")), F.lit(True).alias("_made"))
    both = listed.join(made, "rule_id", "full")
    named = [("NOT_COMPILED", F.col("_made").isNull()), ("NOT_IN_MANIFEST", F.col("_n").isNull()), ("LISTED_TWICE", F.col("_n") > 1)]
    named += [(f"{n.upper()}_DIFFERS", F.col("_made") & F.col("_n").isNotNull() & ~F.col(n).eqNullSafe(F.col(f"_{n}"))) for n in ("ids", "sidecar", "citation")]
    return both.select("rule_id", F.explode(F.array_compact(F.array(*(F.when(rule, name) for name, rule in named)))).alias("breach"))


def coverage(manifest: DataFrame) -> DataFrame:
    """rules, documents and source_spans (distinct ones) of a manifest, in one row."""
    spans = manifest.select(F.explode("spans").alias("span")).agg(F.count_distinct("span").alias("source_spans"))
    rules = manifest.agg(F.count("*").alias("rules"), F.count_distinct("document_key").alias("documents"))
    parts = rules.withColumn("source_spans", F.lit(0)).unionByName(spans.select(F.lit(0).alias("rules"), F.lit(0).alias("documents"), "source_spans"))
    return parts.agg(*(F.sum(c).alias(c) for c in ("rules", "documents", "source_spans")))


def root(manifest: DataFrame, levels: tuple[int, ...] = (5, 2, 0)) -> DataFrame:
    """root, rules: a hash over all entries, whatever their order in the table, as a tree by the digits of the rules' own hashes.

    Entries are sorted and hashed within a bucket of the first digits of sha256(rule_id), buckets within
    buckets of fewer digits, up to one. A million buckets keep the lists of the first level short for
    any release; a level above lists 4,096 hashes at most.
    """
    line = F.to_json(F.struct("rule_id", *ENTRY))
    level = manifest.select(F.sha2("rule_id", 256).alias("at"), line.alias("x"), F.lit(1).cast("long").alias("n"))
    for digits in levels:
        level = level.groupBy(F.substring("at", 1, digits).alias("at")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(" ", "at", "x"))), "\n"), 256).alias("x"), F.sum("n").alias("n"))
    return level.select(F.col("x").alias("root"), F.col("n").alias("rules"))


def releasable(compiled: DataFrame, manifest: DataFrame) -> DataFrame:
    """Everything that forbids the release: rule_id, problem; no rows: it may be written."""
    return reduce(DataFrame.unionByName, [faults(compiled).withColumnRenamed("fault", "problem"), exact_cover(manifest, compiled).withColumnRenamed("breach", "problem")])


def write(compiled: DataFrame, manifest: DataFrame, folder: str) -> str:
    """Writes a release below its root's name: rules (rule_id, ids_xml, sidecar) and manifest, and returns the root; refused while anything forbids it."""
    wrong = releasable(compiled, manifest).orderBy("rule_id", "problem").first()
    if wrong is not None:
        raise ValueError(f"rule {wrong['rule_id']}: {wrong['problem']}")
    found = root(manifest).first()
    name = found["root"] if found else "empty"
    compiled.select("rule_id", "ids_xml", "sidecar").write.mode("overwrite").parquet(f"{folder}/{name}/rules")
    manifest.write.mode("overwrite").parquet(f"{folder}/{name}/manifest")
    return name
