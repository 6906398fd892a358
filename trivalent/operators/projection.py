"""Projection of findings into tables: document rows folded from many sources, snapshots merged with deltas, histories of origins.

merged() and document_rows() aggregate before the shuffle and join on natural keys; nothing lists the
rows of a key. publish() writes a merged table as a new version beside the old ones, with a
manifest, so that readers see one version or the next and never half of one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException


def _empty(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("")) == ""


def document_rows(rows: DataFrame, key: str, order: str, hash_: str, fields: list[str], metadata: str, title: str | None = None) -> DataFrame:
    """One row a document from all rows that tell of it: key, hash_, fields, metadata, sources, conflict.

    A field is the first value in order that is neither null nor empty; a title equal to its key counts as
    empty while another is there. Of a metadata key the last value in order stands. Rows of a document with
    different hashes are a conflict: the row is there, with the least hash, and says so. order is unique
    within a key; null metadata are none; fields are strings.
    """
    blank = {f: _empty(f) | (F.col(f) == F.col(key).cast("string")) if f == title else _empty(f) for f in fields}
    firsts = [F.min_by(F.col(f), F.when(~F.coalesce(blank[f], F.lit(True)), F.col(order))).alias(f) for f in fields]
    if title:
        firsts.append(F.min_by(F.col(title), F.when(~_empty(title), F.col(order))).alias("_title"))
    documents = rows.groupBy(key).agg(F.min(hash_).alias(hash_), *firsts, F.count("*").alias("sources"), (F.min(hash_) != F.max(hash_)).alias("conflict"))
    if title:
        documents = documents.withColumn(title, F.coalesce(title, "_title")).drop("_title")
    entries = rows.select(key, order, F.explode(metadata).alias("k", "v")).groupBy(key, "k").agg(F.max_by("v", order).alias("v"))
    maps = entries.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias(metadata))
    return documents.join(maps, key, "left").withColumn("conflict", F.coalesce("conflict", F.lit(False)))


def merged(snapshot: DataFrame, delta: DataFrame, keys: list[str], immutable: list[str], fields: list[str], first_wins: bool = False) -> DataFrame:
    """The snapshot with the delta merged in by natural key: keys, immutable, fields, change.

    change: inserted, updated, unchanged, kept (not in the delta), refused (an immutable value differs: the
    snapshot's row stays). A field of the delta replaces the snapshot's, null too, or, where the first wins,
    only fills one that is null or empty. Keys are unique on each side and null in no row; repeated() in
    audit.py finds those that aren't.
    """
    names = [*immutable, *fields]
    old = snapshot.select(*keys, F.lit(True).alias("_old"), F.struct(*names).alias("o"))
    new = delta.select(*keys, F.lit(True).alias("_new"), F.struct(*names).alias("n"))
    both = old.join(new, keys, "full")
    same = lambda some: F.forall(F.array(*(F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}")) for c in some)), lambda x: x) if some else F.lit(True)
    refused = F.col("_old") & F.col("_new") & ~same(immutable)

    def value(name: str) -> Column:
        if name in immutable:
            return F.when(F.col("_old"), F.col(f"o.{name}")).otherwise(F.col(f"n.{name}"))
        filled = F.when(F.coalesce(F.col(f"o.{name}").cast("string"), F.lit("")) == "", F.col(f"n.{name}")).otherwise(F.col(f"o.{name}"))
        taken = filled if first_wins else F.col(f"n.{name}")
        return F.when(F.col("_new").isNull() | F.coalesce(refused, F.lit(False)), F.col(f"o.{name}")).when(F.col("_old").isNull(), F.col(f"n.{name}")).otherwise(taken)

    out = both.select(*keys, *(value(c).alias(c) for c in names), "o", "n", "_old", "_new", refused.alias("_refused"))
    unchanged = F.forall(F.array(*(F.col(f"o.{c}").eqNullSafe(F.col(c)) for c in fields)), lambda x: x) if fields else F.lit(True)
    change = F.when(F.col("_old").isNull(), "inserted").when(F.col("_new").isNull(), "kept").when(F.col("_refused"), "refused").when(unchanged, "unchanged").otherwise("updated")
    return out.select(*keys, *names, change.alias("change"))


def existing(spark: SparkSession, folder: str) -> DataFrame | None:
    """The table in a folder, None where there is none."""
    try:
        return spark.read.parquet(folder)
    except AnalysisException:
        return None


def _manifests(spark: SparkSession, folder: str) -> DataFrame | None:
    return existing(spark, f"{folder}/manifest")


def _digest(rows: DataFrame) -> tuple[int, str]:
    """Rows and a sum of their hashes, which is the same in any order."""
    counted = rows.agg(F.count("*"), F.sum(F.xxhash64(*(F.to_json(F.struct(F.col(c))) for c in sorted(rows.columns))).cast("decimal(38,0)"))).first()
    return counted[0], str(counted[1] or 0)


def publish(rows: DataFrame, folder: str, version: int | None = None) -> int:
    """Writes rows as the version after the last (or as `version`, which mustn't be there) and then its manifest: version, rows, digest."""
    spark = rows.sparkSession
    known = _manifests(spark, folder)
    last = (known.agg(F.max("version")).first()[0] or 0) if known is not None else 0
    number = last + 1 if version is None else version
    if number <= last:
        raise ValueError(f"version {number} isn't after {last}")
    rows.write.mode("overwrite").parquet(f"{folder}/version={number}")
    n, digest = _digest(spark.read.parquet(f"{folder}/version={number}"))
    spark.createDataFrame([(number, n, digest)], "version int, rows long, digest string").coalesce(1).write.mode("append").parquet(f"{folder}/manifest")
    return number


def published(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """A version's rows, the last one's without a number; refused where they aren't what its manifest says."""
    known = _manifests(spark, folder)
    entry = None if known is None else known.where(F.lit(True) if version is None else F.col("version") == version).orderBy(F.desc("version")).first()
    if entry is None:
        raise ValueError("no such version")
    rows = spark.read.parquet(f"{folder}/version={entry['version']}")
    if _digest(rows) != (entry["rows"], entry["digest"]):
        raise ValueError(f"version {entry['version']} differs from its manifest")
    return rows


def history(entries: DataFrame, current: DataFrame, path: str, digest: str, size: str, origin: str) -> DataFrame:
    """path, digest, size, origin, origins, state: what was stored under each path and is no longer current, and where it came from.

    entries tell (path, digest, size, origin) in any number; origins that are equal as text (canonical JSON) count once.
    state: history, current (a path that is current too), or conflict (one path with several digests or
    sizes). One row an origin, so that a path of very many is never one value; its own number is joined.
    """
    unique = entries.groupBy(path, origin).agg(F.min(digest).alias(digest), F.min(size).alias(size), F.max(digest).alias("_digest"), F.max(size).alias("_size"))
    paths = unique.groupBy(path).agg(F.min(digest).alias(digest), F.min(size).alias(size), F.count(origin).alias("origins"), ((F.min(digest) != F.max("_digest")) | (F.min(size) != F.max("_size"))).alias("_conflict"))
    now = current.groupBy(path).agg(F.min(digest).alias("_now"), F.max(digest).alias("_now_last"))
    known = paths.join(now, path, "left")
    differs = F.col("_conflict") | (F.col("_now") != F.col(digest)) | (F.col("_now_last") != F.col(digest))
    known = known.select(path, digest, size, "origins", F.when(F.coalesce(differs, F.col("_conflict")), "conflict").when(F.col("_now").isNotNull(), "current").otherwise("history").alias("state"))
    return unique.select(path, origin).join(known, path)


def page_evidence(pages: DataFrame, keys: list[str], order: str, values: list[str]) -> DataFrame:
    """For each page the values of the first evidence in order (of chunks, the lowest that has it), and how many others there were."""
    first = pages.groupBy(*keys).agg(F.min(F.struct(order, *values)).alias("first"), (F.count("*") - 1).alias("later"))
    return first.select(*keys, F.col(f"first.{order}").alias(order), *(F.col(f"first.{v}").alias(v) for v in values), "later")


def assembled_pages(pages: DataFrame, evidence: DataFrame, responses: DataFrame, keys: list[str]) -> DataFrame:
    """pages joined with their evidence and responses by natural key, with miss: why a page can't be imported (null: it can).

    A repeated page, one without evidence and one without a completed response are misses; no page is dropped.
    """
    alone = pages.withColumn("_n", F.count("*").over(Window.partitionBy(*keys)))
    joined = alone.join(evidence.withColumn("_evidence", F.lit(True)), keys, "left").join(responses.withColumn("_response", F.lit(True)), keys, "left")
    miss = F.when(F.col("_n") > 1, "REPEATED_PAGE").when(F.col("_evidence").isNull(), "NO_EVIDENCE").when(F.col("_response").isNull(), "NO_RESPONSE")
    return joined.withColumn("miss", miss).drop("_n", "_evidence", "_response")
