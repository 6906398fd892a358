"""A corpus pipeline of four stages over documents: toxicity, near duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and
returns a DataFrame. All but the last return the columns of documents. run() writes every
stage's result as Parquet into the shared folder and reads it back for the next one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trivalent.llm import ngram_jaccard, packing, secret_scan, toxicity
from trivalent.llm.shared import materialize


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity score rejects go."""
    model = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.keep_clean(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one row stays, that of the smallest doc_id.

    Groups are of rows, not of doc_ids: rows that repeat and rows without doc_id (which come
    last) are judged by their own texts. Rows without words belong to no group and stay.
    """
    row = "row"
    while row in {name.lower() for name in docs.columns}:
        row += "_"
    # Numbers are written with the rows, so that a task that runs again finds the same ones.
    numbered = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    found = ngram_jaccard.jaccard_components(numbered, id_column=row).select(F.col("doc_id").alias(row), "component_id")
    places = found.join(numbered.select(row, F.struct(F.col("doc_id").isNull(), "doc_id", row).alias("place")), row)
    kept = places.groupBy("component_id").agg(F.min("place").alias("place")).select(F.col("place")[row].alias(row))
    return numbered.join(kept, row, "left_semi").select(*docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; n_chars follows the text."""
    redacted = secret_scan.redact(docs)
    if "n_chars" in docs.columns:
        redacted = redacted.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return redacted.select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, packed into sequences of at most 2048 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("secrets", redact_secrets), ("packing", pack)]

#: Learning, tokenising and packing have no SQL form; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
