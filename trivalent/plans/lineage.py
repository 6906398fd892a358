"""Cutting the lineage of iterated plans, and writing what many parts of a plan read."""

from __future__ import annotations

import getpass
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; on a machine of its own, as in tests, one below /tmp where it names none."""
    setting = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not setting and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return (setting or f"file:///tmp/checkpoints/{getpass.getuser()}").rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df as a checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """df as Parquet in the shared folder: for tables that many parts of a plan read, each a few of their columns."""
    path = f"{shared_folder(df.sparkSession)}/written-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def gathered(parts: list[DataFrame]) -> DataFrame:
    """The rows of parts of one schema, each written by a plan of its own: the driver holds a plan whole, and again with every stage that ends."""
    path = f"{shared_folder(parts[0].sparkSession)}/gathered-{uuid.uuid4().hex}"
    for part in parts:
        part.write.mode("append").option("compression", "zstd").parquet(path)
    return parts[0].sparkSession.read.schema(parts[0].schema).parquet(path)
