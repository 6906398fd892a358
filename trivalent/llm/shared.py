"""Helpers of the training-data operators: the shared folder, materialised steps, Arrow batches."""

from __future__ import annotations

import ctypes
import getpass
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Only where the setting is absent and the master is this very machine, as in
    tests, a folder below /tmp/checkpoints takes its place.
    """
    setting = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if setting:
        return setting.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"file:///tmp/checkpoints/{getpass.getuser()}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back: cuts lineage, survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def join_unique(rows: DataFrame, facts: DataFrame, key: str, weight: str, share: int = 1000) -> DataFrame:
    """Inner join of rows with facts, which hold each key once and, as weight, about how many rows have it.

    Keys of more than a share-th of all rows, fewer than `share` of them, are broadcast with
    their facts, so that no key is one task's load; the others meet in a shuffle.
    """
    facts = materialize(facts, "facts")
    total = facts.agg(F.sum(weight)).first()[0] or 0
    hot = facts.where(F.col(weight) * share > total)
    cold = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(facts.where(F.col(weight) * share <= total), key)
    return rows.join(F.broadcast(hot), key).unionByName(cold)


def release_memory() -> None:
    """Gives what a finished task has freed back to the system: workers are used again and would keep it."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def text_or_empty(column: pa.Array) -> list[str]:
    return [x if x is not None else "" for x in column.to_pylist()]


def batch_rows(batch: pa.RecordBatch, column: str | int, max_bytes: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose text column holds about max_bytes at most, one row at least."""
    array = batch.column(column)
    sizes = np.asarray(pc.fill_null(pc.binary_length(array), 0), dtype=np.int64)
    if not len(sizes):
        return
    part = np.cumsum(sizes) // max_bytes
    cuts = np.flatnonzero(np.diff(part)) + 1
    for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(sizes)]):
        yield batch.slice(start, end - start)


def record_batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t.type) for c, t in zip(columns, schema)], schema=schema)
