"""Store queries: tenant scope, soft deletion, stalled and running work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def for_tenant(rows: DataFrame, column: str, tenant: int | str | None) -> DataFrame:
    """A tenant's own rows; without a tenant, none at all."""
    return rows.where(F.col(column) == F.lit(tenant)) if tenant is not None else rows.where(F.lit(False))


def alive(rows: DataFrame, deleted: str) -> DataFrame:
    return rows.where(F.col(deleted).isNull())


def run_states(events: DataFrame, key: str, at: str, clock: Column, stalled_after: str) -> DataFrame:
    """key, last_at, state: running while the last sign of life is younger than stalled_after, else stalled."""
    last = events.groupBy(key).agg(F.max(at).alias("last_at"))
    return last.withColumn("state", F.when(F.col("last_at") >= clock - F.expr(f"interval {stalled_after}"), "running").otherwise("stalled"))


def latest(rows: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """Per key the columns of the row that is last in order, by a maximum that is aggregated before the shuffle."""
    return rows.groupBy(*keys).agg(F.max(F.struct(*order, *columns)).alias("row")).select(*keys, *(F.col(f"row.{c}") for c in columns))


def gaps(rows: DataFrame, keys: list[str], number: str) -> DataFrame:
    """keys, after, before: where consecutive numbers leave some out."""
    following = F.lead(number).over(Window.partitionBy(*keys).orderBy(number))
    return rows.select(*keys, F.col(number).alias("after"), following.alias("before")).where("before > after + 1")
