"""Constraint audits: each returns the rows that violate it, so no rows means valid."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def orphans(rows: DataFrame, parents: DataFrame, key: str, parent_key: str) -> DataFrame:
    """Rows whose key, not null, names no parent."""
    return rows.where(F.col(key).isNotNull()).join(parents.select(F.col(parent_key).alias(key)).distinct(), key, "left_anti")


def repeated(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Key values, without nulls, that more than one row holds, with their count."""
    return rows.dropna(subset=keys).groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def breaches(rows: DataFrame, rule: Column) -> DataFrame:
    """Rows for which the rule is false; as in SQL, an unknown outcome is no breach."""
    return rows.where(~rule)


def counted(audits: dict[str, DataFrame]) -> DataFrame:
    """audit, violations: a row for each audit, those without violations too."""
    return reduce(DataFrame.unionAll, [rows.agg(F.count("*").alias("violations")).select(F.lit(name).alias("audit"), "violations") for name, rows in audits.items()])
