"""Joins by keys that may be null or that few values dominate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_key(rows: DataFrame, found: DataFrame, by: str, name: str) -> DataFrame:
    """rows with found's column name by an equal key. Rows without a key aren't joined: they would meet in one task."""
    kind = dict(found.dtypes)[name]
    return rows.where(F.col(by).isNotNull()).join(found, by, "left").select(*rows.columns, name).unionByName(rows.where(F.col(by).isNull()).withColumn(name, F.lit(None).cast(kind)))
