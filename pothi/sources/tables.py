"""Readers of the Parquet tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """Table ``name`` of ``folder``; only ``columns`` are read when given."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df


def latest(df: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """One row per key: the one with the greatest ``order``, else the smallest row.

    Nothing but an aggregation, so repeated rows collapse map-side. Rows with a
    null key form one group per null pattern.
    """
    rest = [c for c in df.columns if c not in keys]
    row = F.struct(*[F.col(c) for c in rest])
    picked: Column = F.max_by(row, F.struct(F.col(order), F.xxhash64(*[F.col(c) for c in rest]))) if order else F.min(row)
    return df.groupBy(*keys).agg(picked.alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])
