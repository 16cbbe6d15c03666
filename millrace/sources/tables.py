"""Reading the Parquet tables of a folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def filtered_table(spark: SparkSession, folder: str, name: str, equals: dict | None = None, limit: int | None = None, offset: int = 0, order: list[Column] | None = None) -> DataFrame:
    """A table with optional equality filters (pushed to the scan) and a page of it."""
    df = table(spark, folder, name)
    for column, value in (equals or {}).items():
        if value is not None:
            df = df.where(F.col(column) == F.lit(value))
    if order:
        df = df.orderBy(*order)
    if offset:
        df = df.offset(offset)
    return df if limit is None else df.limit(limit)
