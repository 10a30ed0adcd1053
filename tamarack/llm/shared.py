"""Intermediate results in the folder that driver and executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..shared import new_path as new_path


def written(df: DataFrame, what: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: its lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
