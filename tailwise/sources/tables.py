"""Readers: columns and filters given here reach the Parquet scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str, columns: list[str] | None = None, where: Column | str | None = None) -> DataFrame:
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    if where is not None:
        df = df.where(where)
    return df.select(*columns) if columns else df
