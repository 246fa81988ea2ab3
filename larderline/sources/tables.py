"""Columnar tables for intermediate and reported results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_table(
    df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "errorifexists"
) -> None:
    """Parquet, split into folders by the given columns (say the survey year)."""
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)
