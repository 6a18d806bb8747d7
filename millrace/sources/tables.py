"""Parquet tables of one folder, read by Spark so that any file system it knows will do."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table ``name`` of ``folder``; it may be one file or a folder of part files."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def write_partitioned(df: DataFrame, path: str, *keys: str) -> None:
    """Write ``df`` below ``path``, one folder for each value of ``keys``.

    Rows are dealt by the keys first, through a rebalance that splits large values, so
    that a value lands in few files and a hot value in more than one task.
    """
    df.hint("rebalance", *keys).write.mode("overwrite").partitionBy(*keys).parquet(path)
