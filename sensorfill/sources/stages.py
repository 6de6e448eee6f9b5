"""Results of one job kept for the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def write_stage(df: DataFrame, path: str, partition_by: str | None = "year") -> None:
    """Write a stage as parquet, partitioned by year where it has one.

    A year of 100 TB is many files: rows keep the partitions they have, and each
    task writes its own part of a year.
    """
    writer = df.write.mode("overwrite")
    if partition_by is not None and partition_by in df.columns:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)


def read_stage(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def export_csv(df: DataFrame, path: str) -> None:
    """Write a table as a folder of headed CSV files."""
    df.write.mode("overwrite").csv(path, header=True)
