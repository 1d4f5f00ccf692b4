"""Parquet datasets: one folder, one table per file or sub-folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table of a dataset, read lazily so that filters and columns reach the scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def register(spark: SparkSession, folder: str, names: tuple[str, ...] = TABLES) -> None:
    """Expose the tables as temporary views."""
    for name in names:
        table(spark, folder, name).createOrReplaceTempView(name)
