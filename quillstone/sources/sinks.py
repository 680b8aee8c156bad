"""Outputs: relations and vectors as Parquet, results as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def relation(rows: DataFrame, path: str, by: str | None = "goid") -> None:
    """Overwrites a relation, clustered and sorted by its key, so that lookups by key prune row groups."""
    (rows.repartition(F.col(by)).sortWithinPartitions(by) if by else rows).write.mode("overwrite").parquet(path)


def vectors(rows: DataFrame, path: str) -> None:
    rows.select("chunk_id", F.col("embedding").cast("array<float>").alias("embedding")).write.mode("overwrite").parquet(path)


def results(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("ignoreNullFields", False).json(path)
