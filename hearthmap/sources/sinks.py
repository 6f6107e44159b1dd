"""Result sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Headered CSV files below ``path``; no row-name column."""
    df.write.mode(mode).option("header", True).csv(path)


def write_parquet(
    df: DataFrame, path: str, mode: str = "errorifexists", partition_by: list[str] | None = None
) -> None:
    """Parquet table, the default hand-off between jobs."""
    df.write.mode(mode).parquet(path, partitionBy=partition_by)
