"""Sinks (IO9, IO10). Files are written by the executors in parallel."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """IO9: CSV with a header row (no index column). No BOM: Spark does not write one."""
    df.write.mode(mode).option("header", True).csv(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """IO10: JSON lines; non-ASCII text is written as is (UTF-8)."""
    df.write.mode(mode).json(path)
