"""Sinks: rows as JSON, and tables by version."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def as_json(rows: DataFrame) -> DataFrame:
    """Each row as a JSON object in one column, ``json``; nulls are left out."""
    return rows.select(F.to_json(F.struct("*")).alias("json"))


def write_version(rows: DataFrame, path: str, version: int, partition: list[str] | None = None) -> str:
    """Write a table's version to a folder of its own; a version that is there is never written over."""
    target = f"{path.rstrip('/')}/version={version}"
    w = rows.write.mode("error")
    (w.partitionBy(*partition) if partition else w).parquet(target)
    return target


def write_sorted(rows: DataFrame, path: str, key: str, files: int | None = None) -> str:
    """Write a table in ranges of a key, sorted within each file, so that a lookup by it reads the row groups that can hold it.

    ``files``: how many ranges, or as many as shuffles have.  A key that many
    rows share lies in one range.
    """
    ranged = rows.repartitionByRange(files, key) if files else rows.repartitionByRange(key)
    ranged.sortWithinPartitions(key).write.mode("error").parquet(path)
    return path
