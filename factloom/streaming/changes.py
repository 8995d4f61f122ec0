"""Streams of changes and diagnostics: windows, late data, repeats, rates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_changes(spark: SparkSession, path: str, schema: T.StructType, files_at_once: int = 100) -> DataFrame:
    """A folder of Parquet files as a stream; the schema is given, never inferred."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(path)


def tumbling_counts(events: DataFrame, time: str, keys: list[str], width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Events by window and keys (start, keys, n); those later than ``late`` are left out."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *keys, "n")


def once(events: DataFrame, time: str, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """Events without repeats of their keys within the watermark."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def over_rate(events: DataFrame, time: str, key: str, most: int = 120, width: str = "60 seconds", step: str = "10 seconds", late: str = "10 minutes") -> DataFrame:
    """Sliding windows in which a key has more events than a rate permits (start, key, n)."""
    n = events.withWatermark(time, late).groupBy(F.window(time, width, step), key).agg(F.count("*").alias("n"))
    return n.filter(F.col("n") > most).select(F.col("window.start").alias("start"), key, "n")


def sessions(events: DataFrame, time: str, key: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of a key, which end after a gap (start, end, key, n)."""
    n = events.withWatermark(time, late).groupBy(F.session_window(time, gap), key).agg(F.count("*").alias("n"))
    return n.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), key, "n")
