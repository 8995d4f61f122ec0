"""Pages of ordered results with totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clamp(value: int, least: int, most: int) -> int:
    return max(least, min(value, most))


def page(rows: DataFrame, order: list[Column], offset: int = 0, limit: int = 100, most: int = 500) -> DataFrame:
    """One page, with ``total_count`` and ``has_more``.

    ``order`` must be total.  The total is counted before paging, by an
    aggregation of its own: the rows aren't gathered for it.
    """
    offset, limit = max(0, offset), clamp(limit, 1, most)
    total = rows.agg(F.count("*").alias("total_count"))
    cut = rows.orderBy(*order).offset(offset).limit(limit)
    return cut.crossJoin(F.broadcast(total)).withColumn("has_more", F.col("total_count") > offset + limit)
