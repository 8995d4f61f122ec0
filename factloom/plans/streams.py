"""Queries that run a table through a stream to its end."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from factloom.functions.shared import shared_folder
from factloom.plans.base import query, table
from factloom.streaming import rates


@query("rate_limit_exceeded", """WITH n AS (SELECT user_id, event_id AS id, ts, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 6 HOURS PRECEDING AND CURRENT ROW) AS n FROM events)
SELECT user_id, id, epoch_us(ts) AS micros, n FROM n WHERE n > 3 AND epoch_us(ts) < (SELECT epoch_ms(max(ts)) - 3600000 FROM events) * 1000""")
def rate_limit_exceeded(spark: SparkSession, d: str) -> DataFrame:
    """Events with which a user has more than three in any six hours; the last hour waits for rows that are late."""
    folder = f"{shared_folder(spark)}/rates-{uuid.uuid4().hex}"
    events = spark.readStream.schema(table(spark, d, "events").schema).option("pathGlobFilter", "events.parquet").parquet(d)
    found = rates.over_any(events, "ts", "user_id", "event_id", most=3, seconds=6 * 3600, late="1 hour")
    found = found.selectExpr("user_id", "id", "unix_micros(at) as micros", "n")
    with rates.lasting_state(spark):
        run = found.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(found.schema).parquet(f"{folder}/rows")
