"""Hourly activity per account as a watermarked window aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LATENESS = "1 hour"


def hourly_activity(events: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Requests per (account, hour). ``events`` has user_id and a timestamp ``time``.

    State holds the open hours only; rows later than ``lateness`` are dropped.
    """
    hours = events.withWatermark("time", lateness).groupBy(F.window("time", "1 hour"), "user_id")
    return hours.agg(F.count("*").alias("events")).select(
        "user_id", F.unix_timestamp(F.col("window.start")).alias("hour"), "events"
    )
