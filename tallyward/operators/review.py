"""Review queries: the tables an analyst looks at."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyward.functions import expr
from tallyward.operators.quantile import group_quantiles

QUEUE_ROWS = 300


def population(accounts: DataFrame) -> DataFrame:
    return accounts.groupBy("label").agg(F.count("*").alias("accounts")).orderBy("label")


def enforcement_queue(decisions: DataFrame, accounts: DataFrame, tier: str, rows: int = QUEUE_ROWS) -> DataFrame:
    """The riskiest accounts of one tier; the top rows are taken before the join to account details."""
    top = decisions.filter(F.col("tier") == tier).orderBy(F.desc("risk"), "user_id").limit(rows)
    details = accounts.select("user_id", "username", "subtype", "ring_id")
    return (
        details.join(F.broadcast(top), "user_id")
        .select("user_id", "username", "risk", "label", "subtype", "ring_id", "evasion")
        .orderBy(F.desc("risk"), "user_id")
    )


def account_timeline(events: DataFrame, user_id) -> DataFrame:
    """Requests per hour of one account; the account filter reaches the scan."""
    hour = (expr.hour_bucket(F.col("ts")) * expr.HOUR).alias("hour")
    return (
        events.filter(F.col("user_id") == F.lit(user_id))
        .groupBy(hour)
        .agg(
            F.count("*").alias("events"),
            F.count_distinct("device_fp").alias("devices"),
            F.count_distinct("country").alias("countries"),
        )
        .withColumn("t", F.timestamp_seconds("hour"))
        .orderBy("hour")
    )


def account_diversity(events: DataFrame, user_id) -> DataFrame:
    """Devices and countries of one account over its whole history."""
    return (
        events.filter(F.col("user_id") == F.lit(user_id))
        .groupBy("user_id")
        .agg(
            F.count("*").alias("events"),
            F.count_distinct("device_fp").alias("devices"),
            F.count_distinct("country").alias("countries"),
        )
    )


def takeover_candidates(accounts: DataFrame, spikes: DataFrame, rows: int | None = None) -> DataFrame:
    """Accounts labelled as taken over that show a spike, most anomalous first."""
    out = (
        accounts.filter(F.col("label") == "token_thief")
        .select("user_id", "takeover_ts", "evasion")
        .join(spikes.filter(F.col("spike_ts") > 0), "user_id")
        .orderBy(F.desc("spike_score"), "user_id")
    )
    return out.limit(rows) if rows else out


def risk_quartiles(decisions: DataFrame) -> DataFrame:
    """Quartiles and 1.5 IQR whiskers of risk per label on the evaluation half.

    Whiskers end at the most extreme risk inside the fences, as in a box plot.
    """
    ev = decisions.filter("is_eval").select("label", "risk")
    counts = ev.groupBy("label", "risk").agg(F.count("*").alias("n"))
    boxes = group_quantiles(ev, ["label"], "risk", {}, linear={"q1": 0.25, "median": 0.5, "q3": 0.75})
    boxes = boxes.join(counts.groupBy("label").agg(F.sum("n").alias("accounts")), "label")
    reach = (F.col("q3") - F.col("q1")) * 1.5
    inside = F.when(F.col("risk").between(F.col("q1") - reach, F.col("q3") + reach), F.col("risk"))
    return (
        counts.drop("n")
        .join(boxes, "label")
        .groupBy("label", "accounts", "q1", "median", "q3")
        .agg(F.min(inside).alias("whisker_low"), F.max(inside).alias("whisker_high"))
        .orderBy("label")
    )
