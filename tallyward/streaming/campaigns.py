"""Known-campaign matches and content states of a stream: static maps and centroids, running counts per account."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyward.operators.campaign import ACCOUNT_MIN_EVENTS
from tallyward.operators.content import ContentModel, content, nearest


def campaign_hits(events: DataFrame, campaign_prompts: DataFrame, key: str = "text_id") -> DataFrame:
    """Running number of campaign requests per account; one state row per account that ever matched."""
    matched = events.join(campaign_prompts.select(key), key)
    counts = matched.groupBy("user_id").agg(F.count("*").alias("spray_events"))
    return counts.withColumn("spray_flag", F.col("spray_events") >= ACCOUNT_MIN_EVENTS)


def content_counts(events: DataFrame, model: ContentModel, vector: str = "embedding") -> DataFrame:
    """Running number of requests by account and content state; at most 32 state rows per account."""
    state = content(nearest(model, F.col(vector))).alias("content")
    return events.select("user_id", state).groupBy("user_id", "content").agg(F.count("*").alias("requests"))
