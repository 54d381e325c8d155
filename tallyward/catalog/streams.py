"""Streaming queries: the tables are replayed as a file stream and the sinks are read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyward.catalog import campaign, canon, sequence
from tallyward.catalog.registry import BOOL, DBL, INT, query, sql
from tallyward.functions.expr import DAY
from tallyward.operators import campaign as c
from tallyward.session import new_folder
from tallyward.sources import star
from tallyward.streaming import campaigns, deltas, hourly, surprise
from tallyward.streaming.sources import latest_per_key, parquet_step, replay, run_available, state_store

PARTS = 3


def event_stream(spark, d, order: str | None = None):
    """The log in several micro-batches, out of order unless one is asked for."""
    return replay(star.events(spark, d), PARTS, order).withColumn("time", F.timestamp_seconds("ts"))


@query(
    "stream_hourly",
    sql(
        canon.EVENTS, "SELECT user_id, ts // 3600 * 3600 AS hour, count(*) AS events FROM ev GROUP BY 1, 2",
        user_id=INT, hour=INT, events=INT,
    ),
)
def stream_hourly(spark, d):
    sink = new_folder(spark, "hourly")
    stream = hourly.hourly_activity(event_stream(spark, d, "ts"))
    run_available(stream, parquet_step(sink), "hourly", "update")
    return latest_per_key(spark, sink, stream.schema, ["user_id", "hour"])


@query(
    "stream_deltas",
    sql(
        canon.SEQ, "SELECT event_id, user_id, ts, delta, ip_chg, dev_chg, cc_chg, false AS late FROM hist",
        event_id=INT, user_id=INT, ts=INT, delta=INT, ip_chg=DBL, dev_chg=DBL, cc_chg=DBL, late=BOOL,
    ),
)
def stream_deltas(spark, d):
    """The parts are dealt by a hash, so most events come out of order; the horizon spans the log."""
    sink = new_folder(spark, "deltas")
    return deltas.run_deltas(event_stream(spark, d), sink, slot=7 * DAY, horizon=3660 * DAY)


@query(
    "stream_campaign",
    sql(
        canon.SPRAY,
        "SELECT user_id, n AS spray_events, n >= 5 AS spray_flag FROM hits",
        user_id=INT, spray_events=INT, spray_flag=BOOL,
    ),
)
def stream_campaign(spark, d):
    """Campaigns are known from history; the stream is matched against their prompts."""
    known = c.campaign_clusters(campaign.stats(spark, d))
    prompts = star.text_vectors(spark, d).join(known, "cluster", "left_semi").select("text_id")
    n = star.table(spark, d, "embeddings").count()
    text_id = ((F.col("user_id") * 3 + F.col("event_id") % 3) % n).alias("text_id")
    stream = campaigns.campaign_hits(event_stream(spark, d).select("user_id", text_id), prompts)
    sink = new_folder(spark, "campaign")
    run_available(stream, parquet_step(sink), "campaign", "update")
    return latest_per_key(spark, sink, stream.schema, ["user_id"])


@query(
    "stream_surprise",
    sql(
        canon.SURPRISE,
        """SELECT s.user_id, t.event_id, t.ts, s.surprise, false AS late,
             CASE WHEN s.pos >= 15 THEN avg(s.surprise) OVER (PARTITION BY s.user_id ORDER BY s.pos ROWS BETWEEN 15 PRECEDING AND CURRENT ROW) END AS rolling
           FROM surprise s JOIN tail t ON t.user_id = s.user_id AND t.pos = s.pos + 1""",
        user_id=INT, event_id=INT, ts=INT, surprise=DBL, rolling=DBL, late=BOOL,
    ),
)
def stream_surprise(spark, d):
    table = sequence.transition_model(spark, d)
    n = star.table(spark, d, "embeddings").count()
    groups = star.content_groups(spark, d).select("text_id", "content")
    text_id = ((F.col("user_id") * 3 + F.col("event_id") % 3) % n).alias("text_id")
    rows = event_stream(spark, d, "ts").select("user_id", "event_id", "ts", text_id).join(groups, "text_id").drop("text_id")
    sink = new_folder(spark, "surprise")
    result = surprise.online_surprise(rows, table)
    with state_store(spark):  # needed by processors with state
        run_available(result, parquet_step(sink), "surprise")
    return spark.read.schema(result.schema).parquet(sink).select(*result.columns)


@query(
    "stream_content",
    sql(
        f"{canon.PROMPTS}, {canon.GROUPS}",
        "SELECT user_id, content, count(*) AS requests FROM pe JOIN content_groups USING (text_id) GROUP BY 1, 2",
        user_id=INT, content=INT, requests=INT,
    ),
)
def stream_content(spark, d):
    """Requests by account and content state; vectors get their nearest stored centroid as they arrive."""
    n = star.table(spark, d, "embeddings").count()
    vectors = star.text_vectors(spark, d).select("text_id", "embedding")
    text_id = ((F.col("user_id") * 3 + F.col("event_id") % 3) % n).alias("text_id")
    arriving = event_stream(spark, d).select("user_id", text_id).join(vectors, "text_id")
    stream = campaigns.content_counts(arriving, star.content_model(spark, d))
    sink = new_folder(spark, "content")
    run_available(stream, parquet_step(sink), "content", "update")
    return latest_per_key(spark, sink, stream.schema, ["user_id", "content"])
