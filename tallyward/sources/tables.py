"""Parquet, metric and model sources and sinks."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyward.sources.schema import conform

METRIC_SCHEMA = T.StructType(
    [
        T.StructField("stage", T.StringType()),
        T.StructField("metric", T.StringType()),
        T.StructField("key", T.StringType()),
        T.StructField("value", T.DoubleType()),
    ]
)


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return conform(df, schema) if schema else df


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_events_by_day(events: DataFrame, path: str) -> None:
    """Event log partitioned by day, clustered by account inside each file.

    Rows go to writers by (day, account bucket), so neither a busy day nor a busy account ends up
    with one writer; time filters then prune folders and account filters prune row groups.
    """
    day = F.to_date(F.timestamp_seconds("ts"))
    (
        events.withColumn("event_day", day)
        .repartition("event_day", F.pmod(F.xxhash64("user_id", "event_id"), F.lit(64)))
        .sortWithinPartitions("event_day", "user_id", "ts", "event_id")
        .write.mode("overwrite")
        .partitionBy("event_day")
        .parquet(path)
    )


def read_events_between(spark: SparkSession, path: str, first_ts: int, end_ts: int) -> DataFrame:
    """Rows with first_ts <= ts < end_ts; whole days outside the range are not opened."""
    day = lambda ts: F.to_date(F.timestamp_seconds(F.lit(ts)))
    return spark.read.parquet(path).filter(
        F.col("event_day").between(day(first_ts), day(end_ts - 1))
        & (F.col("ts") >= first_ts)
        & (F.col("ts") < end_ts)
    )


def metric_rows(df: DataFrame, stage: str, metric: str, key: str | None, value: str) -> DataFrame:
    """A result frame as rows of the long metric table."""
    name = F.col(key).cast("string") if key else F.lit("")
    return df.select(
        F.lit(stage).alias("stage"),
        F.lit(metric).alias("metric"),
        name.alias("key"),
        F.col(value).cast("double").alias("value"),
    )


def metric_columns(df: DataFrame, stage: str) -> DataFrame:
    """A result frame of one row as one metric row per column; the frame is computed once for all of them."""
    pairs = [F.struct(F.lit(c).alias("metric"), F.lit("").alias("key"), F.col(c).cast("double").alias("value")) for c in df.columns]
    return df.select(F.lit(stage).alias("stage"), F.inline(F.array(*pairs)))


def write_metrics(metrics: DataFrame, folder: str) -> None:
    conform(metrics, METRIC_SCHEMA).write.mode("overwrite").partitionBy("stage").json(folder)


def read_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """All stages found under ``folder``; a stage that did not run simply has no rows."""
    return spark.read.schema(METRIC_SCHEMA).json(folder).select(*METRIC_SCHEMA.names)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def with_prompt_key(events: DataFrame) -> DataFrame:
    """Add a fixed-width digest and the code-point length of the prompt, unless already present.

    Distinct counts then move 32 bytes per prompt through the shuffle, not the text.
    """
    new = {}
    if "prompt_key" not in events.columns:
        new["prompt_key"] = F.unhex(F.sha2("prompt_text", 256))
    if "prompt_len" not in events.columns:
        new["prompt_len"] = F.length("prompt_text")
    return events.withColumns(new) if new else events
