"""File stream sources and run-to-end helpers."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyward.session import cut_lineage, drop_table, new_folder

FILES_PER_TRIGGER = 64
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def state_store(spark: SparkSession, provider: str = ROCKS) -> Iterator[None]:
    """The provider of keyed state for the streams started inside; others keep the session's own."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, provider)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)


def file_stream(
    spark: SparkSession, folder: str, schema: T.StructType, name_filter: str | None = None,
    files_per_trigger: int = FILES_PER_TRIGGER,
) -> DataFrame:
    """Parquet files of ``folder`` in arrival order; the trigger size bounds what one batch can hold."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    if name_filter:
        reader = reader.option("pathGlobFilter", name_filter)
    return reader.parquet(folder)


def run_available(stream: DataFrame, step: Callable[[DataFrame, int], None], name: str, mode: str = "append") -> None:
    """Process everything that is there, then stop. Progress is kept in the shared folder."""
    spark = stream.sparkSession
    run = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", new_folder(spark, f"{name}-progress"))
        .trigger(availableNow=True)
        .foreachBatch(step)
        .start()
    )
    run.awaitTermination()


def parquet_step(folder: str) -> Callable[[DataFrame, int], None]:
    """Write each batch to a folder named by its number: a batch that runs again replaces itself."""

    def step(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return step


def latest_per_key(spark: SparkSession, folder: str, schema: T.StructType, keys: list[str]) -> DataFrame:
    """The last update of every key written by an update-mode query."""
    full = T.StructType([*schema.fields, T.StructField("batch", T.LongType())])
    rows = spark.read.schema(full).parquet(folder)
    values = [f.name for f in schema.fields if f.name not in keys]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("_v"))
    return newest.select(*keys, *[F.col(f"_v.{v}").alias(v) for v in values])


def replay(rows: DataFrame, parts: int, order: str | None = None) -> DataFrame:
    """``rows`` as a stream of about ``parts`` micro-batches.

    They are written to files first: dealt by a hash of all columns, so every batch holds rows of all times, or,
    with ``order`` (a numeric column), one part after the other in that order.
    """
    spark, folder = rows.sparkSession, new_folder(rows.sparkSession, "replay")
    if order is None:
        files = spark.sparkContext.defaultParallelism  # of a batch, so that no task writes all of it
        rows.repartition(parts * files, F.xxhash64(*rows.columns)).write.parquet(folder)
        return file_stream(spark, folder, rows.schema, "*.parquet", files)
    rows = cut_lineage(rows, "replayed")  # each part is written by one task, which only has to copy its rows
    bounds = rows.stat.approxQuantile(order, [k / parts for k in range(1, parts)], 0.01)
    for low, high in zip([None, *bounds], [*bounds, None]):
        part = rows if low is None else rows.filter(F.col(order) > low)
        part = part if high is None else part.filter(F.col(order) <= high)
        part.coalesce(1).write.mode("append").parquet(folder)
    drop_table(rows)
    return file_stream(spark, folder, rows.schema, "*.parquet", 1)
