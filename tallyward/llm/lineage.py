"""Tables in the folder shared by all executors.

``spark.checkpoint.dir`` names the folder; only a local session without it gets one of its own. Intermediate
results are written there as Parquet, so a lost executor costs a re-read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from tallyward.session import shared_folder


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table in the shared folder, and read from there."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/tallyward-llm/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(df: DataFrame | None) -> None:
    """Delete a table made by :func:`written` that nothing needs any more."""
    if df is None:
        return
    spark = df.sparkSession
    for place in {f.rsplit("/", 1)[0] for f in df.inputFiles()[:1]}:
        if "/tallyward-llm/" in place:
            path = spark._jvm.org.apache.hadoop.fs.Path(place)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
