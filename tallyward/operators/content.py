"""Content groups learned from text vectors: a table of centroids, and the nearest one of any vector.

The centroids are unit vectors from spherical k-means: the first are the directions of the texts with the smallest
digests of their ids, then a fixed number of rounds moves each to the mean direction of its texts. A round reads the
vectors once; every task returns at most one sum per centroid. The model has ``k`` rows whatever the number of texts,
is kept as a table, and assigns vectors of a batch or of a stream alike.

A vector that is null, has another length than the first centroid, holds a null or non-finite value or is zero has no direction and belongs
to group ``k``. On a tie the smaller group wins; a centroid that no text is nearest to stays where it is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyward.operators.campaign import CLUSTERS
from tallyward.operators.sequence import content_bucket

ROUNDS = 4


@dataclass(frozen=True)
class ContentModel:
    matrix: np.ndarray  # one unit row per centroid; at most k
    k: int


def unit_rows(vectors: pd.Series, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of those that have a direction, and where they are."""
    known = np.array([v is not None and len(v) == dims for v in vectors], dtype=bool)
    rows = np.array([np.asarray(v, dtype="float64") for v in vectors[known]]).reshape(-1, dims)
    norms = np.linalg.norm(rows, axis=1)
    directed = np.isfinite(norms) & (norms > 0)
    known[np.flatnonzero(known)[~directed]] = False
    return rows[directed] / norms[directed][:, None], known


def first_centroids(vectors: DataFrame, k: int, key: str, vector: str) -> list[list[float]]:
    """At most ``k`` unit vectors, in the order of the digests of their ids."""
    values = F.transform(vector, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(values, F.lit(0.0), lambda a, x: a + x * x))
    rows = vectors.select(F.col(key).alias("_key"), values.alias("_v"), norm.alias("_norm"))
    directed = rows.filter((F.col("_norm") > 0) & (F.col("_norm") < float("inf")) & ~F.isnan("_norm"))
    first = directed.orderBy(F.sha2(F.col("_key").cast("string"), 256), "_key").limit(k)
    units = [r._u for r in first.select(F.transform("_v", lambda x: x / F.col("_norm")).alias("_u")).collect()]
    return [u for u in units if len(u) == len(units[0])]


def fit_content(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, key: str = "text_id", vector: str = "embedding") -> DataFrame:
    """Table (cluster, centroid) learned from one vector per distinct text."""
    spark = vectors.sparkSession
    matrix = np.array(first_centroids(vectors, k, key, vector))
    for _ in range(rounds if len(matrix) else 0):
        for r in _sums(vectors.select(F.col(vector).alias("vector")), matrix).collect():  # at most k rows
            norm = np.linalg.norm(r.total)
            if norm > 0:
                matrix[r.cluster] = np.asarray(r.total) / norm
    rows = [(i, [float(x) for x in row]) for i, row in enumerate(matrix)]
    return spark.createDataFrame(rows, "cluster int, centroid array<double>").coalesce(1)


def _sums(vectors: DataFrame, matrix: np.ndarray) -> DataFrame:
    k, dims = matrix.shape

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, seen = np.zeros((k, dims)), np.zeros(k, dtype=bool)
        for frame in frames:
            units, _ = unit_rows(frame["vector"], dims)
            nearest = np.argmax(units @ matrix.T, axis=1)
            np.add.at(total, nearest, units)
            seen[nearest] = True
        at = np.flatnonzero(seen)
        if len(at):
            yield pd.DataFrame({"cluster": at.astype("int32"), "total": list(total[at])})

    parts = vectors.mapInPandas(batches, "cluster int, total array<double>")
    merged = parts.groupBy("cluster").agg(Summarizer.sum(array_to_vector("total")).alias("total"))
    return merged.select("cluster", vector_to_array("total").alias("total"))


def read_content(table: DataFrame, k: int = CLUSTERS) -> ContentModel:
    """The model of a table made by :func:`fit_content`; at most ``k`` rows."""
    return ContentModel(np.array([r.centroid for r in table.orderBy("cluster").collect()]), k)


def nearest(model: ContentModel, vector: Column) -> Column:
    """Group of each vector, in a batch or a stream."""
    matrix, none = model.matrix, model.k

    @F.pandas_udf("int")
    def assign(vectors: pd.Series) -> pd.Series:
        out = np.full(len(vectors), none, dtype="int32")
        if len(matrix):
            units, known = unit_rows(vectors, matrix.shape[1])
            out[known] = np.argmax(units @ matrix.T, axis=1)
        return pd.Series(out)

    return assign(vector)


def content(cluster: Column) -> Column:
    """Content state (0..31) of a group: the bucket of its name."""
    return content_bucket(cluster.cast("string"))
