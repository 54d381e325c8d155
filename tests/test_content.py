import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyward.operators import content as c
from tallyward.operators.sequence import content_bucket
from tallyward.streaming.campaigns import content_counts
from tallyward.streaming.sources import latest_per_key, parquet_step, replay, run_available
from tallyward.session import new_folder

SCHEMA = "text_id long, embedding array<float>"


def brute(rows, k, rounds):
    """The same k-means over lists, one vector at a time."""
    from hashlib import sha256

    unit = lambda v: v / np.linalg.norm(v)
    units = {i: unit(np.asarray(v, float)) for i, v in rows}
    first = sorted(units, key=lambda i: (sha256(str(i).encode()).hexdigest(), i))[:k]
    centres = [units[i] for i in first]
    for _ in range(rounds):
        sums = [np.zeros_like(centres[0]) for _ in centres]
        for u in units.values():
            sums[int(np.argmax([u @ m for m in centres]))] += u
        centres = [unit(s) if np.linalg.norm(s) > 0 else m for s, m in zip(sums, centres)]
    return centres, {i: int(np.argmax([u @ m for m in centres])) for i, u in units.items()}


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    return [(i, [float(x) for x in np.float32(rng.normal(size=6) + 3 * np.eye(6)[i % 3])]) for i in range(120)]


@pytest.mark.parametrize("parts", [1, 7])
def test_centroids_and_groups_equal_brute_force(spark, rows, parts):
    vectors = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    model = c.read_content(c.fit_content(vectors, k=5, rounds=3), 5)
    centres, groups = brute(rows, 5, 3)
    assert np.allclose(model.matrix, centres, atol=1e-12)
    got = {r.text_id: r.g for r in vectors.select("text_id", c.nearest(model, F.col("embedding")).alias("g")).collect()}
    assert got == groups


def test_vectors_without_direction_go_to_the_last_group(spark):
    nan, inf = float("nan"), float("inf")
    odd = [(1, None), (2, [0.0, 0.0]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [1.0]), (6, [None, 1.0]), (7, []), (8, [2.0, 0.0]), (9, [0.0, 3.0])]
    vectors = spark.createDataFrame(odd, SCHEMA).filter("text_id <> 5").repartition(3)
    model = c.read_content(c.fit_content(vectors, k=4, rounds=2), 4)
    assert model.matrix.shape == (2, 2)
    got = {r.text_id: r.g for r in spark.createDataFrame(odd, SCHEMA).select("text_id", c.nearest(model, F.col("embedding")).alias("g")).collect()}
    assert [got[i] for i in range(1, 8)] == [4] * 7 and {got[8], got[9]} == {0, 1}


def test_no_vectors_and_equal_vectors(spark):
    none = spark.createDataFrame([], SCHEMA)
    model = c.read_content(c.fit_content(none, k=3), 3)
    same = spark.createDataFrame([(i, [1.0, 1.0]) for i in range(4)], SCHEMA)
    assert [r.g for r in same.select(c.nearest(model, F.col("embedding")).alias("g")).collect()] == [3] * 4
    model = c.read_content(c.fit_content(same, k=3), 3)
    assert [r.g for r in same.select(c.nearest(model, F.col("embedding")).alias("g")).collect()] == [0] * 4


def test_a_stream_gets_the_same_contents_as_a_batch(spark, rows):
    vectors = spark.createDataFrame(rows, SCHEMA)
    model = c.read_content(c.fit_content(vectors, k=5, rounds=2), 5)
    log = vectors.withColumn("user_id", F.col("text_id") % 7)
    stream = content_counts(replay(log, 3).select("user_id", "embedding"), model)
    sink = new_folder(spark, "content-test")
    run_available(stream, parquet_step(sink), "content-test", "update")
    got = {tuple(r) for r in latest_per_key(spark, sink, stream.schema, ["user_id", "content"]).collect()}
    state = content_bucket(c.nearest(model, F.col("embedding")).cast("string")).alias("content")
    want = {tuple(r) for r in log.select("user_id", state).groupBy("user_id", "content").count().collect()}
    assert got == want


def test_unit_rows_of_an_empty_batch():
    units, known = c.unit_rows(pd.Series([], dtype=object), 3)
    assert units.shape == (0, 3) and known.shape == (0,)
