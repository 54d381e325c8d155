"""The boosted detector: cuts and trees against brute force, and against the forest on made accounts."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyward.operators import boost, detect, evaluate
from tallyward.session import new_folder


@pytest.fixture(scope="module")
def population(spark):
    """Three labels: one by the sign of a product of two columns, one by a threshold, and noise columns."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 4))
    label = np.where(x[:, 0] * x[:, 1] > 0.3, "spam_bot", np.where(x[:, 2] > 1, "token_thief", "normal"))
    rows = [(i, *map(float, x[i]), str(label[i]), i % 3 == 0) for i in range(len(x))]
    df = spark.createDataFrame(rows, "user_id long, a double, b double, c double, d double, label string, is_test boolean")
    df = df.withColumn("c", F.when(F.col("user_id") % 50 != 1, F.col("c")))
    return df.select("user_id", *"abcd"), df.select("user_id", "label", F.col("label").alias("label_noisy"), "is_test")


def ap(scores, split, column):
    test = scores.filter("is_test").drop("is_test").join(split, "user_id")
    return evaluate.average_precision(test, column, F.col("label") != "normal").first()["ap"]


def test_boosting_beats_the_forest(spark, population):
    view, split = population
    booster = boost.fit_boosted(view, [*"abcd"], split)
    scores = boost.score_boosted(booster, view, split, "tab")
    forest = detect.score_detector(detect.fit_detector(view, [*"abcd"], split), view, split, "tab")
    assert scores.columns == forest.columns and scores.count() == 1500
    ours, theirs = ap(scores, split, "tab_abuse"), ap(forest, split, "tab_abuse")
    assert ours > 0.95 and ours > theirs
    top = [r["feature"] for r in boost.boosted_importance(booster, spark).collect()]
    assert set(top[:3]) == {"a", "b", "c"}
    # the metric of the written scores, stated in SQL
    folder = new_folder(spark, "scores")
    scores.filter("is_test").drop("is_test").join(split, "user_id").write.parquet(folder)
    sql = f"""SELECT sum(pos * tp / seen) / sum(pos) FROM (SELECT pos, sum(pos) OVER w AS tp, sum(n) OVER w AS seen
        FROM (SELECT tab_abuse AS s, count(*) AS n, sum((label <> 'normal')::int) AS pos FROM '{folder}/*.parquet' GROUP BY 1)
        WINDOW w AS (ORDER BY s DESC))"""
    assert abs(duckdb.sql(sql).fetchall()[0][0] - ours) < 1e-9


def test_probabilities_add_up_and_with_exact_quantiles_the_layout_does_not_matter(population):
    view, split = population
    a = boost.score_boosted(boost.fit_boosted(view.repartition(3), [*"abcd"], split, rounds=3, error=0.0), view, split, "tab")
    b = boost.score_boosted(boost.fit_boosted(view.coalesce(1), [*"abcd"], split, rounds=3, error=0.0), view, split, "tab")
    one, two = ({r["user_id"]: r for r in s.collect()} for s in (a, b))
    assert all(abs(one[k]["tab_abuse"] - two[k]["tab_abuse"]) < 1e-6 for k in one)
    assert all(abs(r["tab_spam_bot"] + r["tab_token_thief"] - r["tab_abuse"]) < 1e-12 and 0 <= r["tab_abuse"] <= 1 for r in one.values())


def test_written_scores_change_nothing(population, monkeypatch):
    view, split = population
    whole = boost.fit_boosted(view, [*"abcd"], split, rounds=5)
    monkeypatch.setattr(boost, "KEEP", 2)
    kept = boost.fit_boosted(view, [*"abcd"], split, rounds=5)
    for p, q in zip(whole.rounds, kept.rounds):
        assert all(np.array_equal(s.column, t.column) and np.allclose(s.value, t.value) for s, t in zip(p, q))


def test_best_cut_equals_brute_force():
    rng = np.random.default_rng(1)
    sums = np.abs(rng.normal(size=(2, 3, 8, 2))) + 0.1
    sums[..., 0] *= rng.choice([-1, 1], size=(2, 3, 8))
    found = boost.best_cuts(sums)
    worth = lambda s: s[0] ** 2 / (s[1] + boost.L2)
    for k in range(2):
        for node in range(3):
            h = sums[k, node]
            gains = [worth(h[: c + 1].sum(0)) + worth(h[c + 1 :].sum(0)) - worth(h.sum(0)) for c in range(7)]
            assert found[k, node, 1] == np.argmax(gains) and abs(found[k, node, 0] - max(gains)) < 1e-9
            assert np.allclose(found[k, node, 2:], [*h[: int(np.argmax(gains)) + 1].sum(0), *h[int(np.argmax(gains)) + 1 :].sum(0)])


def test_leaves_follow_the_cuts():
    tree = boost.Tree(np.array([0, 1, -1]), np.array([3, 5, 9]), np.array([1.0, 2.0, 3.0, 4.0]))
    x = np.array([[3, 5], [3, 6], [4, 0], [9, 9]], np.uint8)
    assert tree.leaves(x, 2).tolist() == [0, 1, 2, 2] and tree.leaves(x, 0).tolist() == [0] * 4


def test_labels_are_refused_as_columns(population):
    view, split = population
    with pytest.raises(ValueError):
        boost.fit_boosted(view.withColumn("evasion", F.lit(1.0)), ["a", "evasion"], split)
