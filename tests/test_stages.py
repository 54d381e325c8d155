import pytest
from pyspark.sql import functions as F

from tallyward.operators import boost, detect
from tallyward.sources.stages import StageStore


@pytest.fixture
def source(spark, tmp_path):
    place = str(tmp_path / "in.parquet")
    spark.range(10).write.parquet(place)
    return place


@pytest.fixture
def store(spark, source, tmp_path):
    return lambda **params: StageStore(spark, [source], str(tmp_path / "stages"), **params)


def counted(spark, calls, n=3):
    def make():
        calls.append(n)
        return spark.range(n)

    return make


def test_made_once_and_found_by_another_store(spark, store):
    calls = []
    first = store(a=1).table("numbers", counted(spark, calls))
    again = store(a=1).table("numbers", counted(spark, calls))
    assert first.count() == again.count() == 3 and len(calls) == 1


def test_other_parameters_or_stage_names_are_other_results(spark, store):
    calls = []
    store(a=1).table("numbers", counted(spark, calls))
    store(a=2).table("numbers", counted(spark, calls))
    store(a=1).table("numbers", counted(spark, calls), k=5)
    store(a=1).table("others", counted(spark, calls))
    assert len(calls) == 4


def test_a_changed_input_is_another_result(spark, store, source):
    calls = []
    store().table("numbers", counted(spark, calls))
    spark.range(1).write.mode("append").parquet(source)
    store().table("numbers", counted(spark, calls))
    assert len(calls) == 2


def test_a_failed_writer_leaves_nothing_to_read(spark, store):
    def fails():
        return spark.range(5).select(F.raise_error(F.lit("lost")).alias("x"))

    with pytest.raises(Exception, match="lost"):
        store().table("numbers", fails)
    assert store().find("numbers") is None
    calls = []
    assert store().table("numbers", counted(spark, calls)).count() == 3 and calls == [3]


def test_removal(spark, store):
    calls = []
    store().table("numbers", counted(spark, calls))
    store().table("others", counted(spark, calls))
    store().remove("numbers")
    assert store().find("numbers") is None and store().find("others")
    store().remove()
    assert store().find("others") is None


@pytest.fixture(scope="module")
def view(spark):
    rows = [(i, float(i % 9), None if i % 11 == 0 else float(i % 4), "spam_bot" if i % 9 > 6 else "normal", i % 3 == 0) for i in range(300)]
    data = spark.createDataFrame(rows, "user_id long, a double, b double, label string, is_test boolean")
    return data.select("user_id", "a", "b"), data.select("user_id", "label", F.col("label").alias("label_noisy"), "is_test")


def test_a_saved_detector_scores_alike(spark, store, view):
    table, split = view
    fit = lambda: detect.fit_detector(table, ["a", "b"], split)
    loaded = store().model("forest", fit, detect.save_detector, detect.load_detector)
    want = {r.user_id: tuple(r) for r in detect.score_detector(fit(), table, split, "x").collect()}
    got = {r.user_id: tuple(r) for r in detect.score_detector(loaded, table, split, "x").collect()}
    assert got == want and len(got) == 300


def test_a_saved_booster_is_the_same(spark, store, view):
    table, split = view
    made = boost.fit_boosted(table, ["a", "b"], split)
    loaded = store().model("boosted", lambda: made, boost.save_booster, boost.load_booster)
    want = sorted(tuple(r) for r in boost.score_boosted(made, table, split, "x").collect())
    assert sorted(tuple(r) for r in boost.score_boosted(loaded, table, split, "x").collect()) == want
