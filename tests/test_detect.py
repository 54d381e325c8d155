import pytest
from pyspark.sql import functions as F

from tallyward.operators import detect
from tallyward.operators import split as sp
from tallyward.sources import tables
from tests.fixtures import account, accounts

CLASSES = ["account_farmer", "normal", "prompt_sprayer", "spam_bot", "token_thief"]


@pytest.fixture(scope="module")
def case(spark):
    people = accounts(spark, *[account(i, CLASSES[i % 5], evasion=(i % 10) / 10) for i in range(300)]).persist()
    view = people.select("user_id", *[(F.col("label") == c).cast("double").alias(f"f_{c}") for c in CLASSES[:4]])
    view = view.withColumn("noise", (F.col("user_id") * 13 % 7).cast("double"))
    split = sp.test_halves(sp.split_assignment(people)).persist()
    columns = [c for c in view.columns if c != "user_id"]
    return people, view, split, detect.fit_detector(view, columns, split)


def test_scores_cover_every_account_once(spark, case):
    people, view, split, model = case
    scores = detect.score_detector(model, view, split, "tab")
    assert scores.columns == ["user_id", "tab_abuse", *[f"tab_{c}" for c in CLASSES if c != "normal"], "is_test"]
    assert scores.count() == people.count() == scores.select("user_id").distinct().count()
    total = scores.select((F.col("tab_abuse") - sum(F.col(f"tab_{c}") for c in CLASSES if c != "normal")).alias("gap"))
    assert total.agg(F.max(F.abs("gap"))).first()[0] < 1e-9
    assert model.classes == CLASSES
    split_flags = {r.user_id: r.is_test for r in split.collect()}
    assert {r.user_id: r.is_test for r in scores.collect()} == split_flags


def test_separable_classes_are_found(spark, case):
    people, view, split, model = case
    scored = detect.score_detector(model, view, split, "tab").join(people.select("user_id", "label"), "user_id")
    worst_abuse = scored.filter("label != 'normal'").agg(F.min("tab_abuse")).first()[0]
    best_normal = scored.filter("label = 'normal'").agg(F.max("tab_abuse")).first()[0]
    assert worst_abuse > best_normal


def test_label_columns_are_refused(spark, case):
    people, view, split, _ = case
    with pytest.raises(ValueError, match="evasion"):
        detect.fit_detector(people, ["evasion"], split)


def test_importance_and_model_round_trip(spark, case, tmp_path):
    _, view, split, model = case
    top = detect.feature_importance(model, spark).collect()
    assert [r.rank for r in top] == list(range(1, 6)) and top[0].importance >= top[-1].importance
    assert top[-1].feature == "noise"
    tables.save_model(model.model, str(tmp_path / "m"))
    again = detect.Detector(tables.load_model(str(tmp_path / "m")), model.columns, model.classes)
    a = sorted(map(tuple, detect.score_detector(model, view, split, "x").collect()))
    assert a == sorted(map(tuple, detect.score_detector(again, view, split, "x").collect()))


def test_fusion(spark, case):
    people, view, split, model = case
    tab = detect.score_detector(model, view, split, "tab")
    graph = tab.select("user_id", F.col("tab_abuse").alias("graph_abuse"))
    seq = tab.filter("user_id % 2 = 0").select("user_id", F.lit(0.4).alias("seq_abuse"), F.lit(1.0).alias("seq_anomaly"))
    rings = people.select("user_id", F.lit(True).alias("ring_flag"), F.lit(9).cast("long").alias("component_size"))
    spray = people.select("user_id", F.col("user_id").alias("spray_events"))
    signals = detect.fusion_signals(people, tab, seq, graph, rings, spray)
    got = {r.user_id: r for r in signals.collect()}
    assert len(got) == 300
    assert (got[1].seq_abuse, got[1].seq_anomaly, got[1].seq_missing) == (0.5, 0.0, 1.0)
    assert (got[2].seq_abuse, got[2].seq_missing, got[2].ring_flag) == (0.4, 0.0, 1.0)
    assert got[2].comp_size == pytest.approx(2.302585092994046) and got[0].spray_sig == 0.0
    fit = signals.join(split.select("user_id", "is_fit"), "user_id").filter("is_fit")
    fused = detect.fit_fusion(fit)
    risk = detect.fused_risk(fused, signals)
    model_risk = fused.transform(signals).select("user_id", F.expr("probability").alias("p"))
    both = risk.join(model_risk, "user_id").collect()
    assert all(abs(r.risk - r.p[1]) < 1e-12 for r in both)
    weights = detect.fusion_weights(fused, spark).collect()
    assert [r.rank for r in weights] == list(range(1, 9))
    assert all(abs(weights[i].weight) >= abs(weights[i + 1].weight) for i in range(7))


def test_forest_passes_run_in_partitions_of_the_cluster(spark, monkeypatch):
    """A task sends histograms of fixed size, so tasks are counted by the cores, not by the input."""
    found = []

    class Recorded:
        def __init__(self, stages):
            pass

        def fit(self, rows):
            found.append((rows.rdd.getNumPartitions(), rows.count()))

    monkeypatch.setattr(detect, "cut_lineage", lambda df, name: df.repartition(100))
    monkeypatch.setattr(detect, "Pipeline", Recorded)
    split = spark.range(300).selectExpr("id as user_id", "if(id % 2 = 0, 'normal', 'spam_bot') as label", "if(id % 2 = 0, 'normal', 'spam_bot') as label_noisy", "false as is_test")
    detect.fit_detector(spark.range(300).selectExpr("id as user_id", "id * 1.0D as x"), ["x"], split)
    parts, rows = found[0]
    assert rows == 300 and parts <= 2 * spark.sparkContext.defaultParallelism < 100


def test_signals_of_accounts_are_not_broadcast(spark, case):
    """Accounts grow with the input, so none of their tables may go through the driver, however small it seems."""
    people, view, split, model = case
    scores = detect.score_detector(model, view, split, "tab")
    seq = people.select("user_id", F.lit(0.5).alias("seq_abuse"), F.lit(0.0).alias("seq_anomaly"))
    rings = people.select("user_id", F.lit(True).alias("ring_flag"), F.lit(3).alias("component_size"))
    spray = people.select("user_id", F.lit(1).alias("spray_events"))
    joined = detect.fusion_signals(people, scores, seq, scores.withColumnRenamed("tab_abuse", "graph_abuse"), rings, spray)
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin [user_id" not in plan and plan.count("SortMergeJoin [user_id") >= 6
    assert joined.count() == people.count()
