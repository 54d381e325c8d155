"""The whole analysis on the smallest test tables."""

from dataclasses import replace

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tallyward.catalog import canon
from tallyward.operators import decide, detect, graph
from tallyward.operators.features import NON_FEATURES
from tallyward.plans.risk import side_by_side
from tallyward.sources.tables import metric_columns


@pytest.fixture(scope="module")
def analysis(spark, sf):
    entry.queries()
    from tallyward.catalog.detectors import analysis

    return analysis(spark, sf)


def test_every_account_gets_one_decision(spark, analysis):
    out = analysis.decisions
    assert out.columns == ["user_id", "label", "evasion", "risk", "tier", "is_eval"]
    assert out.count() == 150 == out.select("user_id").distinct().count()
    assert out.filter(~F.col("tier").isin(decide.TIERS) | ~F.col("risk").between(0, 1)).isEmpty()


def test_tier_never_falls_as_risk_grows(spark, analysis):
    order = {t: i for i, t in enumerate(decide.TIERS)}
    ranked = [order[r.tier] for r in analysis.decisions.orderBy(F.desc("risk")).collect()]
    assert ranked == sorted(ranked)


def test_all_detectors_share_the_split(spark, analysis):
    want = {r.user_id: r.is_test for r in analysis.split.collect()}
    for scores in (analysis.tabular, analysis.sequence_scores, analysis.graph_scores):
        assert all(want[r.user_id] == r.is_test for r in scores.select("user_id", "is_test").collect())
    halves = analysis.signals.filter("(is_fit or is_eval) and not is_test")
    assert halves.isEmpty()


def test_no_label_column_among_features(analysis):
    assert not set(analysis.feature_columns) & set(NON_FEATURES)
    assert not set(detect.SIGNALS) & set(NON_FEATURES)


@pytest.fixture(scope="module")
def metric_list(analysis):
    return analysis.metrics().collect()


def test_metrics(analysis, metric_list):
    rows = {(r.metric, r.key): r.value for r in metric_list if r.stage == "fusion"}
    names = {m for m, _ in rows}
    assert {"abuse_pr_auc", "tier_accounts", "tier_precision", "expected_cost", "do_nothing", "reduction_pct"} <= names
    assert sum(v for (m, _), v in rows.items() if m == "tier_accounts") == analysis.signals.filter("is_eval").count()
    assert rows[("expected_cost", "")] >= 0


def test_every_stage_has_metrics(spark, metric_list):
    stages = {}
    for r in metric_list:
        stages.setdefault(r.stage, set()).add(r.metric)
    for detector in ("tabular", "sequence", "graph"):
        assert {"abuse_pr_auc", "class_pr_auc", "base_rate"} <= stages[detector]
    assert {"takeover_roc_auc", "takeover_median_hours"} <= stages["sequence"]
    assert {"precision", "recall", "rings", "largest"} <= stages["rings"]
    assert "recall_by_label" in stages["campaigns"]
    table = spark.createDataFrame(metric_list, "stage string, metric string, key string, value double")
    row = side_by_side(table).filter("metric = 'abuse_pr_auc' and key = ''").first()
    assert all(0 <= row[c] <= 1 for c in ("tabular", "sequence", "graph")) and row.fusion is None


@pytest.fixture(scope="module")
def written(analysis, tmp_path_factory):
    """DuckDB over the written signals and risk: the learned numbers are taken from there, the rest is SQL."""
    place = f"{tmp_path_factory.mktemp('written')}/risks"
    analysis.risk.write.parquet(place)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW risks AS SELECT * FROM '{place}/*.parquet'")
    return con


def test_risk_is_the_logistic_of_the_written_weights(analysis, written):
    scaler, logistic = analysis.fusion_model.stages[1:]
    weights = zip(detect.SIGNALS, logistic.coefficients, scaler.mean, scaler.std)
    margin = " + ".join(f"{float(w)!r} * ({c} - {float(m)!r}) / {float(s)!r}" for c, w, m, s in weights if s > 0)
    worst = written.sql(
        f"SELECT max(abs(risk - 1 / (1 + exp(-({margin} + {float(logistic.intercept)!r}))))), count(*) FROM risks"
    ).fetchall()[0]
    assert worst[0] < 1e-9 and worst[1] == 150


def test_tiers_follow_from_the_written_risk(analysis, written):
    tiers = canon.TIERS.replace(f"{canon.RISK},", "")
    want = dict(written.sql(f"WITH {tiers} SELECT user_id, tier FROM tiered").fetchall())
    assert {r.user_id: r.tier for r in analysis.decisions.collect()} == want and len(want) == 150


def test_average_precision_follows_from_the_written_risk(written, metric_list):
    got = {r.key: r.value for r in metric_list if (r.stage, r.metric) == ("fusion", "abuse_pr_auc")}
    for score, value in got.items():
        ap = canon.ap("a", "(SELECT *, label <> 'normal' AS bad FROM risks WHERE is_eval)", score, "bad")
        assert written.sql(f"WITH {ap} SELECT ap FROM a").fetchall()[0][0] == pytest.approx(value)
    assert len(got) == 4


def test_later_analyses_find_the_fitted_models(spark, sf, analysis, monkeypatch):
    from tallyward.catalog.detectors import analysis as again

    def refuse(*_):
        raise AssertionError("fitted again")

    analysis.risk  # noqa: B018
    monkeypatch.setattr(detect, "fit_detector", refuse)
    monkeypatch.setattr(detect, "fit_fusion", refuse)
    other = again(spark, sf)
    assert sorted(r.risk for r in other.risk.collect()) == sorted(r.risk for r in analysis.risk.collect())
    assert list(other.fusion_model.stages[-1].coefficients) == list(analysis.fusion_model.stages[-1].coefficients)


def test_metrics_read_stored_scores(spark, sf, analysis, metric_list, monkeypatch):
    """A forest is applied once for all its metrics and the fusion, not once for each of them."""
    from tallyward.catalog.detectors import analysis as again

    def refuse(*_):
        raise AssertionError("scored again")

    monkeypatch.setattr(detect, "score_detector", refuse)
    got = {(r.stage, r.metric, r.key): r.value for r in again(spark, sf).metrics().collect()}
    assert got == pytest.approx({(r.stage, r.metric, r.key): r.value for r in metric_list}, nan_ok=True) and len(got) == len(metric_list)


def test_a_row_of_metrics_is_computed_once(spark):
    one = spark.range(5).selectExpr("count(*) as n", "avg(id) as mean", "cast(null as double) as none")
    out = metric_columns(one, "s")
    assert [tuple(r) for r in out.collect()] == [("s", "n", "", 5.0), ("s", "mean", "", 2.0), ("s", "none", "", None)]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Range") == 1


def test_rings_follow_from_the_counts_of_the_neighbourhoods(spark, sf, monkeypatch):
    """The edges are grouped by entity once, for rings and neighbourhoods, not once for each."""
    from tallyward.catalog.detectors import analysis as again

    def refuse(*_):
        raise AssertionError("counted again")

    want = sorted(entry.queries()["ring_flags"](spark, sf).collect())
    monkeypatch.setattr(graph, "component_links", refuse)
    monkeypatch.setattr(graph, "entity_fanout", refuse)
    a = replace(again(spark, sf), store=None)
    assert sorted(a.rings.collect()) == want and graph.node_profile(a.incident).count() > 0
