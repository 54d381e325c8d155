"""Learned detectors and fusion. Scores depend on the learner; next to them stand queries for what does not."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyward.catalog import campaign, canon, features, graph, sequence
from tallyward.catalog.registry import BOOL, DBL, INT, query, sql
from tallyward.operators import boost, detect, evaluate
from tallyward.plans.risk import RiskAnalysis, side_by_side
from tallyward.sources import star
from tallyward.sources.schema import NORMAL
from tallyward.sources.stages import StageStore


INPUTS = ["events", "documents", "embeddings", "customer", "orders", "lineitem"]


def analysis(spark, d) -> RiskAnalysis:
    """The analysis of one set of tables; queries of one session or of later ones share its stages."""
    return RiskAnalysis(
        activity=star.activity(spark, d),
        accounts=star.accounts(spark, d),
        sequence=lambda: star.sequence_events(spark, d),
        edges=lambda: graph.edges(spark, d),
        clustered=lambda: campaign.clustered(spark, d),
        chat_endpoint=features.CHAT,
        endpoints=tuple(sequence.KINDS),
        store=StageStore(spark, [f"{d}/{t}.parquet" for t in INPUTS], endpoints=sequence.KINDS),
    )


@query("tabular_scores")
def tabular_scores(spark, d):
    return analysis(spark, d).tabular


def _probabilities(scores, prefix):
    """user_id, is_test, and whether abuse is the sum of the probabilities of the abusive classes."""
    parts = [F.col(c) for c in scores.columns if c.startswith(f"{prefix}_") and c != f"{prefix}_abuse" and "anomaly" not in c]
    total = sum(parts[1:], parts[0])
    inside = F.col(f"{prefix}_abuse").between(0, 1 + 1e-9) & (F.abs(total - F.col(f"{prefix}_abuse")) < 1e-9)
    return scores.select("user_id", "is_test", inside.alias("consistent"))


@query(
    "tabular_score_check",
    sql(
        f"{canon.ACCOUNTS}, {canon.SPLIT}", "SELECT user_id, is_test, true AS consistent FROM split",
        user_id=INT, is_test=BOOL, consistent=BOOL,
    ),
)
def tabular_score_check(spark, d):
    """One row per account, with its side of the split; class probabilities add up."""
    return _probabilities(analysis(spark, d).tabular, "tab")


@query(
    "sequence_score_check",
    sql(
        f"{canon.ACCOUNTS}, {canon.SPLIT}",
        "SELECT user_id, is_test, true AS consistent FROM split SEMI JOIN events USING (user_id)",
        user_id=INT, is_test=BOOL, consistent=BOOL,
    ),
)
def sequence_score_check(spark, d):
    """One row per account with events."""
    return _probabilities(analysis(spark, d).sequence_scores, "seq")


@query("feature_importance")
def feature_importance(spark, d):
    return detect.feature_importance(analysis(spark, d).tabular_detector, spark)


@query("boosted_scores")
def boosted_scores(spark, d):
    return analysis(spark, d).boosted


@query("boosted_importance")
def boosted_importance(spark, d):
    return boost.boosted_importance(analysis(spark, d).booster, spark)


@query("tabular_comparison")
def tabular_comparison(spark, d):
    """Average precision of the forest and of the boosted trees on the test accounts."""
    a = analysis(spark, d)
    both = a.tabular.select("user_id", "is_test", F.col("tab_abuse").alias("forest")).join(a.boosted.select("user_id", F.col("tab_abuse").alias("boosted")), "user_id")
    test = both.filter("is_test").join(a.accounts.select("user_id", "label"), "user_id")
    return evaluate.detector_comparison(test, ["forest", "boosted"], F.col("label") != NORMAL)


@query("sequence_scores")
def sequence_scores(spark, d):
    return analysis(spark, d).sequence_scores


@query("graph_scores")
def graph_scores(spark, d):
    return analysis(spark, d).graph_scores


@query("fused_risk")
def fused_risk(spark, d):
    return analysis(spark, d).decisions


@query("fusion_weights")
def fusion_weights(spark, d):
    return detect.fusion_weights(analysis(spark, d).fusion_model, spark)


@query("risk_metrics")
def risk_metrics(spark, d):
    return analysis(spark, d).metrics()


@query("metric_comparison")
def metric_comparison(spark, d):
    """The metrics that several stages have, side by side."""
    return side_by_side(analysis(spark, d).metrics())
