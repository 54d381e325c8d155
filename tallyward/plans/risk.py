"""The whole risk analysis, from activity to decisions, as one sequence of DataFrame stages.

A stage is written to the shared folder where more than one later stage reads it; everything else
stays one lazy plan. With a store, those tables and the fitted models are found again by any later
analysis of the same inputs, so its results share one fit.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyward.operators import boost, campaign, decide, detect, evaluate, features, graph
from tallyward.operators import sequence as seq
from tallyward.operators import split as sp
from tallyward.operators.components import connected_components
from tallyward.operators.skew import join_grown
from tallyward.session import cut_lineage
from tallyward.sources.schema import ENDPOINTS, NORMAL
from tallyward.sources.stages import StageStore
from tallyward.sources.tables import load_model, metric_columns, metric_rows, save_model

TAKEN_OVER = "token_thief"


@dataclass
class RiskAnalysis:
    """Inputs of one analysis; results are computed on first use.

    activity: requests with prompt; accounts: one row per account; sequence: requests with learned
    ``content``; edges: account-entity edges; clustered: requests with cluster and tightness. The
    last three are given as functions, called only when a result needs them.
    """

    activity: DataFrame
    accounts: DataFrame
    sequence: Callable[[], DataFrame]
    edges: Callable[[], DataFrame]
    clustered: Callable[[], DataFrame]
    chat_endpoint: str = "/v1/chat"
    endpoints: tuple[str, ...] = tuple(ENDPOINTS)
    store: StageStore | None = None

    def _table(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        return self.store.table(name, make) if self.store else cut_lineage(make(), name)

    def _model(self, name: str, fit: Callable, save: Callable, load: Callable):
        return self.store.model(name, fit, save, load) if self.store else fit()

    def _detector(self, name: str, view: DataFrame, columns: list[str]) -> detect.Detector:
        fit = lambda: detect.fit_detector(view, columns, self.split)
        return self._model(name, fit, detect.save_detector, detect.load_detector)

    @cached_property
    def edge_table(self) -> DataFrame:
        """Edges are read to count entities and for those of many accounts: the log is scanned once."""
        return self._table("edges", self.edges)

    @cached_property
    def incident(self) -> DataFrame:
        """Edges with what is known of their entities: these are counted once, for the rings and for the neighbourhoods."""
        ends = self._table("entities", lambda: graph.entity_ends(self.edge_table))
        return graph.incident_rows(ends, self._table("wide_edges", lambda: graph.wide_edges(self.edge_table, ends)))

    @cached_property
    def account_table(self) -> DataFrame:
        """Accounts are read by every join with labels: they are made from their tables once."""
        return self._table("accounts", lambda: self.accounts)

    @cached_property
    def split(self) -> DataFrame:
        return self._table("split", lambda: sp.test_halves(sp.split_assignment(self.account_table)))

    @cached_property
    def features(self) -> DataFrame:
        made = lambda: features.account_features(self.activity, self.accounts, self.chat_endpoint)
        return self._table("features", made)

    @cached_property
    def feature_columns(self) -> list[str]:
        return features.feature_columns(self.features)

    @cached_property
    def encoded(self) -> DataFrame:
        return self._table("encoded", lambda: seq.event_encoding(seq.event_history(self.sequence()), list(self.endpoints)))

    @cached_property
    def spikes(self) -> DataFrame:
        return self._table("spikes", self._spikes)

    def _spikes(self) -> DataFrame:
        steps = seq.transitions(self.encoded)
        normals = self.split.filter(~F.col("is_test") & (F.col("label_noisy") == NORMAL))
        return seq.surprise_spike(seq.event_surprise(steps, seq.transition_model(steps, normals)))

    @cached_property
    def tabular_detector(self) -> detect.Detector:
        return self._detector("tabular_model", self.features, self.feature_columns)

    @cached_property
    def tabular(self) -> DataFrame:
        """Scores are stored, as each of their metrics and the fusion reads them: a forest is applied once."""
        return self._table("tabular_scores", lambda: detect.score_detector(self.tabular_detector, self.features, self.split, "tab"))

    @cached_property
    def booster(self) -> boost.Booster:
        fit = lambda: boost.fit_boosted(self.features, self.feature_columns, self.split)
        return self._model("boosted_model", fit, boost.save_booster, boost.load_booster)

    @cached_property
    def boosted(self) -> DataFrame:
        """The tabular view scored by the boosted detector."""
        return boost.score_boosted(self.booster, self.features, self.split, "tab")

    @cached_property
    def sequence_scores(self) -> DataFrame:
        return self._table("sequence_scores", self._sequence_scores)

    def _sequence_scores(self) -> DataFrame:
        pooled = self._table("pooled", lambda: seq.pooled_sequence(self.encoded, list(self.endpoints)))
        columns = [c for c in pooled.columns if c != "user_id"]
        model = self._detector("sequence_model", pooled, columns)
        scores = detect.score_detector(model, pooled, self.split, "seq")
        spikes = self.spikes.select(
            "user_id", F.col("spike_score").alias("seq_anomaly"), F.col("spike_ts").alias("seq_anomaly_ts")
        )
        out = join_grown(scores, spikes, "user_id", "left")
        return out.fillna(0, subset=["seq_anomaly", "seq_anomaly_ts"])

    @cached_property
    def graph_scores(self) -> DataFrame:
        return self._table("graph_scores", self._graph_scores)

    def _graph_scores(self) -> DataFrame:
        view = self._table("around", self._around)
        columns = [c for c in view.columns if c != "user_id"]
        return detect.score_detector(self._detector("graph_model", view, columns), view, self.split, "graph")

    def _around(self) -> DataFrame:
        """Own features, two rounds of pooled neighbourhoods and degrees."""
        own = self.features.select("user_id", *self.feature_columns).fillna(detect.MISSING)
        profile = graph.node_profile(self.incident)
        around = graph.propagate_pooled(own, self.incident, profile, self.feature_columns, rounds=2)
        degrees = profile.drop("alone", *[c for c in profile.columns if c.startswith("share_")])
        return around.join(degrees, "user_id", "left")

    @cached_property
    def rings(self) -> DataFrame:
        return self._table("rings", self._rings)

    def _rings(self) -> DataFrame:
        components = connected_components(graph.incident_links(self.incident), "src", "dst")
        return graph.ring_flags(self.account_table, components)

    @cached_property
    def spray(self) -> DataFrame:
        return self._table("spray", self._spray)

    def _spray(self) -> DataFrame:
        rows = self.clustered()
        active = rows.agg(F.count_distinct("user_id")).scalar()
        stats = campaign.cluster_stats(rows, active)
        return campaign.campaign_accounts(rows, campaign.campaign_clusters(stats), self.account_table)

    @cached_property
    def signals(self) -> DataFrame:
        return self._table("signals", self._signals)

    def _signals(self) -> DataFrame:
        joined = detect.fusion_signals(
            self.account_table, self.tabular, self.sequence_scores, self.graph_scores, self.rings, self.spray
        )
        halves = self.split.select("user_id", "is_fit", "is_eval")
        return join_grown(joined, halves, "user_id")

    @cached_property
    def fusion_model(self):
        fit = lambda: detect.fit_fusion(self.signals.filter("is_fit"))
        return self._model("fusion_model", fit, save_model, load_model)

    @cached_property
    def risk(self) -> DataFrame:
        return self._table("risk", lambda: detect.fused_risk(self.fusion_model, self.signals))

    @cached_property
    def thresholds(self) -> DataFrame:
        fit = self.risk.filter("is_fit")
        return decide.precision_thresholds(fit, "risk", F.col("label_noisy") != NORMAL)

    @cached_property
    def decisions(self) -> DataFrame:
        return decide.decision_table(decide.tier_assignment(self.risk, "risk", self.thresholds))

    def detector_metrics(self, stage: str, scores: DataFrame, prefix: str) -> list[DataFrame]:
        """Rows of one detector on the test accounts it has scored."""
        labels = self.account_table.select("user_id", "label", "evasion")
        test = cut_lineage(join_grown(scores.filter("is_test"), labels, "user_id"), "test")
        bad, abuse = F.col("label") != NORMAL, f"{prefix}_abuse"
        skipped = {abuse, f"{prefix}_anomaly", f"{prefix}_anomaly_ts"}
        classes = {c.removeprefix(f"{prefix}_"): c for c in scores.columns if c.startswith(f"{prefix}_") and c not in skipped}
        return [
            metric_rows(evaluate.average_precision(test, abuse, bad), stage, "abuse_pr_auc", None, "ap"),
            metric_rows(evaluate.per_class_ap(test, classes), stage, "class_pr_auc", "class", "ap"),
            metric_rows(evaluate.ap_by_slice(test, abuse, bad), stage, "pr_auc_by_evasion", "slice", "ap"),
            metric_rows(evaluate.precision_at_k(test, abuse, bad), stage, "precision_at_k", "k", "precision"),
            metric_columns(evaluate.base_rate(test, bad), stage),
        ]

    def takeover_metrics(self) -> list[DataFrame]:
        """How well spikes of surprise tell taken-over accounts of the test side, and when."""
        held_out = join_grown(self.account_table, self.split.filter("is_test").select("user_id"), "user_id", "left_semi")
        long = self.spikes.filter(F.col("transitions") >= 2 * seq.SMOOTH)
        scored = join_grown(long, held_out.select("user_id", "label"), "user_id")
        pair = scored.filter(F.col("label").isin(TAKEN_OVER, NORMAL))
        auc = evaluate.roc_auc(pair, "spike_score", F.col("label") == TAKEN_OVER)
        error = seq.localisation_error(held_out, self.spikes)
        return [
            metric_rows(auc, "sequence", "takeover_roc_auc", None, "auc"),
            metric_rows(error, "sequence", "takeover_median_hours", None, "median_hours"),
        ]

    def group_metrics(self) -> list[DataFrame]:
        """Rings and campaigns as flags over all accounts."""
        rings = evaluate.flag_quality(self.rings, "ring_flag", F.col("label").isin(graph.COORDINATED))
        sizes = self.rings.groupBy("component_id").agg(F.max("component_size").alias("size"))
        largest = sizes.agg(F.count_if(F.col("size") >= graph.MIN_RING).alias("rings"), F.max("size").alias("largest"))
        spray = evaluate.flag_quality(self.spray, "spray_flag", F.col("label").isin(campaign.TARGETS))
        recall = campaign.campaign_recall(self.spray)
        return [
            metric_columns(rings, "rings"),
            metric_columns(largest, "rings"),
            metric_columns(spray, "campaigns"),
            metric_rows(recall, "campaigns", "recall_by_label", "label", "recall"),
        ]

    def fusion_metrics(self) -> list[DataFrame]:
        """Fused risk, tiers and cost on the evaluation half."""
        ev = self.risk.filter("is_eval")
        decided = cut_lineage(self.decisions.filter("is_eval"), "decided")
        bad = F.col("label") != NORMAL
        detectors = evaluate.detector_comparison(ev, ["risk", "tab_abuse", "seq_abuse", "graph_abuse"], bad)
        by_level = evaluate.ap_by_slice(ev, "risk", bad)
        tiers = decide.tier_table(decided)
        cost = decide.expected_cost(decided)
        return [
            metric_rows(detectors, "fusion", "abuse_pr_auc", "detector", "ap"),
            metric_rows(by_level, "fusion", "fused_by_evasion", "slice", "ap"),
            metric_rows(tiers, "fusion", "tier_accounts", "tier", "n"),
            metric_rows(tiers, "fusion", "tier_precision", "tier", "precision"),
            metric_columns(cost, "fusion"),
        ]

    def metrics(self) -> DataFrame:
        """Long metric table of all stages."""
        rows = [
            *self.detector_metrics("tabular", self.tabular, "tab"),
            *self.detector_metrics("sequence", self.sequence_scores, "seq"),
            *self.takeover_metrics(),
            *self.detector_metrics("graph", self.graph_scores, "graph"),
            *self.group_metrics(),
            *self.fusion_metrics(),
        ]
        return evaluate.union_all(rows)


def side_by_side(metrics: DataFrame, stages: Sequence[str] = ("tabular", "sequence", "graph", "fusion")) -> DataFrame:
    """One row per metric and key, one column per stage; null where a stage has no such number."""
    return metrics.groupBy("metric", "key").pivot("stage", list(stages)).agg(F.first("value")).filter(
        F.coalesce(*stages).isNotNull()
    )
