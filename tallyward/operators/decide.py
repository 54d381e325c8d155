"""From risk to tiered, cost-weighted decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyward.functions import expr
from tallyward.operators.evaluate import precision_curve, score_counts
from tallyward.sources.schema import NORMAL

# Tiers, precision targets and cost assumptions.
TIERS = ["suspend", "challenge", "rate_limit", "monitor"]
PRECISION_TARGETS = {"suspend": 0.99, "challenge": 0.90, "rate_limit": 0.60}
COST_FALSE_POSITIVE = {"suspend": 100.0, "challenge": 5.0, "rate_limit": 1.0, "monitor": 0.0}
COST_MISSED = {"spam_bot": 10.0, "account_farmer": 20.0, "prompt_sprayer": 15.0, "token_thief": 200.0}
EFFECT = {"suspend": 1.0, "challenge": 0.8, "rate_limit": 0.4, "monitor": 0.0}


def precision_thresholds(
    scored: DataFrame, score: str, truth: Column, targets: dict[str, float] = PRECISION_TARGETS
) -> DataFrame:
    """One row (suspend, challenge, rate_limit): the lowest score that still meets each precision
    target, infinity when none does, and never above the threshold of the stricter tier."""
    curve = precision_curve(score_counts(scored, score, truth))
    never = F.lit(float("inf"))
    lowest = [
        F.coalesce(F.min(F.when((F.col("precision") >= t) & (F.col("tp") > 0), F.col("score"))), never).alias(name)
        for name, t in targets.items()
    ]
    raw = curve.agg(*lowest)
    challenge = F.least("challenge", "suspend")
    return raw.select("suspend", challenge.alias("challenge"), F.least("rate_limit", challenge).alias("rate_limit"))


def tier_assignment(scored: DataFrame, score: str, thresholds: DataFrame) -> DataFrame:
    """Add ``tier``; the one threshold row enters as a scalar subquery."""
    limit = thresholds.select(F.struct(*TIERS[:3])).scalar()
    tier = F.lit(TIERS[3])
    for name in reversed(TIERS[:3]):
        tier = F.when(F.col(score) >= limit[name], name).otherwise(tier)
    return scored.withColumn("tier", tier)


def _tier_rows(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame(
        [(t, i, COST_FALSE_POSITIVE[t], EFFECT[t]) for i, t in enumerate(TIERS)],
        "tier string, tier_order int, fp_cost double, effect double",
    )


def _label_counts(decided: DataFrame) -> DataFrame:
    """Accounts per (tier, label): at most tiers x labels rows, all later work runs on them."""
    return decided.groupBy("tier", "label").agg(F.count("*").alias("n"))


def tier_table(decided: DataFrame) -> DataFrame:
    """Accounts, abusive accounts and precision of every tier, empty tiers included."""
    counts = _label_counts(decided).withColumn("bad", F.when(F.col("label") != NORMAL, F.col("n")).otherwise(0))
    per_tier = counts.groupBy("tier").agg(F.sum("n").alias("n"), F.sum("bad").alias("abusive"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return (
        _tier_rows(decided)
        .join(per_tier, "tier", "left")
        .select("tier", "tier_order", zero("n").alias("n"), zero("abusive").alias("abusive"))
        .withColumn("precision", expr.ratio(F.col("abusive"), F.greatest("n", F.lit(1))))
        .orderBy("tier_order")
        .drop("tier_order")
    )


def expected_cost(decided: DataFrame) -> DataFrame:
    """Cost of the decisions, cost of doing nothing, and the saving in percent."""
    cases = F.lit(0.0)
    for label, cost in COST_MISSED.items():
        cases = F.when(F.col("label") == label, cost).otherwise(cases)
    rows = _label_counts(decided).join(F.broadcast(_tier_rows(decided)), "tier")
    normal = F.col("label") == NORMAL
    cost = F.when(normal, F.col("fp_cost") * F.col("n")).otherwise(cases * (1 - F.col("effect")) * F.col("n"))
    nothing = F.when(normal, F.lit(0.0)).otherwise(cases * F.col("n"))
    return rows.agg(F.sum(cost).alias("expected_cost"), F.sum(nothing).alias("do_nothing")).withColumn(
        "reduction_pct", (1 - expr.ratio(F.col("expected_cost"), F.col("do_nothing"))) * 100
    )


def decision_table(decided: DataFrame) -> DataFrame:
    return decided.select("user_id", "label", "evasion", F.col("risk").cast("float").alias("risk"), "tier", "is_eval")
