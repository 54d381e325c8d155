"""Evaluation of scores against truth.

Every ranking metric starts from counts per distinct, exact score. The counts are dealt to ranges of
scores; sums run inside each range, and a table with one row per range carries what lies above it. So
no window holds all scores, however many there are.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyward.functions import expr
from tallyward.session import cut_lineage

# Half-open evasion levels.
EVASION_BOUNDS = [(0.0, 0.33), (0.33, 0.66), (0.66, 1.01)]
MIN_POSITIVES = 5
KS = [100, 500, 1000]


def score_counts(scored: DataFrame, score: str, truth: Column, keys: Sequence[str] = ()) -> DataFrame:
    """Positives and rows per distinct score."""
    return scored.groupBy(*keys, F.col(score).alias("score")).agg(
        F.sum(truth.cast("long")).alias("pos"), F.count("*").alias("n")
    )


def precision_curve(counts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Running true positives and rows from the highest score down, one row per score."""
    ranged = counts.repartitionByRange(*[F.col(k) for k in keys], F.desc("score"))
    # written, so that every later step sees the same ranges
    rows = cut_lineage(ranged.withColumn("_range", F.spark_partition_id()), "ranges")
    part = Window.partitionBy(*keys)
    above = part.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*keys, "_range").agg(F.sum("pos").alias("_pos"), F.sum("n").alias("_n"))
    # one row per key and range
    sums = sums.select(
        *[F.col(k).alias(f"_key_{k}") for k in keys], F.col("_range").alias("_key_range"),
        F.coalesce(F.sum("_pos").over(above), F.lit(0)).alias("_tp"), F.coalesce(F.sum("_n").over(above), F.lit(0)).alias("_seen"),
        F.sum("_pos").over(part).alias("positives"), F.sum("_n").over(part).alias("rows"),
    )
    same = F.col("_range") == F.col("_key_range")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    down = Window.partitionBy(*keys, "_range").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    running = rows.withColumns({"tp": F.sum("pos").over(down), "seen": F.sum("n").over(down)})
    out = running.join(sums, same)
    out = out.withColumns({"tp": F.col("tp") + F.col("_tp"), "seen": F.col("seen") + F.col("_seen")})
    out = out.withColumn("precision", expr.ratio(F.col("tp"), F.col("seen")))
    return out.select(*keys, "score", "pos", "n", "tp", "seen", "positives", "rows", "precision")


def average_precision(scored: DataFrame, score: str, truth: Column, keys: Sequence[str] = ()) -> DataFrame:
    """Step-sum average precision per group of ``keys``; NULL without positives."""
    curve = precision_curve(score_counts(scored, score, truth, keys), keys)
    step = expr.ratio(F.col("pos"), F.col("positives")) * F.col("precision")
    return curve.groupBy(*keys).agg(
        F.max("positives").alias("support"), F.max("rows").alias("accounts"), F.sum(step).alias("ap")
    )


def roc_auc(scored: DataFrame, score: str, truth: Column, keys: Sequence[str] = ()) -> DataFrame:
    """Mann-Whitney AUC; pairs with equal scores count one half."""
    curve = precision_curve(score_counts(scored, score, truth, keys), keys)
    negatives, neg = F.col("rows") - F.col("positives"), F.col("n") - F.col("pos")
    below = negatives - (F.col("seen") - F.col("tp"))
    won = F.sum(F.col("pos") * (below + neg / 2.0))
    pairs = F.max("positives").cast("double") * F.max(negatives)
    return curve.groupBy(*keys).agg(
        F.max("positives").alias("positives"), F.max(negatives).alias("negatives"), F.try_divide(won, pairs).alias("auc")
    )


def per_class_ap(scored: DataFrame, scores: dict[str, str], label: str = "label") -> DataFrame:
    """One-vs-rest average precision; ``scores`` maps a class to its score column.

    The scores are unpivoted, so all classes are evaluated in one pass.
    """
    pairs = ", ".join(f"'{c}', `{col}`" for c, col in scores.items())
    long = scored.selectExpr(label, f"stack({len(scores)}, {pairs}) as (class, _s)")
    return average_precision(long, "_s", F.col(label) == F.col("class"), ["class"])


def precision_at_k(scored: DataFrame, score: str, truth: Column, ks: Sequence[int] = KS) -> DataFrame:
    """Share of positives in the k highest scores, with the best value k allows; k above n is left out.

    Only the top max(k) rows are ever ordered together.
    """
    base = scored.agg(F.struct(F.count("*").alias("n"), F.sum(truth.cast("long")).alias("pos"))).scalar()
    top = (
        scored.select("user_id", F.col(score).alias("_s"), truth.cast("double").alias("_t"))
        .orderBy(F.desc("_s"), "user_id")
        .limit(max(ks))
    )
    ranked = top.withColumn("_r", F.row_number().over(Window.orderBy(F.desc("_s"), "user_id")))
    per_k = ranked.select(F.explode(F.array(*[F.lit(k) for k in ks])).alias("k"), "_r", "_t").filter("_r <= k")
    return (
        per_k.groupBy("k")
        .agg(F.avg("_t").alias("precision"))
        .filter(F.col("k") <= base["n"])
        .withColumn("achievable", F.least(F.lit(1.0), base["pos"] / F.col("k")))
        .orderBy("k")
    )


def slice_name(value: Column, bounds: Sequence[tuple[float, float]]) -> Column:
    cases = [F.when((value >= lo) & (value < hi), f"{lo:.2f}-{hi:.2f}") for lo, hi in bounds]
    return F.coalesce(*cases)


def ap_by_slice(
    scored: DataFrame,
    score: str,
    truth: Column,
    slice_col: str = "evasion",
    bounds: Sequence[tuple[float, float]] = EVASION_BOUNDS,
    min_positives: int = MIN_POSITIVES,
) -> DataFrame:
    """Average precision per slice of the positives; every slice is ranked against all negatives.

    Negatives join each slice as counts per score, so they are repeated as a bounded table.
    """
    where = F.when(truth.cast("boolean"), slice_name(F.col(slice_col), bounds))
    flagged = scored.select(F.col(score).alias("_s"), truth.cast("boolean").alias("_t"), where.alias("slice"))
    counts = score_counts(flagged, "_s", F.col("_t"), ["_t", "slice"]).filter("slice is not null or not _t")
    names = F.array(*[F.lit(f"{lo:.2f}-{hi:.2f}") for lo, hi in bounds])
    spread = counts.withColumn("slice", F.explode(F.when(F.col("_t"), F.array("slice")).otherwise(names)))
    merged = spread.groupBy("slice", "score").agg(F.sum("pos").alias("pos"), F.sum("n").alias("n"))
    curve = precision_curve(merged, ["slice"])
    step = expr.ratio(F.col("pos"), F.col("positives")) * F.col("precision")
    return (
        curve.groupBy("slice")
        .agg(F.max("positives").alias("support"), F.sum(step).alias("ap"))
        .filter(F.col("support") >= min_positives)
        .orderBy("slice")
    )


def flag_quality(flagged: DataFrame, flag: str, target: Column) -> DataFrame:
    """Precision and recall of a flag against a target set; empty sets count as size one."""
    f, t = F.col(flag).cast("boolean"), target.cast("boolean")
    count = lambda c: F.sum(c.cast("long"))
    agg = flagged.agg(count(f & t).alias("tp"), count(f).alias("flagged"), count(t).alias("targets"))
    one = F.lit(1)
    return agg.withColumns(
        {
            "precision": expr.ratio(F.col("tp"), F.greatest("flagged", one)),
            "recall": expr.ratio(F.col("tp"), F.greatest("targets", one)),
        }
    )


def flag_by_label(flagged: DataFrame, flag: str) -> DataFrame:
    f = F.col(flag).cast("boolean")
    return (
        flagged.groupBy("label")
        .agg(F.sum(f.cast("long")).alias("flagged"), F.count("*").alias("accounts"))
        .withColumn("share", expr.ratio(F.col("flagged"), F.col("accounts")))
        .orderBy("label")
    )


def base_rate(scored: DataFrame, truth: Column) -> DataFrame:
    return scored.agg(F.count("*").alias("accounts"), F.avg(truth.cast("double")).alias("base_rate"))


def detector_comparison(scored: DataFrame, detectors: Sequence[str], truth: Column) -> DataFrame:
    """Average precision of several score columns over one population, best first."""
    pairs = ", ".join(f"'{d}', `{d}`" for d in detectors)
    long = scored.withColumn("_t", truth.cast("int")).selectExpr("_t", f"stack({len(detectors)}, {pairs}) as (detector, _s)")
    return average_precision(long, "_s", F.col("_t") == 1, ["detector"]).orderBy(F.desc("ap"), "detector")


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
