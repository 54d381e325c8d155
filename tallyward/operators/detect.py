"""Learned detectors on Spark ML: one forest recipe for three views of an account, and the fusion.

All detectors train on noisy labels of the training accounts of one shared split and score every
account of their view.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyward.operators.features import NON_FEATURES
from tallyward.operators.skew import join_grown
from tallyward.operators.split import class_weights
from tallyward.session import cut_lineage, per_core
from tallyward.sources.schema import NORMAL

MISSING = -1.0
TREES = 60
DEPTH = 8
# The stacked signals of the fusion.
SIGNALS = [
    "tab_abuse", "seq_abuse", "seq_anomaly", "graph_abuse", "ring_flag", "spray_sig", "comp_size", "seq_missing",
]


@dataclass(frozen=True)
class Detector:
    model: PipelineModel
    columns: list[str]
    classes: list[str]


def check_columns(columns: Sequence[str]) -> None:
    leaked = sorted(set(columns) & set(NON_FEATURES))
    if leaked:
        raise ValueError(f"label or identity columns among the features: {leaked}")


def fit_detector(view: DataFrame, columns: Sequence[str], split: DataFrame, seed: int = 0) -> Detector:
    """Class-weighted multi-class forest on ``columns`` of ``view`` (one row per account)."""
    check_columns(columns)
    filled = view.select("user_id", *columns).fillna(MISSING)
    weights = class_weights(split).select("label_noisy", "weight")
    train = filled.join(split.filter(~F.col("is_test")), "user_id").join(F.broadcast(weights), "label_noisy")
    # tree learning passes over its input several times, and every task sends histograms of all growing nodes
    train = per_core(cut_lineage(train, "train"))
    # classes come from the clean label set in alphabetical order; training reads the noisy column
    indexer = StringIndexer(inputCol="label", outputCol="_y", stringOrderType="alphabetAsc").fit(split.select("label"))
    indexed = indexer.setInputCol("label_noisy").transform(train)
    forest = RandomForestClassifier(
        featuresCol="_x", labelCol="_y", weightCol="weight", numTrees=TREES, maxDepth=DEPTH, subsamplingRate=0.8,
        featureSubsetStrategy="sqrt", seed=seed, maxMemoryInMB=1024, cacheNodeIds=True,
    )
    model = Pipeline(stages=[VectorAssembler(inputCols=list(columns), outputCol="_x"), forest]).fit(indexed)
    return Detector(model, list(columns), list(indexer.labels))


def score_detector(detector: Detector, view: DataFrame, split: DataFrame, prefix: str) -> DataFrame:
    """Abuse score, one probability per abusive class, and is_test of every account in ``view``."""
    filled = view.select("user_id", *detector.columns).fillna(MISSING)
    out = detector.model.transform(filled).withColumn("_p", vector_to_array("probability"))
    p = {c: F.col("_p")[i] for i, c in enumerate(detector.classes)}
    abuse = (F.lit(1.0) - p[NORMAL]).alias(f"{prefix}_abuse")
    per_class = [p[c].alias(f"{prefix}_{c}") for c in detector.classes if c != NORMAL]
    return join_grown(out.select("user_id", abuse, *per_class), split.select("user_id", "is_test"), "user_id")


def feature_importance(detector: Detector, spark, rows: int = 15) -> DataFrame:
    """The most important columns; the model holds one number per column."""
    values = detector.model.stages[-1].featureImportances.toArray().tolist()
    ranked = sorted(zip(detector.columns, values), key=lambda t: (-t[1], t[0]))[:rows]
    return spark.createDataFrame(
        [(i + 1, c, float(v)) for i, (c, v) in enumerate(ranked)], "rank int, feature string, importance double"
    )


def save_detector(detector: Detector, path: str) -> None:
    detector.model.write().save(f"{path}/model")
    spark = SparkSession.active()
    names = spark.createDataFrame([(detector.columns, detector.classes)], "columns array<string>, classes array<string>")
    names.coalesce(1).write.parquet(f"{path}/names")


def load_detector(path: str) -> Detector:
    names = SparkSession.active().read.parquet(f"{path}/names").first()
    return Detector(PipelineModel.load(f"{path}/model"), list(names.columns), list(names.classes))


def fusion_signals(
    accounts: DataFrame, tabular: DataFrame, sequence: DataFrame, graph: DataFrame, rings: DataFrame, spray: DataFrame
) -> DataFrame:
    """One row per account with the eight stacked signals; accounts without events get defaults."""
    joined = join_grown(accounts.select("user_id", "label", "label_noisy", "evasion"), tabular.select("user_id", "tab_abuse", "is_test"), "user_id")
    joined = join_grown(joined, sequence.select("user_id", "seq_abuse", "seq_anomaly"), "user_id", "left")
    joined = join_grown(joined, graph.select("user_id", "graph_abuse"), "user_id")
    joined = join_grown(joined, rings.select("user_id", "ring_flag", "component_size"), "user_id")
    return (
        join_grown(joined, spray.select("user_id", "spray_events"), "user_id")
        .withColumns(
            {
                "seq_missing": F.col("seq_abuse").isNull().cast("double"),
                "seq_abuse": F.coalesce("seq_abuse", F.lit(0.5)),
                "seq_anomaly": F.coalesce("seq_anomaly", F.lit(0.0)),
                "ring_flag": F.col("ring_flag").cast("double"),
                "spray_sig": F.log1p("spray_events"),
                "comp_size": F.log1p("component_size"),
            }
        )
        .drop("spray_events", "component_size")
    )


def fit_fusion(fit: DataFrame, signals: Sequence[str] = SIGNALS) -> PipelineModel:
    """Balanced logistic stack on standardised signals; L2 strength 1 over the number of rows."""
    y = (F.col("label_noisy") != NORMAL).cast("double")
    sizes = fit.agg(F.struct(F.count("*").alias("n"), F.sum(y).alias("pos"))).scalar()
    n, pos = sizes["n"].cast("double"), sizes["pos"]
    weight = F.coalesce(F.try_divide(n, 2 * F.when(y == 1, pos).otherwise(n - pos)), F.lit(1.0))
    rows = per_core(fit.withColumns({"_y": y, "_w": weight}))  # every round of the solver sends one result a task
    stages = [
        VectorAssembler(inputCols=list(signals), outputCol="_raw"),
        StandardScaler(inputCol="_raw", outputCol="_x", withMean=True, withStd=True),
        LogisticRegression(
            featuresCol="_x", labelCol="_y", weightCol="_w", regParam=1.0 / max(fit.count(), 1), elasticNetParam=0.0,
            maxIter=200, standardization=False,
        ),
    ]
    return Pipeline(stages=stages).fit(rows)


def fused_risk(model: PipelineModel, signals: DataFrame, columns: Sequence[str] = SIGNALS) -> DataFrame:
    """Risk of every account: the fitted logistic function as one generated expression."""
    scaler, logistic = model.stages[1], model.stages[2]
    mean, std = scaler.mean.toArray().tolist(), scaler.std.toArray().tolist()
    coef = logistic.coefficients.toArray().tolist()
    margin = F.lit(float(logistic.intercept))
    for c, w, m, s in zip(columns, coef, mean, std):
        if s > 0:  # a constant signal is scaled to zero
            margin = margin + F.lit(w) * (F.col(c) - F.lit(m)) / F.lit(s)
    return signals.withColumn("risk", F.lit(1.0) / (F.lit(1.0) + F.exp(-margin)))


def fusion_weights(model: PipelineModel, spark, signals: Sequence[str] = SIGNALS) -> DataFrame:
    """Weight of each standardised signal, largest magnitude first."""
    coef = model.stages[-1].coefficients.toArray().tolist()
    rows = sorted(zip(signals, coef), key=lambda t: (-abs(t[1]), t[0]))
    return spark.createDataFrame([(i + 1, s, float(c)) for i, (s, c) in enumerate(rows)], "rank int, signal string, weight double")
