"""Ranking and flag metrics over labelled documents with a score."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyward.catalog import canon
from tallyward.catalog.registry import DBL, INT, TXT, query, sql
from tallyward.operators import evaluate as ev
from tallyward.sources import star

AP = dict(support=INT, accounts=INT, ap=DBL)


def scored(spark, d):
    return star.scored_documents(spark, d)


def truth():
    return F.col("truth") == 1


@query(
    "average_precision",
    sql(f"{canon.SCORED}, {canon.ap('ap_all', 'scored', 'score', 'truth')}", "SELECT * FROM ap_all", **AP),
)
def average_precision(spark, d):
    return ev.average_precision(scored(spark, d), "score", truth())


@query(
    "precision_curve",
    sql(
        f"{canon.SCORED}, {canon.ap('ap_all', 'scored', 'score', 'truth')}",
        "SELECT s AS score, pos, n, tp, seen, positives, everyone AS rows, tp / seen AS precision FROM ap_all_r",
        score=DBL, pos=INT, n=INT, tp=INT, seen=INT, positives=INT, rows=INT, precision=DBL,
    ),
)
def precision_curve(spark, d):
    return ev.precision_curve(ev.score_counts(scored(spark, d), "score", truth()))


CLASSES = ["de", "en", "es", "fr"]


@query(
    "per_class_ap",
    sql(
        f"{canon.SCORED}, classes AS (SELECT DISTINCT lang AS class FROM documents), "
        "per AS (SELECT c.class, lang = c.class AS t, "
        "(score + CASE WHEN (user_id * 13 + ascii(substr(c.class, 2, 1))) % 3 = 0 THEN 0.5 ELSE 0 END) / 2 AS s0 "
        f"FROM scored, classes c), {canon.ap('ap_k', 'per', 's0', 't', 'class')}",
        "SELECT * FROM ap_k",
        **{"class": TXT}, **AP,
    ),
)
def per_class_ap(spark, d):
    s = scored(spark, d)
    bump = lambda c: F.when((F.col("user_id") * 13 + ord(c[1])) % 3 == 0, 0.5).otherwise(0.0)
    s = s.withColumns({f"p_{c}": (F.col("score") + bump(c)) / 2 for c in CLASSES})
    return ev.per_class_ap(s, {c: f"p_{c}" for c in CLASSES}, "lang")


@query(
    "roc_auc",
    sql(
        canon.SCORED,
        """SELECT any_value(np) AS positives, any_value(nn) AS negatives,
             sum(CASE WHEN p.s > n.s THEN 1.0 WHEN p.s = n.s THEN 0.5 ELSE 0 END) / count(*) AS auc
           FROM (SELECT score AS s, count(*) OVER () AS np FROM scored WHERE truth = 1) p,
                (SELECT score AS s, count(*) OVER () AS nn FROM scored WHERE truth = 0) n""",
        positives=INT, negatives=INT, auc=DBL,
    ),
)
def roc_auc(spark, d):
    return ev.roc_auc(scored(spark, d), "score", truth())


@query(
    "precision_at_k",
    sql(
        f"{canon.SCORED}, top AS (SELECT truth, row_number() OVER (ORDER BY score DESC, user_id) AS r FROM scored), "
        "ks AS (SELECT unnest([10, 100, 500, 1000]) AS k)",
        """SELECT k, (SELECT avg(truth) FROM top WHERE r <= k) AS precision,
             least(1.0, (SELECT sum(truth) FROM scored) / k) AS achievable
           FROM ks WHERE k <= (SELECT count(*) FROM scored)""",
        k=INT, precision=DBL, achievable=DBL,
    ),
)
def precision_at_k(spark, d):
    return ev.precision_at_k(scored(spark, d), "score", truth(), [10, *ev.KS])


@query(
    "ap_by_slice",
    sql(
        f"""{canon.SCORED}, levels AS (SELECT * FROM (VALUES ('0.00-0.33', 0.0, 0.33), ('0.33-0.66', 0.33, 0.66),
          ('0.66-1.01', 0.66, 1.01)) v(slice, lo, hi)),
        pooled AS (SELECT slice, score, truth FROM scored, levels WHERE truth = 0 OR (evasion >= lo AND evasion < hi)),
        {canon.ap('ap_s', 'pooled', 'score', 'truth', 'slice')}""",
        "SELECT slice, support, ap FROM ap_s WHERE support >= 5",
        slice=TXT, support=INT, ap=DBL,
    ),
)
def ap_by_slice(spark, d):
    return ev.ap_by_slice(scored(spark, d), "score", truth())


@query(
    "flag_precision_recall",
    sql(
        canon.SCORED,
        """SELECT tp, flagged, targets, tp / greatest(flagged, 1) AS precision, tp / greatest(targets, 1) AS recall FROM (
             SELECT count(*) FILTER (score >= 0.5 AND toxic = 1) AS tp, count(*) FILTER (score >= 0.5) AS flagged,
               count(*) FILTER (toxic = 1) AS targets FROM scored)""",
        tp=INT, flagged=INT, targets=INT, precision=DBL, recall=DBL,
    ),
)
def flag_precision_recall(spark, d):
    flagged = scored(spark, d).withColumn("flag", F.col("score") >= 0.5)
    return ev.flag_quality(flagged, "flag", F.col("toxic") == 1)


@query(
    "base_rate",
    sql(
        canon.SCORED, "SELECT count(*) AS accounts, avg(truth) AS base_rate FROM scored",
        accounts=INT, base_rate=DBL,
    ),
)
def base_rate(spark, d):
    return ev.base_rate(scored(spark, d), truth())


@query(
    "detector_comparison",
    sql(
        f"""{canon.SCORED}, long AS (
          SELECT 'evasion' AS detector, evasion AS s0, truth FROM scored
          UNION ALL SELECT 'score', score, truth FROM scored
          UNION ALL SELECT 'mixed', (score + evasion) / 2, truth FROM scored),
        {canon.ap('ap_d', 'long', 's0', 'truth', 'detector')}""",
        "SELECT * FROM ap_d",
        detector=TXT, **AP,
    ),
)
def detector_comparison(spark, d):
    s = scored(spark, d).withColumn("mixed", (F.col("score") + F.col("evasion")) / 2)
    return ev.detector_comparison(s, ["evasion", "score", "mixed"], truth())
