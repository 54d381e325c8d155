"""Split, thresholds, tiers, cost, and review queries over accounts with a fixed risk formula."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyward.catalog import canon
from tallyward.catalog.registry import BOOL, DBL, INT, TXT, query, sql
from tallyward.operators import decide, evaluate, review
from tallyward.operators import split as sp
from tallyward.session import cut_lineage, new_folder
from tallyward.sources import star, tables

BUSY_ACCOUNT = 7


def split(spark, d):
    return sp.split_assignment(star.accounts(spark, d))


SPLIT_TYPES = dict(user_id=INT, label=TXT, label_noisy=TXT, is_test=BOOL)


@query("split_assignment", sql(f"{canon.ACCOUNTS}, {canon.SPLIT}", "SELECT * FROM split", **SPLIT_TYPES))
def split_assignment(spark, d):
    return split(spark, d)


@query(
    "test_halves",
    sql(
        f"{canon.ACCOUNTS}, {canon.SPLIT}, {canon.HALVES}", "SELECT * FROM halves",
        **SPLIT_TYPES, is_fit=BOOL, is_eval=BOOL,
    ),
)
def test_halves(spark, d):
    return sp.test_halves(split(spark, d))


@query(
    "class_weights",
    sql(
        f"{canon.ACCOUNTS}, {canon.SPLIT}",
        """SELECT label_noisy, count(*) AS n, sum(count(*)) OVER () / (count(*) OVER () * count(*)) AS weight
           FROM split WHERE NOT is_test GROUP BY 1""",
        label_noisy=TXT, n=INT, weight=DBL,
    ),
)
def class_weights(spark, d):
    return sp.class_weights(split(spark, d))


def risks(spark, d):
    halves = test_halves(spark, d).drop("label", "label_noisy")
    return star.risk_scores(spark, d).join(halves, "user_id")


def thresholds(spark, d, scored=None):
    fit = (scored or risks(spark, d)).filter("is_fit")
    return decide.precision_thresholds(fit, "risk", F.col("label_noisy") != "normal")


@query(
    "precision_thresholds",
    sql(canon.THRESHOLDS, "SELECT * FROM thr", suspend=DBL, challenge=DBL, rate_limit=DBL),
)
def precision_thresholds(spark, d):
    return thresholds(spark, d)


def tiered(spark, d):
    scored = cut_lineage(risks(spark, d), "risks")
    return decide.tier_assignment(scored, "risk", thresholds(spark, d, scored))


@query(
    "tier_assignment",
    sql(canon.TIERS, "SELECT user_id, risk, tier FROM tiered", user_id=INT, risk=DBL, tier=TXT),
)
def tier_assignment(spark, d):
    return tiered(spark, d).select("user_id", "risk", "tier")


@query(
    "decision_table",
    sql(
        canon.TIERS,
        "SELECT user_id, label, evasion, cast(risk AS float) AS risk, tier, is_eval FROM tiered",
        user_id=INT, label=TXT, evasion=DBL, risk=DBL, tier=TXT, is_eval=BOOL,
    ),
)
def decision_table(spark, d):
    return decide.decision_table(tiered(spark, d))


NAMES = "names AS (SELECT unnest(['suspend', 'challenge', 'rate_limit', 'monitor']) AS tier)"


@query(
    "tier_table",
    sql(
        f"{canon.TIERS}, {NAMES}",
        """SELECT tier, count(user_id) AS n, count(user_id) FILTER (label <> 'normal') AS abusive,
             count(user_id) FILTER (label <> 'normal') / greatest(count(user_id), 1) AS precision
           FROM names LEFT JOIN (SELECT * FROM tiered WHERE is_eval) t USING (tier) GROUP BY 1""",
        tier=TXT, n=INT, abusive=INT, precision=DBL,
    ),
)
def tier_table(spark, d):
    return decide.tier_table(tiered(spark, d).filter("is_eval"))


@query(
    "expected_cost",
    sql(
        f"""{canon.TIERS}, priced AS (
          SELECT label, CASE tier WHEN 'suspend' THEN 100.0 WHEN 'challenge' THEN 5.0 WHEN 'rate_limit' THEN 1.0 ELSE 0.0 END AS fp,
            CASE tier WHEN 'suspend' THEN 1.0 WHEN 'challenge' THEN 0.8 WHEN 'rate_limit' THEN 0.4 ELSE 0.0 END AS effect,
            CASE label WHEN 'spam_bot' THEN 10.0 WHEN 'account_farmer' THEN 20.0 WHEN 'prompt_sprayer' THEN 15.0
              WHEN 'token_thief' THEN 200.0 ELSE 0.0 END AS miss
          FROM tiered WHERE is_eval)""",
        """SELECT *, (1 - expected_cost / nullif(do_nothing, 0)) * 100 AS reduction_pct FROM (
             SELECT sum(CASE WHEN label = 'normal' THEN fp ELSE miss * (1 - effect) END) AS expected_cost,
               sum(miss) AS do_nothing FROM priced)""",
        expected_cost=DBL, do_nothing=DBL, reduction_pct=DBL,
    ),
)
def expected_cost(spark, d):
    return decide.expected_cost(tiered(spark, d).filter("is_eval"))


@query(
    "enforcement_queue",
    sql(
        canon.TIERS,
        """SELECT user_id, username, risk, label, subtype, ring_id, evasion FROM tiered WHERE tier = 'challenge'
           ORDER BY risk DESC, user_id LIMIT 300""",
        user_id=INT, username=TXT, risk=DBL, label=TXT, subtype=TXT, ring_id=TXT, evasion=DBL,
    ),
)
def enforcement_queue(spark, d):
    decided = tiered(spark, d).select("user_id", "risk", "label", "evasion", "tier")
    return review.enforcement_queue(decided, star.accounts(spark, d), "challenge")


@query(
    "risk_quartiles",
    sql(
        f"""{canon.TIERS}, box AS (
          SELECT label, count(*) AS accounts, quantile_cont(risk, 0.25) AS q1, median(risk) AS med,
            quantile_cont(risk, 0.75) AS q3 FROM tiered WHERE is_eval GROUP BY 1)""",
        """SELECT label, accounts, q1, med AS median, q3,
             min(risk) FILTER (risk BETWEEN q1 - (q3 - q1) * 1.5 AND q3 + (q3 - q1) * 1.5) AS whisker_low,
             max(risk) FILTER (risk BETWEEN q1 - (q3 - q1) * 1.5 AND q3 + (q3 - q1) * 1.5) AS whisker_high
           FROM tiered JOIN box USING (label) WHERE is_eval GROUP BY label, accounts, q1, med, q3""",
        label=TXT, accounts=INT, q1=DBL, median=DBL, q3=DBL, whisker_low=DBL, whisker_high=DBL,
    ),
)
def risk_quartiles(spark, d):
    return review.risk_quartiles(tiered(spark, d))


@query(
    "account_timeline",
    sql(
        canon.EVENTS,
        f"""SELECT ts // 3600 * 3600 AS hour, count(*) AS events, count(DISTINCT device_fp) AS devices,
              count(DISTINCT country) AS countries, make_timestamp(ts // 3600 * 3600 * 1000000) AS t
            FROM ev WHERE user_id = {BUSY_ACCOUNT} GROUP BY ts // 3600""",
        hour=INT, events=INT, devices=INT, countries=INT, t="timestamp",
    ),
)
def account_timeline(spark, d):
    return review.account_timeline(star.events(spark, d), BUSY_ACCOUNT)


@query(
    "account_diversity",
    sql(
        canon.EVENTS,
        f"""SELECT user_id, count(*) AS events, count(DISTINCT device_fp) AS devices, count(DISTINCT country) AS countries
            FROM ev WHERE user_id = {BUSY_ACCOUNT} GROUP BY 1""",
        user_id=INT, events=INT, devices=INT, countries=INT,
    ),
)
def account_diversity(spark, d):
    return review.account_diversity(star.events(spark, d), BUSY_ACCOUNT)


@query(
    "metric_report",
    sql(
        f"""{canon.TIERS}, {canon.ap('fused', "(SELECT risk, label <> 'normal' AS t FROM tiered WHERE is_eval)", 'risk', 't')},
        per_tier AS (SELECT tier, count(*) AS n FROM tiered WHERE is_eval GROUP BY 1)""",
        """SELECT 'fusion' AS stage, 'abuse_pr_auc' AS metric, 'fused' AS key, ap AS value FROM fused
           UNION ALL SELECT 'fusion', 'tier_accounts', tier, n FROM per_tier
           UNION ALL SELECT 'population', 'accounts', label, count(*) FROM accounts GROUP BY label""",
        stage=TXT, metric=TXT, key=TXT, value=DBL,
    ),
)
def metric_report(spark, d):
    """Metrics of two stages, written as JSON by stage and read back; a third stage did not run."""
    ev = tiered(spark, d).filter("is_eval")
    ap = evaluate.average_precision(ev, "risk", F.col("label") != "normal").withColumn("name", F.lit("fused"))
    rows = [
        tables.metric_rows(ap, "fusion", "abuse_pr_auc", "name", "ap"),
        tables.metric_rows(ev.groupBy("tier").agg(F.count("*").alias("n")), "fusion", "tier_accounts", "tier", "n"),
        tables.metric_rows(review.population(star.accounts(spark, d)), "population", "accounts", "label", "accounts"),
    ]
    folder = new_folder(spark, "metrics")
    tables.write_metrics(evaluate.union_all(rows), folder)
    return tables.read_metrics(spark, folder)
