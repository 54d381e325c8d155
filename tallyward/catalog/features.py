"""Account features and activity summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from tallyward.catalog import canon
from tallyward.catalog.registry import BOOL, DBL, INT, TXT, query, sql
from tallyward.operators import entropy as ent
from tallyward.operators import features as ft
from tallyward.operators import quantile, review
from tallyward.session import cut_lineage
from tallyward.sources import star

CHAT = "view"
FEATURE_TYPES = dict(
    user_id=INT, label=TXT, subtype=TXT, ring_id=TXT, username=TXT, signup_country=TXT, payment_hash=TXT,
    tz_offset=DBL, takeover_ts=INT, evasion=DBL, label_noisy=TXT, created_at=INT,
    n_events=INT, first_ts=INT, last_ts=INT, active_days=INT, n_ips=INT, n_asns=INT, n_countries=INT,
    n_devices=INT, n_uas=INT, dc_frac=DBL, night_frac=DBL, dup_prompt_frac=DBL, mean_prompt_len=DBL,
    tokens_mean=DBL, tokens_p95=DBL, tokens_total=DBL, success_rate=DBL, delta_mean=DBL, delta_median=DBL,
    delta_std=DBL, delta_p10=INT, delta_p90=INT, frac_fast=DBL, chat_frac=DBL, max_events_1h=INT,
    hour_entropy=DBL, timing_entropy=DBL, events_per_active_day=DBL, delta_cv=DBL, burstiness=DBL,
    account_age_days=DBL, dormancy_days=DBL,
)


@query("account_features", sql(canon.FEATURES, "SELECT * FROM features", **FEATURE_TYPES))
def account_features(spark, d):
    return ft.account_features(star.activity(spark, d), star.accounts(spark, d), CHAT)


@query(
    "timing_profile",
    sql(
        f"{canon.EVENTS}, {canon.DELTAS}, {canon.GAP_QUANTILES}",
        """SELECT user_id, avg(delta) AS delta_mean, stddev_samp(delta) AS delta_std,
             avg(CASE WHEN delta < 10 THEN 1.0 WHEN delta >= 10 THEN 0.0 END) AS frac_fast,
             any_value(delta_p10) AS delta_p10, any_value(delta_p90) AS delta_p90,
             any_value(delta_median) AS delta_median,
             stddev_samp(delta) / nullif(avg(delta), 0) AS delta_cv,
             (stddev_samp(delta) - avg(delta)) / nullif(stddev_samp(delta) + avg(delta), 0) AS burstiness
           FROM deltas LEFT JOIN gap_q USING (user_id) GROUP BY user_id""",
        user_id=INT, delta_mean=DBL, delta_std=DBL, frac_fast=DBL, delta_p10=INT, delta_p90=INT,
        delta_median=DBL, delta_cv=DBL, burstiness=DBL,
    ),
)
def timing_profile(spark, d):
    return ft.timing_profile(star.events(spark, d))


@query(
    "hour_entropy",
    sql(f"{canon.EVENTS}, {canon.HOUR_ENTROPY}", "SELECT * FROM hour_e", user_id=INT, hour_entropy=DBL),
)
def hour_entropy(spark, d):
    return ft.hour_entropy(star.events(spark, d))


@query(
    "timing_entropy",
    sql(
        f"{canon.EVENTS}, {canon.DELTAS}, {canon.BUCKETS}, {canon.TIMING_ENTROPY}",
        "SELECT * FROM timing_e",
        user_id=INT,
        timing_entropy=DBL,
    ),
)
def timing_entropy(spark, d):
    return ft.timing_entropy(star.events(spark, d))


@query(
    "token_quantiles",
    sql(f"{canon.EVENTS}, {canon.TOKEN_QUANTILES}", "SELECT * FROM token_q", user_id=INT, tokens_p95=DBL),
)
def token_quantiles(spark, d):
    ev = star.events(spark, d)
    return quantile.group_quantiles(ev, ["user_id"], "tokens_used", {"tokens_p95": 95})


@query("peak_hour", sql(f"{canon.EVENTS}, {canon.PEAK}", "SELECT * FROM peak", user_id=INT, max_events_1h=INT))
def peak_hour(spark, d):
    return ft.hourly_peak(star.events(spark, d))


@query(
    "hour_share",
    sql(
        canon.EVENTS,
        """SELECT user_id, (ts % 86400) // 3600 AS hour, count(*) AS n,
             sum(count(*)) OVER (PARTITION BY user_id) AS total,
             count(*) / sum(count(*)) OVER (PARTITION BY user_id) AS share FROM ev GROUP BY 1, 2""",
        user_id=INT, hour=INT, n=INT, total=INT, share=DBL,
    ),
)
def hour_share(spark, d):
    from tallyward.functions import expr

    ev = star.events(spark, d).select("user_id", expr.hour_of_day(F.col("ts")).alias("hour"))
    return ent.category_share(ev, ["user_id"], "hour")


@query(
    "distinct_counts",
    sql(
        canon.ACTIVITY,
        """SELECT user_id, count(DISTINCT ip) AS n_ips, count(DISTINCT asn) AS n_asns,
             count(DISTINCT country) AS n_countries, count(DISTINCT device_fp) AS n_devices,
             count(DISTINCT user_agent) AS n_uas, 1 - count(DISTINCT prompt_text) / count(*) AS dup_prompt_frac
           FROM activity GROUP BY 1""",
        user_id=INT, n_ips=INT, n_asns=INT, n_countries=INT, n_devices=INT, n_uas=INT, dup_prompt_frac=DBL,
    ),
)
def distinct_counts(spark, d):
    return ft.distinct_counts(star.activity(spark, d))


@query(
    "label_profile",
    sql(
        canon.FEATURES,
        """SELECT label, count(*) AS accounts, round(avg(n_events), 1) AS n_events,
             round(avg(delta_cv), 2) AS delta_cv, round(avg(dup_prompt_frac), 3) AS dup_prompt_frac,
             round(avg(n_devices), 2) AS n_devices FROM features GROUP BY 1""",
        label=TXT, accounts=INT, n_events=DBL, delta_cv=DBL, dup_prompt_frac=DBL, n_devices=DBL,
    ),
)
def label_profile(spark, d):
    return ft.label_profile(account_features(spark, d))


@query(
    "activity_summary",
    sql(
        f"{canon.EVENTS}, {canon.ACCOUNTS}",
        """SELECT label, count(event_id) AS events, count(DISTINCT ev.user_id) AS active_users,
             count(DISTINCT a.user_id) AS users FROM accounts a LEFT JOIN ev USING (user_id) GROUP BY 1""",
        label=TXT, events=INT, active_users=INT, users=INT,
    ),
)
def activity_summary(spark, d):
    return ft.activity_summary(star.events(spark, d), star.accounts(spark, d))


@query(
    "population",
    sql(canon.ACCOUNTS, "SELECT label, count(*) AS accounts FROM accounts GROUP BY 1", label=TXT, accounts=INT),
)
def population(spark, d):
    return review.population(star.accounts(spark, d))


@query(
    "distinct_sketches",
    sql(
        f"{canon.EVENTS}, days AS (SELECT user_id, ts // 86400 AS day, count(*) AS n FROM ev GROUP BY 1, 2)",
        "SELECT user_id, count(*) AS days, true AS within_bound FROM days GROUP BY 1",
        user_id=INT, days=INT, within_bound=BOOL,
    ),
)
def distinct_sketches(spark, d):
    """Sketches by account and day are written, read and merged; are all merged counts within five standard errors of the exact ones?"""
    activity = star.activity(spark, d)
    kept = cut_lineage(ft.distinct_sketches(activity), "sketches")
    names = list(ft.DISTINCT)
    merged = ft.distinct_from_sketches(kept).withColumnsRenamed({c: f"approx_{c}" for c in names})
    both = ft.distinct_counts(activity).select("user_id", *names).join(merged, "user_id")
    bound = 5 * 0.83 / 2 ** (ft.SKETCH_BITS / 2)
    near = [F.abs(F.col(f"approx_{c}") - F.col(c)) <= F.greatest(F.lit(0.5), F.col(c) * bound) for c in names]
    days = kept.groupBy("user_id").agg(F.count("*").alias("days"))
    return both.join(days, "user_id").select("user_id", "days", reduce(lambda a, b: a & b, near).alias("within_bound"))
