import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyward.operators import features as ft
from tallyward.operators.entropy import group_entropy
from tallyward.operators.quantile import group_quantiles
from tests.fixtures import account, accounts, event, events


@pytest.fixture(scope="module")
def table(spark):
    log = events(
        spark,
        event(1, 1, 0, tokens_used=1),
        event(2, 1, 5, tokens_used=2, ip="2.2.2.2", prompt_text="hi"),
        event(3, 1, 105, tokens_used=3, asn_type="datacenter", prompt_text="other"),
        event(4, 1, 90_000, tokens_used=10, success=False, endpoint="/v1/embeddings"),
        event(5, 2, 50),  # one event only
        event(6, 3, 7200),  # all gaps zero
        event(7, 3, 7200),
        event(8, 3, 7200),
    )
    people = accounts(spark, *[account(u) for u in (1, 2, 3, 4)])
    out = ft.account_features(log, people).toPandas().set_index("user_id")
    return out


def test_counts_and_rates(table):
    r = table.loc[1]
    assert (r.n_events, r.active_days, r.n_ips, r.n_devices, r.n_uas) == (4, 2, 2, 1, 1)
    assert r.dc_frac == 0.25 and r.success_rate == 0.75 and r.chat_frac == 0.75
    assert r.dup_prompt_frac == pytest.approx(0.5)
    assert r.mean_prompt_len == pytest.approx((2 + 2 + 5 + 2) / 4)
    assert (r.tokens_mean, r.tokens_total, r.max_events_1h) == (4.0, 16, 3)
    assert r.night_frac == 1.0  # the last event is at 01:00 of the next day
    assert r.events_per_active_day == 2.0
    assert r.account_age_days == pytest.approx(90_000 / 86400) and r.dormancy_days == 0.0


def test_gaps(table):
    r = table.loc[1]  # gaps 5, 100, 89895
    assert r.delta_mean == pytest.approx(30000.0) and r.delta_median == 100
    assert r.delta_std == pytest.approx(pd.Series([5, 100, 89895]).std())
    # ranks 1 + floor(0.1 * 2 + 0.5) = 1 and 1 + floor(0.9 * 2 + 0.5) = 3
    assert (r.delta_p10, r.delta_p90) == (5, 89895)
    assert r.frac_fast == pytest.approx(1 / 3)
    assert r.tokens_p95 == 10  # rank 1 + floor(0.95 * 3 + 0.5) = 4
    # first gap is missing and is a category of its own: four categories of one event each
    assert r.timing_entropy == pytest.approx(math.log(4))
    assert r.hour_entropy == pytest.approx(-(0.75 * math.log(0.75) + 0.25 * math.log(0.25)))


def test_single_event_account(table):
    r = table.loc[2]
    assert r.n_events == 1 and r.timing_entropy == 0.0
    assert all(pd.isna(r[c]) for c in ("delta_mean", "delta_std", "delta_median", "delta_p10", "frac_fast", "delta_cv"))


def test_zero_gaps_have_no_ratios(table):
    r = table.loc[3]
    assert r.delta_mean == 0 and r.delta_std == 0 and r.frac_fast == 1.0
    assert pd.isna(r.delta_cv) and pd.isna(r.burstiness)
    # missing bucket and bucket 0 twice
    assert r.timing_entropy == pytest.approx(-(1 / 3 * math.log(1 / 3) + 2 / 3 * math.log(2 / 3)))


def test_account_without_events(table):
    r = table.loc[4]
    assert all(r[c] == 0 for c in ft.ZERO_FILLED)
    assert pd.isna(r.dc_frac) and pd.isna(r.dormancy_days) and not pd.isna(r.account_age_days)


def test_shape(table):
    assert len(table.columns) + 1 == 44


def test_feature_columns_hold_no_label(spark, table):
    log = events(spark, event(1, 1, 0))
    cols = ft.feature_columns(ft.account_features(log, accounts(spark, account(1))))
    assert len(cols) == 30 and not set(cols) & set(ft.NON_FEATURES)


@pytest.mark.parametrize(
    "values, percent, want",
    [
        ([1, 2, 3, 10], 95, 10),
        ([1, 2, 3, 4, 5], 10, 1),
        ([1, 2, 3, 4, 5, 6, 7, 8, 9, 10], 95, 10),
        (list(range(11)), 95, 10),  # 0.95 * 10 + 0.5 = 10.0
        ([1, 2, 3, 4, 5, 6], 10, 2),  # 0.1 * 5 = 0.5, an exact half goes up
    ],
)
def test_nearest_rank(spark, values, percent, want):
    df = spark.createDataFrame([(1, v) for v in values], "user_id long, v long")
    assert group_quantiles(df, ["user_id"], "v", {"q": percent}).first().q == want


def test_entropy_keeps_null_category(spark):
    df = spark.createDataFrame([(1, None), (1, "a"), (2, None)], "user_id long, c string")
    got = {r.user_id: r.e for r in group_entropy(df, ["user_id"], "c", "e").collect()}
    assert got[1] == pytest.approx(math.log(2)) and got[2] == pytest.approx(0.0)


def skewed_log(spark):
    """One account owns a third of the rows, with repeated seconds and repeated values."""
    return spark.range(3000).select(
        F.col("id").alias("event_id"),
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 97 + 1).alias("user_id"),
        (F.lit(1_777_600_000) + F.when(F.col("id") % 9 == 0, 500).otherwise(F.col("id") * 37 % 50_000)).alias("ts"),
        F.concat(F.lit("ip"), F.col("id") % 11).alias("ip"),
        (F.col("id") % 5).alias("asn"),
        F.lit("mobile").alias("asn_type"),
        F.concat(F.lit("c"), F.col("id") % 3).alias("country"),
        F.concat(F.lit("d"), F.col("id") % 4).alias("device_fp"),
        F.lit("ua").alias("user_agent"),
        F.when(F.col("id") % 2 == 0, "/v1/chat").otherwise("/v1/embeddings").alias("endpoint"),
        F.concat(F.lit("p"), F.col("id") % 41).alias("prompt_text"),
        (F.col("id") * 7919 % 1000).alias("tokens_used"),
        (F.col("id") % 10 != 0).alias("success"),
    )


def test_quantiles_and_peaks_of_a_large_account_equal_brute_force(spark):
    log = skewed_log(spark)
    got = ft.behaviour(log).toPandas().set_index("user_id")
    rows = log.toPandas().sort_values(["user_id", "ts", "event_id"])
    for user, mine in list(rows.groupby("user_id"))[::14]:
        gaps = sorted(mine.ts.diff().dropna())
        rank = lambda v, p: v[(2 * p * (len(v) - 1) + 100) // 200]
        r = got.loc[user]
        assert (r.delta_p10, r.delta_p90, r.delta_median) == (rank(gaps, 10), rank(gaps, 90), pd.Series(gaps).median())
        assert r.tokens_p95 == rank(sorted(mine.tokens_used), 95) and r.delta_mean == pytest.approx(sum(gaps) / len(gaps))
        assert r.max_events_1h == (mine.ts // 3600).value_counts().max() and r.active_days == (mine.ts // 86400).nunique()


def test_rows_in_any_order_give_the_same_features(spark):
    log = skewed_log(spark)
    a = ft.behaviour(log).toPandas().sort_values("user_id").reset_index(drop=True)
    b = ft.behaviour(log.repartition(13, F.rand(3))).toPandas().sort_values("user_id").reset_index(drop=True)
    pd.testing.assert_frame_equal(a, b)


def test_approximate_distinct_counts_are_close(spark):
    log = skewed_log(spark)
    exact = {r.user_id: r.n_ips for r in ft.distinct_counts(log).collect()}
    close = {r.user_id: r.n_ips for r in ft.distinct_counts_approx(log).collect()}
    assert all(abs(exact[u] - close[u]) <= 1 for u in exact)


def test_sketches_of_days_merge_over_any_range(spark):
    log = skewed_log(spark).withColumn("ts", F.col("ts") + F.col("event_id") % 4 * 86400)
    kept = ft.distinct_sketches(log).persist()
    assert kept.count() == log.select("user_id", F.floor(F.col("ts") / 86400)).distinct().count()
    some = kept.filter(F.col("day") % 2 == 0)
    part = log.filter(F.floor(F.col("ts") / 86400) % 2 == 0)
    exact = {r.user_id: (r.n_ips, r.n_devices, r.p) for r in part.groupBy("user_id").agg(*[F.count_distinct(c).alias(n) for c, n in (("ip", "n_ips"), ("device_fp", "n_devices"), ("prompt_text", "p"))]).collect()}
    for r in ft.distinct_from_sketches(some).collect():
        assert all(abs(a - b) <= 1 for a, b in zip((r.n_ips, r.n_devices, r.n_prompts), exact[r.user_id]))


def test_activity_summary_counts_idle_accounts(spark):
    log = events(spark, event(1, 1, 0), event(2, 1, 5), event(3, 2, 5))
    people = accounts(spark, account(1), account(2, "spam_bot"), account(3, "spam_bot"))
    got = [tuple(r) for r in ft.activity_summary(log, people).collect()]
    assert got == [("normal", 2, 1, 1), ("spam_bot", 1, 1, 2)]
