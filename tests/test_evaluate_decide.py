import math

import pytest
from pyspark.sql import functions as F

from tallyward.operators import decide, review
from tallyward.operators import evaluate as ev
from tallyward.operators import split as sp
from tests.fixtures import account, accounts, event, events

def bad():
    return F.col("truth") == 1


def scored(spark, rows):
    return spark.createDataFrame([(i, float(s), t, *x) for i, (s, t, *x) in enumerate(rows)], "user_id long, score double, truth int" + (", evasion double" if len(rows[0]) > 2 else ""))


def test_average_precision_with_ties(spark):
    # scores 3 (1 of 1), 2 (1 of 3), 1 (1 of 2): steps 1/3*1 + 1/3*2/4 + 1/3*3/6
    df = scored(spark, [(3, 1), (2, 1), (2, 0), (2, 0), (1, 1), (1, 0)])
    r = ev.average_precision(df, "score", bad()).first()
    assert r.support == 3 and r.ap == pytest.approx((1 + 0.5 + 0.5) / 3)


def test_scores_are_compared_exactly(spark):
    """Scores that differ at the ninth digit are not ties, over many ranges of scores."""
    rows = [(0.999999 + i * 1e-9, int(i % 3 == 0)) for i in range(300)]
    df = scored(spark, rows).repartition(7)
    curve = ev.precision_curve(ev.score_counts(df, "score", bad())).orderBy(F.desc("score")).collect()
    tp = 0
    for i, (r, (s, t)) in enumerate(zip(curve, rows[::-1])):
        tp += t
        assert (r.score, r.tp, r.seen, r.positives, r.rows) == (s, tp, i + 1, 100, 300)
    won = sum(a > b for a, t in rows if t for b, u in rows if not u)
    assert ev.roc_auc(df, "score", bad()).first().auc == pytest.approx(won / (100 * 200))


def test_curve_with_a_null_key(spark):
    df = scored(spark, [(3, 1), (2, 0), (1, 1)]).withColumn("k", F.when(F.col("user_id") < 2, "a"))
    got = {r.k: (r.support, r.ap) for r in ev.average_precision(df, "score", bad(), ["k"]).collect()}
    assert got == {"a": (1, 1.0), None: (1, 1.0)}


def test_auc_counts_ties_as_half(spark):
    df = scored(spark, [(2, 1), (1, 1), (1, 0), (0, 0)])
    assert ev.roc_auc(df, "score", bad()).first().auc == pytest.approx((2 + 1.5) / 4)


def test_precision_at_k_skips_k_above_n(spark):
    df = scored(spark, [(9, 1), (8, 0), (7, 1), (6, 0)])
    got = [tuple(r) for r in ev.precision_at_k(df, "score", bad(), [1, 3, 4, 5]).collect()]
    assert got == [(1, 1.0, 1.0), (3, pytest.approx(2 / 3), pytest.approx(2 / 3)), (4, 0.5, 0.5)]


def test_slices_are_half_open_and_small_ones_are_skipped(spark):
    rows = [(9 - i, 1, 0.33) for i in range(5)] + [(2, 1, 0.66)] * 4 + [(1, 1, 1.0)] + [(0.5, 0, 0.0)] * 3 + [(8, 1, 0.1)] * 4
    got = {r.slice: (r.support, r.ap) for r in ev.ap_by_slice(scored(spark, rows), "score", bad()).collect()}
    assert got == {"0.33-0.66": (5, pytest.approx(1.0)), "0.66-1.01": (5, pytest.approx(1.0))}


def test_flag_quality_of_nothing_flagged(spark):
    df = scored(spark, [(1, 0), (1, 0)]).withColumn("flag", F.lit(False))
    assert tuple(ev.flag_quality(df, "flag", bad()).first()) == (0, 0, 0, 0.0, 0.0)


def thresholds(spark, rows, targets):
    return tuple(decide.precision_thresholds(scored(spark, rows), "score", bad(), targets).first())


def test_thresholds_respect_ties_and_order(spark):
    rows = [(0.9, 1), (0.8, 1), (0.8, 0), (0.5, 1), (0.1, 0)]
    t = {"suspend": 0.99, "challenge": 0.7, "rate_limit": 0.6}
    # precision by score: 0.9 -> 1, 0.8 -> 2/3, 0.5 -> 3/4, 0.1 -> 3/5
    assert thresholds(spark, rows, t) == (0.9, 0.5, 0.1)


def test_unreachable_target_is_infinite_and_does_not_lift_the_others(spark):
    rows = [(0.9, 0), (0.8, 1), (0.7, 1)]
    t = {"suspend": 0.99, "challenge": 0.9, "rate_limit": 0.6}
    assert thresholds(spark, rows, t) == (math.inf, math.inf, 0.7)
    # a stricter tier reaching lower pulls the looser tiers down
    assert thresholds(spark, rows, {"suspend": 0.6, "challenge": 0.99, "rate_limit": 0.99}) == (0.7, 0.7, 0.7)


def test_tiers_table_and_cost(spark):
    rows = [(1, "normal", 0.95), (2, "token_thief", 0.9), (3, "spam_bot", 0.6), (4, "normal", 0.2), (5, "account_farmer", 0.1)]
    df = spark.createDataFrame(rows, "user_id long, label string, risk double")
    limits = spark.createDataFrame([(0.9, 0.5, 0.5)], "suspend double, challenge double, rate_limit double")
    done = decide.tier_assignment(df, "risk", limits)
    assert {r.user_id: r.tier for r in done.collect()} == {1: "suspend", 2: "suspend", 3: "challenge", 4: "monitor", 5: "monitor"}
    assert [tuple(r) for r in decide.tier_table(done).collect()] == [
        ("suspend", 2, 1, 0.5), ("challenge", 1, 1, 1.0), ("rate_limit", 0, 0, 0.0), ("monitor", 2, 1, 0.5),
    ]
    cost = decide.expected_cost(done).first()
    # 100 for the suspended normal, 0 for the thief, 10 * 0.2 for the bot, 20 for the farmer
    assert cost.expected_cost == pytest.approx(122.0) and cost.do_nothing == 230.0
    assert cost.reduction_pct == pytest.approx((1 - 122 / 230) * 100)


def people(spark, n=200):
    return accounts(spark, *[account(i, "normal" if i % 4 else "spam_bot", label_noisy="normal" if i % 8 else "spam_bot") for i in range(n)])


def test_split_is_exact_and_free_of_row_order(spark):
    df = people(spark)
    a = sp.split_assignment(df)
    sizes = {(r.label, r.is_test): r.n for r in a.groupBy("label", "is_test").agg(F.count("*").alias("n")).collect()}
    assert sizes == {("normal", True): 45, ("normal", False): 105, ("spam_bot", True): 15, ("spam_bot", False): 35}
    want = sorted(map(tuple, a.collect()))
    assert sorted(map(tuple, sp.split_assignment(df.orderBy(F.desc("user_id")).repartition(5)).collect())) == want
    assert sorted(map(tuple, sp.split_assignment(df).collect())) == want
    strings = df.withColumn("user_id", F.format_string("u%06d", "user_id"))
    assert sp.split_assignment(strings).filter("is_test").count() == 60


def test_halves(spark):
    halves = sp.test_halves(sp.split_assignment(people(spark)))
    r = halves.agg(F.sum(F.col("is_fit").cast("int")), F.sum(F.col("is_eval").cast("int")), F.sum((F.col("is_fit") & F.col("is_eval")).cast("int"))).first()
    assert tuple(r) == (30, 30, 0)
    assert halves.filter("(is_fit or is_eval) and not is_test").isEmpty()


def test_class_weights(spark):
    df = spark.createDataFrame([(1, "a", False), (2, "a", False), (3, "a", False), (4, "b", False), (5, "b", True)], "user_id long, label_noisy string, is_test boolean")
    got = {r.label_noisy: r.weight for r in sp.class_weights(df).collect()}
    assert got == {"a": pytest.approx(4 / 6), "b": pytest.approx(2.0)}


def test_queue_timeline_and_candidates(spark):
    ppl = accounts(spark, account(1), account(2), account(3, "token_thief", takeover_ts=5))
    dec = spark.createDataFrame([(1, "normal", 0.0, 0.5, "suspend"), (2, "normal", 0.0, 0.9, "suspend"), (3, "token_thief", 0.1, 1.0, "monitor")], "user_id long, label string, evasion double, risk double, tier string")
    assert [r.user_id for r in review.enforcement_queue(dec, ppl, "suspend").collect()] == [2, 1]
    assert [r.user_id for r in review.enforcement_queue(dec, ppl, "suspend", rows=1).collect()] == [2]
    log = events(spark, event(1, 1, 10), event(2, 1, 20, device_fp="x"), event(3, 1, 4000), event(4, 2, 1))
    assert [(r.events, r.devices) for r in review.account_timeline(log, 1).collect()] == [(2, 2), (1, 1)]
    assert tuple(review.account_diversity(log, 1).first()) == (1, 3, 2, 1)
    spikes = spark.createDataFrame([(3, 40, 2.0, 100), (1, 40, 3.0, 50)], "user_id long, transitions long, spike_score double, spike_ts long")
    assert [r.user_id for r in review.takeover_candidates(ppl, spikes, 1).collect()] == [3]


def test_risk_box(spark):
    rows = [("a", v / 100, True) for v in (10, 20, 30, 40, 99)] + [("a", 0.5, False)]
    r = review.risk_quartiles(spark.createDataFrame(rows, "label string, risk double, is_eval boolean")).first()
    assert tuple(r) == ("a", 5, 0.2, 0.3, 0.4, 0.1, 0.4)  # 0.99 is beyond the upper fence
