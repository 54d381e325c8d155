import math

import pytest
from pyspark.sql import functions as F

from tallyward.operators import sequence as seq
from tests.fixtures import DAY0, account, accounts, event, events


def test_first_event_and_change_flags(spark):
    log = events(
        spark,
        event(2, 1, 10, ip="b", country="DE"),
        event(1, 1, 10, ip="a"),  # same second: event_id decides
        event(3, 1, 70, ip="b", device_fp="fp_b", country="DE"),
    )
    got = [(r.event_id, r.delta, r.ip_chg, r.dev_chg, r.cc_chg) for r in seq.event_deltas(log).orderBy("event_id").collect()]
    assert got == [(1, 0, 0.0, 0.0, 0.0), (2, 0, 1.0, 0.0, 1.0), (3, 60, 0.0, 1.0, 0.0)]


def test_tail_keeps_the_gap_from_before_the_cut(spark):
    log = events(spark, *[event(i, 1, i * i) for i in range(10)], event(100, 2, 5))
    got = [(r.user_id, r.pos, r.event_id, r.delta) for r in seq.event_tail(log, 3).orderBy("user_id", "pos").collect()]
    assert got == [(1, 0, 7, 13), (1, 1, 8, 15), (1, 2, 9, 17), (2, 0, 100, 0)]


@pytest.mark.parametrize("branches", [1, 3, 16])
def test_tail_of_a_busy_account_equals_the_end_of_its_history(spark, branches):
    log = events(spark, *[event(i, 1, i * 7919 % 400) for i in range(600)], *[event(1000 + i, 2, i) for i in range(3)])
    got = seq.event_tail(log.repartition(8), 50, branches).select("user_id", "event_id", "delta", *seq.CHANGES)
    pos = seq.event_history(log)
    want = pos.filter("user_id = 2 or pos >= 550").select("user_id", "event_id", "delta", *seq.CHANGES)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_tail_is_limited_before_the_shuffle(spark):
    plan = seq.event_tail(events(spark, event(1, 1, 0)), 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 4 and plan.count("Exchange") == 2  # map task, branch, account


def test_encoding(spark):
    log = events(spark, event(1, 1, 6 * 3600, tokens_used=99), event(2, 1, 6 * 3600 + 999, success=False))
    enc = seq.event_encoding(seq.event_history(log.withColumn("content", F.lit(3)))).orderBy("pos").collect()
    assert enc[0].hour_sin == pytest.approx(1.0) and enc[0].hour_cos == pytest.approx(0.0)
    assert enc[0].tokens_log == pytest.approx(math.log(100) / 10)
    assert (enc[0].gap, enc[1].gap, enc[1].delta, enc[1].success) == (0, 2, 999, 0.0)
    assert enc[1].delta_log == pytest.approx(math.log(1000) / 14)
    assert (enc[0].asn_idx, enc[0].endpoint_idx, enc[0].content) == (0, 0, 3)


def test_content_bucket_is_crc32(spark):
    assert spark.range(1).select(seq.content_bucket(F.lit("abc"))).first()[0] == 891568578 % 32


def steps_of(spark, rows):
    return spark.createDataFrame(rows, "user_id long, pos int, ts long, gap int, content int, next_gap int, next_content int")


def test_model_and_surprise_by_hand(spark):
    steps = steps_of(spark, [(1, 0, 0, 1, 2, 1, 2), (1, 1, 1, 1, 2, 3, 2), (2, 0, 0, 1, 2, 5, 9), (3, 0, 0, 7, 7, 0, 0)])
    normals = spark.createDataFrame([(1,)], "user_id long")
    model = seq.transition_model(steps, normals)
    p = {(r.head, r.next): (r.n, r.total, r.p) for r in seq.transition_table(model).collect()}
    assert p == {
        ("gap", 1): (1, 2, pytest.approx(2 / 10)),
        ("gap", 3): (1, 2, pytest.approx(2 / 10)),
        ("content", 2): (2, 2, pytest.approx(3 / 34)),
    }
    s = {(r.user_id, r.pos): r.surprise for r in seq.event_surprise(steps, model).collect()}
    assert s[(1, 0)] == pytest.approx(-math.log(0.2) - math.log(3 / 34))
    assert s[(2, 0)] == pytest.approx(math.log(10) + math.log(34))  # both transitions unseen
    assert s[(3, 0)] == pytest.approx(math.log(8) + math.log(32))  # state unseen


@pytest.mark.parametrize("n, scored", [(31, False), (32, True)])
def test_spike_needs_two_windows(spark, n, scored):
    # constant 1.0 with a block of 9.0 on positions 10..13
    rows = [(1, i, DAY0 + 60 * i, 9.0 if 10 <= i < 14 else 1.0) for i in range(n)]
    df = spark.createDataFrame(rows, "user_id long, pos int, ts long, surprise double")
    r = seq.surprise_spike(df).first()
    if not scored:
        assert (r.transitions, r.spike_score, r.spike_ts) == (n, 0.0, 0)
        return
    means = [sum(9.0 if 10 <= j < 14 else 1.0 for j in range(i, i + 16)) / 16 for i in range(n - 15)]
    mid = sorted(means)[len(means) // 2]
    assert r.spike_score == pytest.approx(max(means) - mid)
    assert r.spike_ts == DAY0 + 60 * (means.index(max(means)) + 9)


def test_localisation(spark):
    people = accounts(spark, account(1, "token_thief", takeover_ts=DAY0), account(2, "token_thief", takeover_ts=DAY0))
    spikes = spark.createDataFrame([(1, 40, 1.0, DAY0 + 7200), (2, 31, 0.0, 0)], "user_id long, transitions long, spike_score double, spike_ts long")
    assert tuple(seq.localisation_error(people, spikes).first()) == (1, 2.0)


def test_pooled_sequence(spark):
    log = events(spark, event(1, 1, 0), event(2, 1, 5, success=False), event(3, 1, 500))
    r = seq.pooled_sequence(seq.event_encoding(seq.event_history(log.withColumn("content", F.lit(0))))).first()
    assert r.length == 3 and r.mean_success == pytest.approx(2 / 3) and r.last_success == 1.0
    assert r.share_gap_0 == pytest.approx(2 / 3) and r.share_gap_2 == pytest.approx(1 / 3)
    assert r.move_0_0 == pytest.approx(1 / 3) and r.move_0_2 == pytest.approx(1 / 3)


def test_whole_history_in_pieces(spark):
    """2,000 events of one account: pieces of any size give the same."""
    log = events(spark, *[event(i, 1, i * (i % 13 + 1), tokens_used=i) for i in range(2000)], event(5000, 2, 5))
    log = log.withColumn("content", F.pmod(F.hash("event_id"), F.lit(8)))
    whole = seq.event_history(log)
    assert whole.filter("user_id = 1").agg(F.count("*"), F.min("pos"), F.max("pos")).first() == (2000, 0, 1999)
    enc = seq.event_encoding(whole).persist()
    steps = [sorted(map(tuple, seq.transitions(enc, piece).collect())) for piece in (7, 4096)]
    assert steps[0] == steps[1] and len(steps[0]) == 1999
    surprise = enc.select("user_id", "pos", "ts", (F.abs(F.hash("event_id")) % 97 / 10.0).alias("surprise"))
    spikes = [sorted(map(tuple, seq.surprise_spike(surprise, piece=piece).collect())) for piece in (20, 4096)]
    assert [r[:2] + r[3:] for r in spikes[0]] == [r[:2] + r[3:] for r in spikes[1]]
    assert [r[2] for r in spikes[0]] == pytest.approx([r[2] for r in spikes[1]])
    pooled = [sorted(map(tuple, seq.pooled_sequence(enc, piece=piece).collect())) for piece in (9, 4096)]
    assert all(a == pytest.approx(b) for a, b in zip(*pooled))


def test_shares_of_an_account_sum_to_one(spark):
    kinds = ["click", "error", "purchase", "signup", "view"]
    log = events(spark, *[event(i, 1, i, endpoint=kinds[i % 5]) for i in range(11)]).withColumn("content", F.lit(0))
    r = seq.pooled_sequence(seq.event_encoding(seq.event_history(log), kinds), kinds).first().asDict()
    for block in ("asn_idx", "endpoint_idx", "gap"):
        assert sum(v for k, v in r.items() if k.startswith(f"share_{block}")) == pytest.approx(1)
    assert r["share_endpoint_idx_4"] == pytest.approx(2 / 11)
