import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyward.operators import skew
from tallyward.operators.quantile import group_quantiles
from tallyward.operators.skew import RANGE, in_ranges, join_unique, positions, previous_row, running_sum
from tests.fixtures import event, events


@pytest.fixture(autouse=True)
def many_ranges(spark):
    """Small tables too are dealt to eight ranges."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    yield
    spark.conf.set(key, "true")


def log(spark):
    """One account has most of the rows, many of them in one second; one has no id."""
    same = (F.col("id") % 4 == 0) & (F.col("id") < 1200)
    user = F.when(F.col("id") < 1200, 1).when(F.col("id") < 1500, F.lit(None)).otherwise(F.col("id") % 40 + 2)
    return spark.range(2000).select(
        user.cast("long").alias("user_id"), F.when(same, 100).otherwise(F.col("id") * 31 % 977).alias("ts"), F.col("id").alias("event_id")
    )


ORDER = ["ts", "event_id"]


def same(got, want):
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_previous_row_crosses_ranges(spark):
    r = in_ranges(log(spark), ["user_id"], ORDER)
    assert r.df.filter("user_id = 1").select(RANGE).distinct().count() > 2
    got = previous_row(r, ["event_id"]).select("event_id", F.col("_prev.event_id").alias("p"))
    w = Window.partitionBy("user_id").orderBy(*ORDER)
    same(got, log(spark).select("event_id", F.lag("event_id").over(w).alias("p")))


def test_running_sums_and_positions_cross_ranges(spark):
    r = in_ranges(log(spark), ["user_id"], ORDER)
    w = Window.partitionBy("user_id")
    upto = w.orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
    got = running_sum(r, F.col("event_id"), "upto", "total").select("event_id", "upto", "total")
    same(got, log(spark).select("event_id", F.sum("event_id").over(upto), F.sum("event_id").over(w)))
    got = positions(r, "pos", "size").select("event_id", "pos", "size")
    same(got, log(spark).select("event_id", F.row_number().over(w.orderBy(*ORDER)).cast("long") - 1, F.count("*").over(w)))


def test_ranges_ascend_and_are_even(spark):
    r = in_ranges(log(spark), ["user_id"], ORDER)
    sizes = r.df.groupBy(RANGE).agg(F.count("*").alias("n"), F.min(F.struct("user_id", *ORDER)).alias("lo"), F.max(F.struct("user_id", *ORDER)).alias("hi")).orderBy(RANGE).collect()
    assert len(sizes) == 8 and max(s.n for s in sizes) < 2 * 2000 / 8
    order = lambda x: [(v is not None, v) for v in x]
    assert all(order(a.hi) < order(b.lo) for a, b in zip(sizes, sizes[1:]))


def test_ten_thousand_hot_keys(spark):
    """Every key would be above a limit of a few rows; the plan does not ask, and only border rows are carried."""
    df = spark.range(60_000).select((F.col("id") % 10_000).alias("user_id"), (F.col("id") * 7919 % 1009).alias("ts"), F.col("id").alias("event_id"))
    r = in_ranges(df, ["user_id"], ORDER)
    w = Window.partitionBy("user_id").orderBy(*ORDER)
    got = previous_row(r, ["event_id"])
    assert got.select("event_id", F.col("_prev.event_id").alias("p")).exceptAll(df.select("event_id", F.lag("event_id").over(w))).isEmpty()
    borders = r.df.groupBy("user_id").agg(F.count_distinct(RANGE).alias("n")).filter("n > 1").count()
    assert borders <= 7


def test_nothing_is_counted_collected_or_broadcast_by_hand():
    source = open(skew.__file__).read()
    assert not any(word in source for word in (".count()", ".collect(", "broadcast(", "createDataFrame"))


def test_empty_tables(spark):
    r = in_ranges(log(spark).limit(0), ["user_id"], ORDER)
    assert previous_row(r, ["ts"]).isEmpty() and positions(r, "pos", "size").isEmpty()


def test_quantiles_of_a_large_group_equal_brute_force(spark):
    rows = [(1, random.Random(i).randrange(500)) for i in range(900)] + [(k, k) for k in range(2, 40)] + [(1, None), (99, None)]
    df = spark.createDataFrame(rows, "user_id long, v long")
    got = {r.user_id: r for r in group_quantiles(df, ["user_id"], "v", {"p10": 10, "p90": 90}, "mid").collect()}
    values = sorted(v for u, v in rows if u == 1 and v is not None)
    rank = lambda p: values[(2 * p * (len(values) - 1) + 100) // 200]
    assert (got[1].p10, got[1].p90, got[1].mid) == (rank(10), rank(90), (values[449] + values[450]) / 2)
    assert all((got[k].p10, got[k].mid) == (k, k) for k in range(2, 40)) and 99 not in got


def test_sequences_and_splits_do_not_follow_the_ranges(spark):
    from tallyward.operators import sequence as seq
    from tallyward.operators import split as sp

    rows = events(spark, *[event(i, 1 if i % 3 else i % 7, i * 37 % 900, ip=f"i{i % 4}") for i in range(300)])
    pick = ["event_id", "pos", "delta", *seq.CHANGES]
    people = spark.range(400).select(F.col("id").alias("user_id"), F.when(F.col("id") % 9 == 0, "x").otherwise("y").alias("label")).withColumn("label_noisy", F.col("label"))

    def run():
        return sorted(map(tuple, seq.event_history(rows).select(*pick).collect())), sorted(map(tuple, sp.test_halves(sp.split_assignment(people)).collect()))

    many = run()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert many == run()


def test_join_with_hot_and_null_keys(spark):
    df = log(spark).withColumn("user_id", F.when(F.col("event_id") % 3 != 0, F.col("user_id")))
    dim = log(spark).select("user_id").distinct().withColumn("name", F.concat(F.lit("n"), "user_id")).filter("user_id != 5")
    for how in ("inner", "left"):
        plain = df.join(dim, "user_id", how).select("event_id", "user_id", "name")
        got = join_unique(df, dim, "user_id", how).select("event_id", "user_id", "name")
        same(plain, got)
