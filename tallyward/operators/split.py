"""One train/test split for all detectors, class weights, and the halves used by fusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyward.functions import expr
from tallyward.operators.skew import RANGE, in_ranges, running_sum


def _hash(df: DataFrame, seed: int) -> Column:
    if isinstance(df.schema["user_id"].dataType, T.IntegralType):
        return expr.arithmetic_hash(F.col("user_id"), seed)
    return F.xxhash64("user_id", F.lit(seed))


def _hash_order(df: DataFrame, strata: list[str], seed: int) -> DataFrame:
    """Rank of each account in hash order inside its stratum, and the size of the stratum.

    A stratum can be nearly all accounts, so it is ordered in ranges.
    """
    hashed = df.withColumn("_h", _hash(df, seed))
    return running_sum(in_ranges(hashed, strata, ["_h", "user_id"], "strata"), F.lit(1), "_rank", "_size").drop("_h", RANGE)


def split_assignment(accounts: DataFrame, seed: int = 0) -> DataFrame:
    """user_id, label, label_noisy, is_test: exactly round(0.3 n) test accounts of each label.

    The choice depends on ids only, never on row order, so every detector sees the same split.
    """
    ranked = _hash_order(accounts.select("user_id", "label", "label_noisy"), ["label"], seed)
    n_test = F.floor((F.col("_size") * 3 + 5) / 10)
    return ranked.select("user_id", "label", "label_noisy", (F.col("_rank") <= n_test).alias("is_test"))


def test_halves(split: DataFrame, seed: int = 7) -> DataFrame:
    """Split the test accounts in two: ``is_fit`` for fitting the fusion, ``is_eval`` for evaluation."""
    ranked = _hash_order(split, ["is_test"], seed)
    first = F.col("_rank") <= F.floor(F.col("_size") / 2)
    return ranked.select(
        "user_id", "label", "label_noisy", "is_test", (F.col("is_test") & first).alias("is_fit"),
        (F.col("is_test") & ~first).alias("is_eval"),
    )


def class_weights(split: DataFrame, label: str = "label_noisy") -> DataFrame:
    """n / (classes * frequency) of each label over the training accounts; one row per label."""
    freq = split.filter(~F.col("is_test")).groupBy(label).agg(F.count("*").alias("n"))
    whole = freq.agg(F.struct(F.sum("n").alias("n"), F.count("*").alias("k"))).scalar()
    return freq.withColumn("weight", expr.ratio(whole["n"], whole["k"] * F.col("n")))
