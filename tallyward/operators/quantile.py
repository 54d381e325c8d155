"""Exact nearest-rank quantiles and linear medians per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyward.functions import expr
from tallyward.operators.skew import in_ranges, running_sum


def group_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    percents: dict[str, int],
    median: str | None = None,
    linear: dict[str, float] | None = None,
) -> DataFrame:
    """One row per group with the nearest-rank value for each ``{column: percent}``, and the linearly
    interpolated one for each ``{column: fraction}`` of ``linear``.

    Equal values are merged before anything is ordered, so a value shared by most of a group is one
    row, and groups of any size are ordered in ranges.
    """
    hist = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_w"))
    cum = running_sum(in_ranges(hist, keys, [value], "values"), F.col("_w"), "_upto", "_n")
    below = F.col("_upto") - F.col("_w")

    def at(rank):
        return F.max(F.when((below < rank) & (rank <= F.col("_upto")), F.col(value)))

    out = {name: at(expr.nearest_rank(F.col("_n"), p)).alias(name) for name, p in percents.items()}
    aggs = list(out.values())
    if median:
        half = F.floor((F.col("_n") + 1) / 2)
        upper = F.floor(F.col("_n") / 2) + 1
        aggs.append(((at(half) + at(upper)) / 2.0).alias(median))
    for name, fraction in (linear or {}).items():
        place = (F.col("_n") - 1) * F.lit(fraction)
        low, high = at(F.floor(place) + 1), at(F.ceil(place) + 1)
        aggs.append((low + (high - low) * F.max(place - F.floor(place))).alias(name))
    return cum.groupBy(*keys).agg(*aggs)
