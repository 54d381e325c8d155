"""Shannon entropy of a categorical column per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyward.functions import expr


def group_entropy(df: DataFrame, keys: Sequence[str], category: str, out: str) -> DataFrame:
    """Natural-log entropy; a NULL category counts as one of the categories.

    Two aggregations, both combined before their shuffle. With c rows in a category and n in the
    group, -sum(p ln p) = ln n - sum(c ln c) / n, so no join with group totals is needed.
    """
    counts = df.groupBy(*keys, category).agg(F.count("*").alias("_c"))
    n = F.sum("_c")
    weighted = F.sum(F.col("_c") * F.log(F.col("_c").cast("double")))
    return counts.groupBy(*keys).agg((F.log(n.cast("double")) - expr.ratio(weighted, n)).alias(out))


def category_share(df: DataFrame, keys: Sequence[str], category: str) -> DataFrame:
    """Rows and share of every (group, category); totals come from the counts, not from the rows."""
    counts = df.groupBy(*keys, category).agg(F.count("*").alias("n"))
    totals = counts.groupBy(*keys).agg(F.sum("n").alias("total"))
    return counts.join(totals, list(keys)).withColumn("share", expr.ratio(F.col("n"), F.col("total")))
