"""Ordered work on groups of any size, and joins with hot keys.

A window puts each group into one task, but one account may own a third of the log. So rows are dealt to *ranges* of
(group, order): a large group is spread over many ranges, small groups share one. Windows run per (group, range), and
what has to cross a border (the previous row, sums so far) travels in a table that has rows only for the groups that
lie in several ranges, at most two a range. The plan is the same for all sizes; nothing is counted or collected first.

Results never depend on where the borders fall; they only balance the work.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyward.session import cut_lineage

RANGE = "_range"


@dataclass(frozen=True)
class Ranges:
    """Rows dealt to ranges of (keys, order); column ``RANGE`` ascends in that order."""

    df: DataFrame
    keys: list[str]
    order: list[str]

    @property
    def group(self) -> list[str]:
        return [*self.keys, RANGE]

    def window(self):
        return Window.partitionBy(*self.group).orderBy(*self.order)

    def over_borders(self, rows: DataFrame, parts: DataFrame, names: Sequence[str]) -> DataFrame:
        """Columns ``names`` of ``parts`` (one row per group and range) on every row of a group in several ranges."""
        n = F.count("*").over(Window.partitionBy(*self.keys))
        side = parts.withColumn("_range_count", n).filter("_range_count > 1").select(*[F.col(g).alias(f"_key_{g}") for g in self.group], *names)
        same = F.col(RANGE) == F.col(f"_key_{RANGE}")
        for k in self.keys:
            same &= F.col(k).eqNullSafe(F.col(f"_key_{k}"))
        return rows.join(side, same, "left").drop(*[f"_key_{g}" for g in self.group])


def in_ranges(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "ranges") -> Ranges:
    """Deal rows to ranges of (keys, order) and write them, so that every use sees the same ranges.

    Only rows that are equal in all of ``keys`` and ``order`` always meet.
    """
    dealt = df.repartitionByRange(*[F.col(c) for c in [*keys, *order]]).withColumn(RANGE, F.spark_partition_id())
    return Ranges(cut_lineage(dealt, name), list(keys), list(order))


def previous_row(r: Ranges, columns: Sequence[str], name: str = "_prev") -> DataFrame:
    """Add struct ``name`` with ``columns`` of the row before; NULL on the first row of a group."""
    packed = F.struct(*columns)
    ends = r.df.groupBy(*r.group).agg(F.max_by(packed, F.struct(*r.order)).alias("_range_end"))
    carry = ends.withColumn("_range_carry", F.lag("_range_end").over(Window.partitionBy(*r.keys).orderBy(RANGE)))
    out = r.over_borders(r.df.withColumn("_range_in", F.lag(packed).over(r.window())), carry, ["_range_carry"])
    return out.withColumn(name, F.coalesce("_range_in", "_range_carry")).drop("_range_in", "_range_carry")


def running_sum(r: Ranges, weight: Column, name: str, total: str, rows: DataFrame | None = None) -> DataFrame:
    """Add the running sum of ``weight`` in order, and its sum over the whole group.

    ``rows`` are those of ``r`` with columns added since.
    """
    upto = r.window().rowsBetween(Window.unboundedPreceding, 0)
    out = (r.df if rows is None else rows).withColumns({name: F.sum(weight).over(upto), total: F.sum(weight).over(Window.partitionBy(*r.group))})
    by_key = Window.partitionBy(*r.keys)
    before = by_key.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    sums = r.df.groupBy(*r.group).agg(F.sum(weight).alias("_range_n"))
    sums = sums.withColumns({"_range_off": F.coalesce(F.sum("_range_n").over(before), F.lit(0)), "_range_all": F.sum("_range_n").over(by_key)})
    out = r.over_borders(out, sums, ["_range_off", "_range_all"])
    return out.withColumns({name: F.col(name) + F.coalesce("_range_off", F.lit(0)), total: F.coalesce("_range_all", F.col(total))}).drop("_range_off", "_range_all")


def positions(r: Ranges, name: str, size: str, rows: DataFrame | None = None) -> DataFrame:
    """Position of each row in its group (0 = first) and the size of the group."""
    out = running_sum(r, F.lit(1).cast("long"), name, size, rows)
    return out.withColumn(name, F.col(name) - 1).drop(RANGE)


def join_unique(rows: DataFrame, dim: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """Join ``rows`` to ``dim`` (one row per ``on``), whatever keys ``rows`` repeats.

    The engine splits the partitions of hot keys where it meets them (adaptive skew join), so nothing is
    counted first. Rows without a key match nothing; they go round the join instead of into one partition.
    """
    keyed = rows.filter(F.col(on).isNotNull()).join(dim, on, how)
    if how == "inner":
        return keyed
    names = [c for c in dim.columns if c != on]
    nothing = {c: F.lit(None).cast(dim.schema[c].dataType) for c in names}
    return keyed.unionByName(rows.filter(F.col(on).isNull()).withColumns(nothing))


def join_grown(rows: DataFrame, other: DataFrame, on: str | Sequence[str], how: str = "inner") -> DataFrame:
    """Join two tables that both grow with the input: neither is collected on the driver for a broadcast.

    The planner takes a stored table for its compressed size, and a few columns of it for their share of that, so
    tables of millions of rows would still pass for small.
    """
    return rows.join(other.hint("merge"), on, how)
