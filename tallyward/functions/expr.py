"""Column expressions shared by the operators; all stay inside generated code."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86400
HOUR = 3600
DELTA_BUCKETS = 8


def hour_of_day(ts: Column) -> Column:
    return F.floor((ts % DAY) / HOUR).cast("int")


def fractional_hour(ts: Column) -> Column:
    return (ts % DAY) / F.lit(3600.0)


def day_number(ts: Column) -> Column:
    return F.floor(ts / DAY).cast("long")


def hour_bucket(ts: Column) -> Column:
    return F.floor(ts / HOUR).cast("long")


def ratio(a: Column, b: Column) -> Column:
    """a / b in double; NULL where it is undefined."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def rate(pred: Column) -> Column:
    """Mean of a predicate over the rows where it is defined."""
    return F.avg(pred.cast("double"))


def delta_bucket(delta: Column) -> Column:
    """floor(log10(max(delta, 1))) clamped to 0..7; NULL for a missing delta.

    ``greatest`` skips nulls, so the null case is guarded explicitly.
    """
    raw = F.floor(F.log10(F.greatest(delta.cast("double"), F.lit(1.0))))
    return F.when(delta.isNotNull(), F.least(F.greatest(raw, F.lit(0)), F.lit(DELTA_BUCKETS - 1)).cast("int"))


def entropy_of_counts(columns: Sequence[str]) -> Column:
    """Shannon entropy (natural log) over a fixed set of categories held as one count column each."""
    counts = f"array({', '.join(columns)})"
    total = " + ".join(columns)
    return F.expr(
        f"aggregate({counts}, 0D, (acc, c) -> acc + if(c > 0, -(c / ({total})) * ln(c / ({total})), 0D))"
    )


def nearest_rank(n: Column, percent: int) -> Column:
    """1-based rank of the nearest-rank quantile, in integer arithmetic."""
    scaled = F.lit(percent) * (n - 1) + 50
    return F.lit(1) + ((scaled - scaled % 100) / 100).cast("long")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0),
        lambda acc, x: acc + x,
    )


def l2_norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), l2_norm(a) * l2_norm(b))


def one_hot(col: Column, values: Sequence[str]) -> list[Column]:
    return [F.coalesce((col == v).cast("double"), F.lit(0.0)) for v in values]


def arithmetic_hash(key: Column, seed: int = 0) -> Column:
    """Order-free pseudo-random number of an integer key, easy to repeat in any SQL dialect.

    Two rounds of a linear congruence modulo a prime below 2^31, so products stay in 64 bits.
    """
    prime = 2147483647
    first = ((F.pmod(key.cast("long"), F.lit(prime)) + F.lit(seed)) * F.lit(1103515245) + F.lit(12345)) % F.lit(prime)
    return (first * F.lit(48271) + F.lit(11)) % F.lit(prime)
