"""Registry of queries and the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
DIGITS = 6
# A mean of amounts in cents over n rows can end in a 5 at the seventh digit, where two correct sums
# round differently; these columns keep enough digits to be free of such ties.
FINER = {"tokens_mean": 9}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = lambda spark, sf_dir: normal(fn(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def normal(df: DataFrame) -> DataFrame:
    """Integers as long and fractions as double rounded to six digits, so sums taken in another
    order still compare equal."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            c = c.cast("long")
        elif isinstance(f.dataType, (T.FloatType, T.DoubleType, T.DecimalType)):
            c = F.round(c.cast("double"), FINER.get(f.name, DIGITS))
        cols.append(c.alias(f.name))
    return df.select(*cols)


def sql(ctes: str, select: str, **types: str) -> str:
    """Oracle text: ``select`` over ``ctes`` with each column cast to the type named for it."""
    out = []
    for name, kind in types.items():
        out.append(f"round(cast({name} AS double), {FINER.get(name, DIGITS)}) AS {name}" if kind == "double" else f"cast({name} AS {kind}) AS {name}")
    head = f"WITH RECURSIVE {ctes}, result AS ({select})" if ctes else f"WITH result AS ({select})"
    return f"{head} SELECT {', '.join(out)} FROM result"


INT, DBL, TXT, BOOL = "bigint", "double", "varchar", "boolean"
