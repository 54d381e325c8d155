"""Distributed connected components by local forests and alternating star contraction.

Edges are pairs of orderable ids. They are read in chunks of at most ``CHUNK`` edges, and every chunk is
replaced by stars around the smallest ids of its own components; a graph of one chunk is then done. With more
chunks, rounds of star contraction join what the chunks have found. In a round every vertex hands its larger neighbours to its smallest
one (large star), then its smaller neighbours to the smallest one (small star); a round that changes
nothing leaves stars around the smallest id of each component. Minima are aggregates and the joins back
to the edges can be split by the engine, so no vertex has its neighbours gathered in one place. Each
round is one written table.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyward.llm.lineage import drop, written


CHUNK = 400_000


def _forest(e: DataFrame, chunk: int) -> DataFrame:
    """Stars around the smallest id of each component of each chunk of edges."""
    kind = e.schema["u"].dataType.simpleString()

    def contract(batches):
        up: dict = {}
        seen, arrow = 0, None

        def root(x):
            while up.setdefault(x, x) != x:
                up[x] = x = up[up[x]]
            return x

        def close():
            out = [(x, root(x)) for x in up]
            out = [(x, r) for x, r in out if x != r]
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], arrow), pa.array([r for _, r in out], arrow)], names=["u", "v"])

        for batch in batches:
            arrow = batch.schema.field(0).type
            for k in range(0, batch.num_rows, 10_000):
                part = batch.slice(k, min(10_000, batch.num_rows - k))
                if seen + part.num_rows > chunk and seen:
                    yield close()
                    up, seen = {}, 0
                seen += part.num_rows
                for a, b in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    a, b = root(a), root(b)
                    if a != b:
                        up[max(a, b)] = min(a, b)
        if up:
            yield close()

    return e.mapInArrow(contract, f"u {kind}, v {kind}")


def _large(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(e: DataFrame) -> DataFrame:
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    handed = e.join(least, "u").filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return handed.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _marked(e: DataFrame) -> tuple[DataFrame, tuple]:
    """A written round with its row count and an order-free hash sum."""
    table = written(e, "star")
    mark = F.pmod(F.xxhash64("u", "v"), F.lit(1 << 31))
    return table, tuple(table.agg(F.count(F.lit(1)), F.sum(mark)).first())


def components(edges: DataFrame, src: str, dst: str, chunk: int = CHUNK) -> DataFrame:
    """(id, root) for every vertex with an edge to another one; root is the smallest id of its component.

    Loops, repeated edges and null ends are allowed and add nothing; without edges the result is empty.
    """
    e = edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v"), F.col(src).isNotNull().alias("a"), F.col(dst).isNotNull().alias("b"))
    e = e.filter(F.col("a") & F.col("b") & (F.col("u") != F.col("v"))).select("u", "v").distinct()
    now, (n, mark) = _marked(e)
    while n:
        chunks = -(-n // chunk)
        stars, (n, mark) = _marked(_forest(now.coalesce(chunks), chunk))
        drop(now)
        now = stars
        if chunks == 1:
            break
        after, new = _marked(_small(_large(now)))
        drop(now)
        now, settled = after, new == (n, mark)
        n, mark = new
        if settled:
            break
    roots = now.select(F.col("v").alias("id")).distinct()
    return now.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(roots.select("id", F.col("id").alias("root")))
