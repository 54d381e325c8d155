"""Connected components by local forests and alternating star contraction.

Edges are read in chunks of bounded size; each chunk is replaced by stars around the smallest vertices
of its own components, which is all there is to do for a graph of one chunk. With more chunks, rounds
of star contraction join what the chunks have found: every vertex hands its larger neighbours to its
smallest one (large star), then its smaller neighbours to the smallest one (small star). The minimum
is an aggregate and the joins back to the edges are plain joins, so no vertex has its neighbours
gathered in one place. A round that changes nothing ends the work; the rounds before are deleted.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyward.session import cut_lineage, drop_table

CHUNK = 400_000


def _forest(edges: DataFrame, chunk: int) -> DataFrame:
    """Stars (u, v), v smallest, of the components of each chunk of edges of a partition."""
    kind = edges.schema["u"].dataType.simpleString()

    def stars(parent: dict, arrow: pa.DataType) -> pa.RecordBatch:
        pairs = [(x, _root(parent, x)) for x in parent]
        pairs = [(x, r) for x, r in pairs if x != r]
        columns = [pa.array([p[k] for p in pairs], arrow) for k in (0, 1)]
        return pa.RecordBatch.from_arrays(columns, names=["u", "v"])

    def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict = {}
        rows = 0
        for batch in batches:
            if rows and rows + batch.num_rows > chunk:
                yield stars(parent, batch.schema.field(0).type)
                parent, rows = {}, 0
            rows += batch.num_rows
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                a, b = _root(parent, a), _root(parent, b)
                parent[max(a, b)] = min(a, b)
        if rows:
            yield stars(parent, batch.schema.field(0).type)

    return edges.mapInArrow(contract, f"u {kind}, v {kind}")


def _root(parent: dict, x):
    while parent.setdefault(x, x) != x:
        parent[x] = x = parent[parent[x]]
    return x


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    smallest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
    larger = both.join(smallest, "u").filter(F.col("v") > F.col("u"))
    return larger.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    smallest = edges.groupBy("u").agg(F.min("v").alias("m"))
    handed = edges.join(smallest, "u").filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return handed.unionByName(smallest.select("u", F.col("m").alias("v"))).distinct()


def _write(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """Write a round and return it with its row count and an order-free hash sum."""
    table = cut_lineage(edges, "edges")
    mark = F.pmod(F.xxhash64("u", "v"), F.lit(2**31 - 1))
    return table, tuple(table.agg(F.count("*"), F.sum(mark)).first())


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", chunk: int = CHUNK) -> DataFrame:
    """(id, component_id) for every vertex that has an edge to another vertex.

    ``component_id`` is the smallest id of the component.
    """
    canonical = edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v"))
    current, mark = _write(canonical.filter(F.col("u") != F.col("v")).distinct())
    while mark[0]:
        chunks = -(-mark[0] // chunk)
        stars, start = _write(_forest(current.coalesce(chunks), chunk))
        drop_table(current)
        current = stars
        if chunks == 1:
            break
        after, mark = _write(_small_star(_large_star(current)))
        drop_table(current)
        current = after
        if mark == start:
            break
    roots = current.select(F.col("v").alias("id")).distinct()
    return current.select(F.col("u").alias("id"), F.col("v").alias("component_id")).unionByName(
        roots.select("id", F.col("id").alias("component_id"))
    )
