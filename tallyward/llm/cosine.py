"""Embedding near-duplicates: random-hyperplane tables, exact cosine verification, connected components.

Equal vectors of one label are one class with a count. Every class gets, in each of several tables, the
sign pattern of its products with random hyperplanes; classes of one label with the same pattern in a table
are candidates. Buckets are cut into blocks of bounded size and compared block by block, so a bucket of any
size is whole and never in one task; candidates are verified by cosine in double precision, as one matrix
product per pair of blocks. A pair found in several tables is counted in the first of them: both patterns
are known where the pair is verified, so no pair is shuffled to remove repeats. Links to a class count as
many as it has vectors.

With the default 100 tables of 16 bits a pair of cosine 0.93 (each bit agrees with probability 0.88) is missed
with probability 1e-6. Small buckets share tasks. Links are summed per vector in the task that finds them, and only the links that
connect clusters there go on to the components.

Defined results: rows with a null label, or a vector that is null, empty, zero or holds null or non-finite
components, link with nothing and are their own component; vectors of different lengths do not link;
repeated rows are links of each other; a null id takes the smallest id of its component; an empty table
gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyward.llm.linked import components
from tallyward.llm.lineage import written

SEED = 97
BLOCK = 1024


def planes(width: int, tables: int, bits: int) -> np.ndarray:
    """Random hyperplanes for vectors of a length, the same in every task."""
    return np.random.default_rng([SEED, width]).standard_normal((width, tables * bits))


def signatures(matrix: np.ndarray, tables: int, bits: int) -> np.ndarray:
    """Sign patterns (rows, tables) of unit vectors; the length of the vectors is part of the pattern."""
    signs = (matrix @ planes(matrix.shape[1], tables, bits) >= 0).reshape(len(matrix), tables, bits)
    codes = (signs.astype(np.int64) << np.arange(bits)).sum(2)
    return codes + (np.int64(matrix.shape[1]) << 32)


def unit(matrix: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; scaling by the largest component first keeps squares finite."""
    matrix = matrix / np.abs(matrix).max(1, keepdims=True)
    return matrix / np.sqrt((matrix * matrix).sum(1, keepdims=True))


def _by_width(vectors: pa.Array) -> dict[int, np.ndarray]:
    widths = np.array([len(v) for v in vectors])
    return {int(w): np.flatnonzero(widths == w) for w in np.unique(widths)}


def table_rows(classes: DataFrame, tables: int, bits: int) -> DataFrame:
    """(tbl, code, cls): the bucket of every class in every table."""

    def spread(batches):
        for batch in batches:
            for width, rows in _by_width(batch.column(1)).items():
                part = batch.take(pa.array(rows))
                matrix = unit(part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), width))
                codes = signatures(matrix, tables, bits)
                which = np.tile(np.arange(tables, dtype=np.int32), len(rows))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(which), pa.array(codes.ravel()), part.column(0).take(pa.array(np.repeat(np.arange(len(rows)), tables)))],
                    names=["tbl", "code", "cls"],
                )

    return classes.select("cls", "vector").mapInArrow(spread, "tbl int, code long, cls long")


def _least_reached(near: np.ndarray, square: bool) -> tuple[np.ndarray, np.ndarray]:
    """Smallest position that each line and each column is connected with; columns count on after the lines unless
    the matrix is square, where both are the same rows."""
    rows, columns = near.shape
    line = np.arange(rows)
    column = line if square else rows + np.arange(columns)
    none = rows + columns
    while True:
        down = np.minimum(column, np.where(near, line[:, None], none).min(0))
        across = np.minimum(down if square else line, np.where(near, down[None, :], none).min(1))
        if (across == line).all() and (down == column).all():
            return across, down
        line, column = across, across if square else down


def _verify(found: DataFrame, least: float, tables: int, bits: int) -> DataFrame:
    """(cls, links, peer) from blocks: ``links`` sums the vectors linked with the class in a part, ``peer`` is a class
    it is connected with. Rows are (task, part, tbl, side, cls, n, vector); in a part, sides 0 and 1 are compared, or
    side 2 with itself."""

    def work(data: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], []]
        part, tbl, side, cls, n = (data.column(c).to_numpy() for c in ("part", "tbl", "side", "cls", "n"))
        vectors = data.column("vector").combine_chunks()
        flat = vectors.flatten().to_numpy(zero_copy_only=False)
        begin = np.concatenate([[0], np.cumsum([len(v) for v in vectors])])
        order = np.lexsort((side, tbl, part))
        edges = np.flatnonzero(np.diff(part[order]) | np.diff(tbl[order])) + 1
        for rows in np.split(order, edges):
            if len(rows) < 2:
                continue
            own = side[rows[0]] == 2
            width = begin[rows[0] + 1] - begin[rows[0]]
            at = begin[rows][:, None] + np.arange(width)[None, :]
            matrix = unit(flat[at].astype(np.float64))
            a = rows if own else rows[side[rows] == 0]
            b = rows if own else rows[side[rows] == 1]
            x, y = matrix[: len(a)], matrix[len(rows) - len(b) :]
            near = x @ y.T >= least
            if own:
                np.fill_diagonal(near, False)
            if not near.any():
                continue
            i, j = np.nonzero(near)
            line, column = _least_reached(near, own)
            # a pair counts in the first table that holds both
            t = int(tbl[rows[0]])
            first = np.ones(len(i), bool)
            if t:
                cx, cy = signatures(x, tables, bits)[:, :t], signatures(y, tables, bits)[:, :t]
                for k in range(0, len(i), 65_536):
                    cut = slice(k, k + 65_536)
                    first[cut] = ~(cx[i[cut]] == cy[j[cut]]).any(1)
            seen_a, seen_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
            np.add.at(seen_a, i[first], n[b[j[first]]])
            np.add.at(seen_b, j[first], n[a[i[first]]])
            both = cls[np.concatenate([a, b])]
            for who, seen, reach in [(a, seen_a, line)] if own else [(a, seen_a, line), (b, seen_b, column)]:
                keep = near.any(1) if who is a else near.any(0)
                for column_out, values in zip(out, (cls[who][keep], seen[keep], both[reach[keep]])):
                    column_out.append(values)
        arrays = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in out]
        return pa.table(dict(zip(("cls", "links", "peer"), map(pa.array, arrays))))

    return found.groupBy("task").applyInArrow(work, "cls long, links long, peer long")


def near_vectors(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = 0.93,
    tables: int = 100, bits: int = 16, block: int = BLOCK,
) -> DataFrame:
    """One row per row: (id, n_links, component_id, kept)."""
    vector = F.col("vector")
    zero = F.lit(0).cast(df.schema[vector_col].dataType.elementType)
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    usable = F.col("label").isNotNull() & vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").alias("label"), F.col(f"`{vector_col}`").alias("vector"))
    # adding zero makes one of both zeros
    rows = rows.withColumn("vector", F.when(F.coalesce(usable, F.lit(False)), F.transform(vector, lambda x: x + zero)))
    rows = rows.withColumn("cls", F.when(F.col("vector").isNotNull(), F.xxhash64("label", "vector")))
    classes = rows.filter(F.col("cls").isNotNull()).groupBy("cls", "label", "vector").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("rep"))
    classes = written(classes, "vectors")
    buckets = table_rows(classes, tables, bits)
    placed = written(buckets.join(classes.select("cls", "label"), "cls"), "buckets")
    sizes = placed.groupBy("label", "tbl", "code").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1)
    sizes = sizes.select("label", "tbl", "code", F.ceil(F.col("_n") / block).cast("int").alias("_blocks"))
    rows_in = placed.join(sizes, ["label", "tbl", "code"]).withColumn("_b", F.pmod(F.hash("cls"), F.col("_blocks")))
    # the pairs of blocks that hold a class, in one order: (b, b) once, and (b, o) or (o, b) for every other block o
    rows_in = rows_in.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    part = F.xxhash64("label", "code", F.least("_b", "_o"), F.greatest("_b", "_o"))
    packs = max(1, placed.count() // (8 * block))
    single = F.pmod(F.xxhash64("label", "tbl", "code"), F.lit(packs))
    task = F.when(F.col("_blocks") == 1, F.concat(F.lit("p"), single)).otherwise(F.concat_ws("/", part, "tbl"))
    side = F.when(F.col("_b") == F.col("_o"), F.lit(2)).when(F.col("_b") < F.col("_o"), F.lit(0)).otherwise(F.lit(1))
    work = rows_in.select(task.alias("task"), part.alias("part"), "tbl", side.alias("side"), "cls").join(classes.select("cls", "n", "vector"), "cls")
    found = written(_verify(work, least, tables, bits), "cosine")
    labels = components(found, "cls", "peer").select(F.col("id").alias("cls"), "root")
    links = found.groupBy("cls").agg(F.sum("links").alias("_links"))
    known = classes.select("cls", "n", "rep").join(links, "cls", "left").join(labels, "cls", "left")
    known = known.withColumn("root", F.coalesce("root", "cls"))
    least_id = known.groupBy("root").agg(F.min("rep").alias("_least"))
    known = known.join(least_id, "root").select("cls", (F.col("n") - 1 + F.coalesce("_links", F.lit(0))).alias("n_links"), "_least")
    out = rows.select("id", "cls").join(known, "cls", "left")
    component = F.coalesce("_least", "id")
    return out.select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.col("id").eqNullSafe(component).alias("kept"),
    )
