"""How filters act on each other: what every filter removes in every order of them.

A row is the set of filters that it fails, a mask of five bits. For each of the 120 orders and each of its five steps
(600 outcomes) a mask is removed there, or fails there but was removed earlier, or neither. ``packed`` maps a mask to
one integer whose 600 fields hold these outcomes, ``FIELD`` bits each; adding integers adds all 600 counters at once.
Every task adds the integers of its rows by part, and the sums, some kilobytes a part, are added again; 2 ** 63 rows
fit a field, so no field runs over into the next. What is kept after a step, and the Shapley sum of a filter, follow
from the removed counts when a sum is unpacked.

One filter needs the other rows: repeated texts. Texts are told apart by SHA-256; rows with one text, part and
labels are merged where they are before they move, so a text of a third of all rows is no hot key.

Defined results: a null text is the empty text, a null part the empty string; a row without an id
has no smaller id and is none, so it is never a repetition and makes none, and has no labels; rows that repeat an id are rows of their own, and none of those
with the smallest id of their text is a repetition; a row without labels is neither good nor toxic, and of several
labels of an id one is enough; an empty table gives an empty result. Texts are read whole. Only the named columns
are read.
"""

from __future__ import annotations

import hashlib
import re
from itertools import permutations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyward.llm.lineage import written
from tallyward.llm.words import encode
from tallyward.operators.skew import join_unique

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
OUTCOMES = [(order, step) for order in ORDERS for step in range(1, 6)]
FIELD = 64
HELD_PARTS = 2000  # parts whose sums a task holds before it hands them on
REPEATED = FILTERS.index("E")
# The characters of the filters.
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SIGNS = re.compile(rb"[#$%&*|]")


def own_mask(text: str, raw: bytes) -> int:
    """Bits of the filters A to D, which look at one text alone."""
    words = raw.split()
    n = len(words)
    few = n < 200
    same = 100 * len(set(words)) < 50 * n
    loud = 100 * (len(raw) - len(raw.translate(None, CAPITALS))) > 2 * len(text)
    return few | same << 1 | loud << 2 | (SIGNS.search(raw) is not None) << 3


def removed_at(mask: int, order: str) -> int | None:
    """The step (1 to 5) at which a row with this mask is removed."""
    return next((step for step, f in enumerate(order, 1) if mask >> FILTERS.index(f) & 1), None)


def packed(mask: int) -> tuple[int, int]:
    """Two integers of 600 fields: removed at the outcome, and failing there but removed earlier."""
    removed = redundant = 0
    for k, (order, step) in enumerate(OUTCOMES):
        at = removed_at(mask, order)
        if at == step:
            removed |= 1 << k * FIELD
        elif at is not None and at < step and mask >> FILTERS.index(order[step - 1]) & 1:
            redundant |= 1 << k * FIELD
    return removed, redundant


def unpack(total: int) -> list[int]:
    """The 600 counters of a sum."""
    raw = total.to_bytes(len(OUTCOMES) * FIELD // 8, "little")
    return [int.from_bytes(raw[k : k + FIELD // 8], "little") for k in range(0, len(raw), FIELD // 8)]


MASKS = [packed(m) for m in range(32)]
#: The counters of a part: rows, then removed, redundant, removed of the good ones, removed of the toxic ones; and rows by mask with one failure.
WIDTH = 5 + len(FILTERS)


def _add(sums: list[int], mask: int, good: bool, toxic: bool, n: int) -> None:
    removed, redundant = MASKS[mask]
    sums[0] += n
    sums[1] += n * removed
    sums[2] += n * redundant
    if good:
        sums[3] += n * removed
    if toxic:
        sums[4] += n * removed
    if mask and mask & (mask - 1) == 0:
        sums[4 + mask.bit_length()] += n


def masks(df: DataFrame, id_col: str, part: Column, text_col: str) -> DataFrame:
    """(doc, part, mask, text digest) of every row."""
    key = df.select(id_col).schema.fields[0].dataType.simpleString()

    def read(batches):
        for batch in batches:
            found, digests = [], []
            for value in batch.column(2):
                text = value.as_py() or ""
                raw = encode(text)
                found.append(own_mask(text, raw))
                digests.append(hashlib.sha256(raw).digest())
            columns = [batch.column(0), batch.column(1), pa.array(found, pa.int32()), pa.array(digests, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc", "part", "mask", "text"])

    source = df.select(F.col(f"`{id_col}`").alias("doc"), F.coalesce(part.cast("string"), F.lit("")).alias("part"), F.col(f"`{text_col}`").alias("text"))
    return source.mapInArrow(read, f"doc {key}, part string, mask int, text binary")


def with_repeats(rows: DataFrame) -> DataFrame:
    """(part, good, toxic, mask, n): masks with the filter of repeated texts, merged rows of one text and part.

    ``rows`` has doc, part, mask, text, good and toxic. Rows of one text have one mask, and of all of them those with the
    smallest id are no repetitions; so per text and part their number, and the number of rows without id, are enough.
    """
    kind = ["text", "part", "good", "toxic", "mask"]
    named = F.col("doc").isNotNull()
    same = rows.groupBy(*kind, "doc").agg(F.count("*").alias("_n"))
    merged = same.groupBy(*kind).agg(
        F.sum("_n").alias("_all"), F.coalesce(F.sum(F.when(~named, F.col("_n"))), F.lit(0)).alias("_unnamed"),
        F.min(F.when(named, F.struct("doc", "_n"))).alias("_least"),
    )
    merged = written(merged, "texts")
    first = merged.groupBy("text").agg(F.min("_least.doc").alias("_first")).filter(F.col("_first").isNotNull())
    joined = join_unique(merged, first, "text", "left")
    fresh = F.when(F.col("_least.doc") == F.col("_first"), F.col("_least._n")).otherwise(0)
    clean = F.col("_unnamed") + F.coalesce(fresh, F.lit(0))
    both = F.array(
        F.struct(F.col("mask"), clean.alias("n")), F.struct(F.col("mask").bitwiseOR(F.lit(1 << REPEATED)).alias("mask"), (F.col("_all") - clean).alias("n"))
    )
    return joined.select("part", "good", "toxic", F.inline(both)).filter("n > 0")


def _partial(batches):
    """Sums of the packed integers of a task by part."""
    held: dict[str, list[int]] = {}

    def out():
        blobs = [[x.to_bytes((x.bit_length() + 7) // 8, "little") for x in s] for s in held.values()]
        return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(blobs, pa.list_(pa.binary()))], names=["part", "sums"])

    for batch in batches:
        for part, good, toxic, mask, n in zip(*(c.to_pylist() for c in batch.columns)):
            if part not in held and len(held) >= HELD_PARTS:
                yield out()
                held.clear()
            _add(held.setdefault(part, [0] * WIDTH), mask, good, toxic, n)
    if held:
        yield out()


def _report(batches):
    """Partial sums, dealt and sorted by part, to the 600 rows of each part."""
    part, sums = None, [0] * WIDTH
    for batch in batches:
        for name, blobs in zip(*(c.to_pylist() for c in batch.columns)):
            if name != part:
                if part is not None:
                    yield unpacked(part, sums)
                part, sums = name, [0] * WIDTH
            for k, b in enumerate(blobs):
                sums[k] += int.from_bytes(b, "little")
    if part is not None:
        yield unpacked(part, sums)


SCHEMA = (
    "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"
)


def unpacked(part: str, sums: list[int]) -> pa.RecordBatch:
    """The 600 rows of one part."""
    removed, redundant, good, toxic = (unpack(s) for s in sums[1:5])
    letters = [order[step - 1] for order, step in OUTCOMES]
    shapley = dict.fromkeys(FILTERS, 0)
    for f, n in zip(letters, removed):
        shapley[f] += n
    kept, left = [], sums[0]
    for (_, step), n in zip(OUTCOMES, removed):
        left = (sums[0] if step == 1 else left) - n
        kept.append(left)
    columns = {
        "part": [part] * len(OUTCOMES), "filter_order": [o for o, _ in OUTCOMES], "step": pa.array([s for _, s in OUTCOMES], pa.int32()), "kept": kept,
        "removed": removed, "redundant": redundant, "unique_fails": [sums[5 + FILTERS.index(f)] for f in letters], "good_lost": good, "toxic_lost": toxic,
        "shapley": [shapley[f] for f in letters],
    }
    return pa.RecordBatch.from_pydict(columns)


def audit(counted: DataFrame) -> DataFrame:
    """One row per part, order and step, from (part, good, toxic, mask, n)."""
    sums = counted.select("part", "good", "toxic", "mask", "n").mapInArrow(_partial, "part string, sums array<binary>")
    return sums.repartition("part").sortWithinPartitions("part").mapInArrow(_report, SCHEMA)


def audit_documents(
    df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source", good_col: str = "quality", toxic_col: str = "toxic",
) -> DataFrame:
    """The filters A to E on whole texts, by part, in all orders."""
    # some bytes a row, written so that the texts are read once
    found = written(masks(df, id_col, F.col(f"`{part_col}`"), text_col), "masks")
    known = labels.groupBy(F.col(f"`{id_col}`").alias("doc")).agg(
        F.max(F.coalesce(F.col(f"`{good_col}`") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col(f"`{toxic_col}`") == 1, F.lit(False))).alias("toxic")
    )
    rows = join_unique(found, known, "doc", "left").fillna(False, subset=["good", "toxic"])
    return audit(with_repeats(rows))
