"""Fixity audit of web archives with Merkle trees over records and offset ranges.

An archive is a sequence of WARC records at known offsets. A tree hashes every record, then the records of
every offset range of 16 KiB in order, then the ranges of 128 KiB, of 1 MiB and so on, and last the whole
archive. Two replicas are compared from the roots down: only the children of nodes that differ are looked at,
until the records are found that are altered, missing or left over.

Ranges are fixed powers of two of the offset, so a node is one group of an aggregate with a bounded number of
children: no order over a whole archive and no numbering is needed. Levels are written as narrow tables.

Defined results: null urls, payloads and ids count as empty; records of any length belong to the range of their
first byte; equal records at different offsets are told apart by offset; repeated rows become records of their
own; an empty replica makes every record of the other missing; empty tables give an empty result. Only the named
columns are read.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyward.llm.lineage import written

ARCHIVE_BYTES = 1 << 20
RANGE_BITS = (14, 17, 20)


def warc_record(page_id: Column, url: Column, payload: Column) -> Column:
    """A WARC resource record as text."""
    empty = F.lit("")
    body = F.coalesce(payload, empty)
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), empty),
        F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, empty), F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"),
    )


def place(records: DataFrame, key: Column, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Add ``archive`` and ``offset`` to rows with ``digest`` and ``length``.

    Records are dealt to archives of about ``archive_bytes`` by a digest of ``key`` and lie in its order.
    """
    rows = records.withColumn("_key", F.md5(key.cast("binary")))
    size = rows.agg(F.sum("length")).first()[0] or 0  # one number
    archives = max(1, -(-size // archive_bytes))
    rows = rows.withColumn("archive", F.conv(F.substring("_key", 1, 8), 16, 10).cast("long") % archives)
    before = Window.partitionBy("archive").orderBy("_key", "digest").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long")).drop("_key")


@dataclass
class Tree:
    """Node tables (archive, node, digest) from the records up; the node of a record is its offset."""

    levels: list[DataFrame]
    bits: tuple[int, ...]


def merkle_tree(records: DataFrame, bits: Sequence[int] = RANGE_BITS) -> Tree:
    """Tree over (archive, offset, digest); the last level has one node for each archive."""
    levels = [records.select("archive", F.col("offset").alias("node"), "digest")]
    done = 0
    for b in [*bits, None]:
        node = F.lit(0).cast("long") if b is None else F.shiftright("node", b - done)
        children = F.sort_array(F.collect_list(F.struct(F.col("node").alias("n"), "digest")))
        joined = F.concat_ws(";", F.transform(children, lambda c: F.concat_ws(":", c["n"].cast("string"), c["digest"])))
        level = levels[-1].groupBy("archive", node.alias("_up")).agg(F.sha2(joined, 256).alias("digest"))
        levels.append(written(level.select("archive", F.col("_up").alias("node"), "digest"), "tree"))
        done = b or done
    return Tree(levels, tuple(bits))


def audit(ours: Tree, theirs: Tree) -> DataFrame:
    """(archive, offset, status) of the records that differ: altered, missing (from theirs) or extra (in theirs)."""
    found: DataFrame | None = None
    steps = [0, *ours.bits]
    for level in range(len(ours.levels) - 1, -1, -1):
        a, b = ours.levels[level], theirs.levels[level]
        if found is not None:
            # children of the nodes that differ, one level above
            shift = None if level == len(ours.levels) - 2 else steps[level + 1] - steps[level]
            up = F.lit(0).cast("long") if shift is None else F.shiftright("node", shift)
            wanted = found.select("archive", F.col("node").alias("_up"))
            a, b = (x.withColumn("_up", up).join(wanted, ["archive", "_up"], "left_semi").drop("_up") for x in (a, b))
        both = a.withColumnRenamed("digest", "da").join(b.withColumnRenamed("digest", "db"), ["archive", "node"], "full")
        # read twice one level below, so each level is written: the nodes that differ, and no join of joins
        found = written(both.filter(~F.col("da").eqNullSafe(F.col("db"))), "differing")
    status = F.when(F.col("db").isNull(), F.lit("missing")).when(F.col("da").isNull(), F.lit("extra")).otherwise(F.lit("altered"))
    return found.select("archive", F.col("node").alias("offset"), status.alias("status"))


def audit_records(records: DataFrame, ours: Tree, theirs: Tree) -> DataFrame:
    """``records`` (archive, offset, ...) with their ``status`` (intact where nothing differs) and the ``root`` of their archive."""
    roots = ours.levels[-1].select("archive", F.col("digest").alias("root"))
    out = records.join(audit(ours, theirs), ["archive", "offset"], "left").join(roots, "archive", "left")
    return out.withColumn("status", F.coalesce("status", F.lit("intact")))
