"""Merkle manifest of a dataset: a root over all rows, and a proof for each of them.

Rows are leaves. Inside a group (a source) leaves are ordered, every ``ARITY`` consecutive nodes become one, until one
is left: the subroot. Subroots, in the order of their groups, form a tree of the same kind, whose last node is the root.

Checkpoint and recompute: only every ``EVERY``-th level is written. The nodes between two written levels hang
together in aligned subtrees of ``ARITY ** EVERY`` nodes of the lower level, and such a subtree is one row: to go up,
its top is computed and the rest thrown away; to extract proofs, its inner nodes are computed again from the written
ones, the siblings of each path are emitted, and the nodes are dropped. So a group of any size is cut into rows of
fixed size, a path of n levels takes n / ``EVERY`` joins by block, and no join has a group as its key.

Positions come from ranges of (group, order), so a group with a third of all rows is ordered by many tasks.

Defined results: a null is a leaf part of its own ("-"), also as group and as order, where it comes first; equal
leaves of equal order are interchangeable, so repeated rows have proofs of their own; a group of one row has its leaf
as subroot, and a single subroot is the root; a proof without siblings is the hash of nothing; an empty table gives an
empty result. Only the named columns are read, and they may have any names but those that begin with ``_``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyward.llm.lineage import drop, written
from tallyward.operators.skew import in_ranges, positions

ARITY, EVERY = 3, 3
BLOCK = ARITY**EVERY
POWERS = [ARITY**k for k in range(39)]  # all that a long holds
STEP = "struct<left: string, right: string>"


def digest(value: Column) -> Column:
    return F.sha2(value, 256)


def leaf_of(*columns: Column) -> Column:
    """Hash of the values of a row: byte count and value of each, ``-`` for null."""
    parts = []
    for c in columns:
        text = c.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return digest(F.concat(*parts))


def _up(nodes: Column) -> Column:
    """The next level of a list of nodes."""
    runs = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / ARITY).cast("int"))
    return F.transform(runs, lambda r: digest(F.array_join(F.slice(nodes, r * ARITY + 1, F.lit(ARITY)), "")))


def _step(nodes: Column, at: Column) -> Column:
    """Siblings of one node in its run, joined: those before it and those after it."""
    first = at - at % ARITY
    left = F.array_join(F.slice(nodes, first + 1, at % ARITY), "")
    right = F.array_join(F.slice(nodes, at + 2, F.lit(ARITY - 1) - at % ARITY), "")
    return F.struct(left.alias("left"), right.alias("right"))


def height(size: Column) -> Column:
    """Levels above the leaves of a tree of ``size`` leaves."""
    return F.size(F.filter(F.array(*[F.lit(p) for p in POWERS]), lambda p: p < size))


def fold(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and the siblings of its path give."""
    return F.aggregate(steps, leaf, lambda node, s: digest(F.concat(s["left"], node, s["right"])))


def siblings_digest(steps: Column) -> Column:
    """Hash of all siblings of a path, level by level."""
    return digest(F.array_join(F.transform(steps, lambda s: F.concat(s["left"], s["right"])), ""))


@dataclass(frozen=True)
class Tree:
    """Written levels 0, EVERY, 2 EVERY ...: (_group, _at, _height, _node); level 0 has the payload too."""

    levels: list[DataFrame]
    subroots: DataFrame  # _group, _height, _node
    payload: list[str]


def _blocks(level: DataFrame, base: int, payload: Sequence[str] = ()) -> DataFrame:
    """One row per aligned subtree: its nodes, and the inner levels above them as far as the tree goes."""
    rows = level.groupBy("_group", "_height", F.expr(f"_at div {BLOCK}").alias("_block")).agg(
        F.array_sort(F.collect_list(F.struct("_at", "_node", *payload))).alias("_rows")
    )
    rows = rows.withColumns({"_up": F.least(F.lit(EVERY), F.col("_height") - base), "_l0": F.transform("_rows", lambda r: r["_node"])})
    for k in range(1, EVERY + 1):
        rows = rows.withColumn(f"_l{k}", F.when(F.col("_up") >= k, _up(F.col(f"_l{k - 1}"))))
    return rows


def build(leaves: DataFrame, group: Column, order: Sequence[str], node: str, payload: Sequence[str] = ()) -> Tree:
    """Trees over the rows of ``leaves``, one per value of ``group``; only the checkpoint levels are written."""
    rows = leaves.select(group.alias("_group"), *order, F.col(node).alias("_node"), *[c for c in payload if c not in order])
    placed = positions(in_ranges(rows, ["_group"], order, "leaves"), "_at", "_size")
    levels = [written(placed.select("_group", "_at", height(F.col("_size")).alias("_height"), "_node", *payload), "level")]
    top = levels[0].agg(F.max("_height")).first()[0] or 0
    ends = []
    for base in range(0, max(top, 1), EVERY):
        blocks = _blocks(levels[-1], base)
        tops = blocks.select("_group", "_height", F.col("_block").alias("_at"), F.coalesce(*[F.col(f"_l{k}") for k in range(EVERY, -1, -1)])[0].alias("_node"))
        levels.append(written(tops, "level"))
        ends.append(levels[-1].filter(F.col("_height") <= base + EVERY).select("_group", "_height", "_node"))
        levels[-1] = levels[-1].filter(F.col("_height") > base + EVERY)
    subroots = ends[0]
    for more in ends[1:]:
        subroots = subroots.unionByName(more)
    return Tree(levels[:-1], subroots, list(payload))


def paths(tree: Tree, above: DataFrame) -> DataFrame:
    """Every leaf with its payload, the path of its siblings (``steps``) and the columns of ``above``.

    ``above`` has one row per group: ``_group``, ``_steps`` (the path from the subroot on), and what else is handed down.
    """
    handed = [c for c in above.columns if c not in ("_group", "_steps")]
    names = ["_group", "_steps", *handed]
    heights = tree.subroots.select(F.col("_group").alias("_g"), "_height")
    ends = heights.join(above, F.col("_g").eqNullSafe(F.col("_group"))).drop("_g")
    down = None
    for base in reversed(range(0, EVERY * len(tree.levels), EVERY)):
        payload = tree.payload if base == 0 else []
        blocks = _blocks(tree.levels[base // EVERY], base, payload)
        lowest = F.lit(0) if base else F.lit(-1)
        last = ends.filter((F.col("_height") <= base + EVERY) & (F.col("_height") > base + lowest)).select(*names, F.lit(0).cast("long").alias("_at"))
        tops = last if down is None else last.unionByName(down)
        tops = tops.withColumnsRenamed({"_group": "_g", "_at": "_b"})
        joined = blocks.join(tops, F.col("_group").eqNullSafe(F.col("_g")) & (F.col("_block") == F.col("_b")))

        def own(row, k, base=base):
            at = F.floor((row["_at"] % BLOCK) / ARITY**k).cast("int")
            return _step(F.col(f"_l{k}"), at)

        each = F.transform("_rows", lambda r: F.struct(r.alias("row"), F.slice(F.array(*[own(r, k) for k in range(EVERY)]), F.lit(1), F.col("_up")).alias("own")))
        flat = joined.select("_group", "_steps", *handed, F.explode(each).alias("_e"))
        down = flat.select(
            "_group", F.concat("_e.own", "_steps").alias("_steps"), *handed, F.col("_e.row._at").alias("_at"),
            F.col("_e.row._node").alias("_node"), *[F.col(f"_e.row.`{c}`").alias(c) for c in payload],
        )
        if base:
            down = down.drop("_node")
    return down.withColumnsRenamed({"_steps": "steps", "_node": "leaf"})


def manifest(rows: DataFrame, group: Column, order: Sequence[str], leaf: str, payload: Sequence[str] = ()) -> DataFrame:
    """Every row with its leaf, subroot, root and path (``steps``), and the payload columns."""
    tree = build(rows, group, order, leaf, payload)
    # one row per group; the tree over them has a single group
    subroots = written(tree.subroots.select(F.col("_group").alias("_source"), F.col("_node").alias("_sub")), "subroots")
    upper = build(subroots, F.lit(0), ["_source"], "_sub", ["_source"])
    root = upper.subroots.select("_group", F.col("_node").alias("root"), F.array().cast(f"array<{STEP}>").alias("_steps"))
    above = paths(upper, root).select(F.col("_source").alias("_group"), F.col("steps").alias("_steps"), F.col("leaf").alias("subroot"), "root")
    return paths(tree, written(above, "roots"))


def verify_documents(df: DataFrame, id_col: str, source_col: str, columns: Sequence[str], text_col: str, tampered: Column, changed_text: Column) -> DataFrame:
    """Proofs of all rows, checked against rows of which some were changed.

    Where ``tampered`` is true, the row checked has ``changed_text`` as its text. (id, leaf, subroot, root,
    proof_sha256, folded_root, verified), one row per row.
    """
    own = [F.col(f"`{c}`") for c in columns]
    other = [F.when(tampered, changed_text).otherwise(F.col(f"`{c}`")) if c == text_col else F.col(f"`{c}`") for c in columns]
    # texts are read once; from here on a row is some digests
    rows = df.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{source_col}`").alias("_source"), leaf_of(*own).alias("_leaf"), leaf_of(*other).alias("_seen"))
    rows = written(rows, "leaves").withColumn("_row", F.monotonically_increasing_id())
    found = manifest(rows, F.col("_source"), ["_id", "_leaf", "_row"], "_leaf", ["_id", "_seen"])
    out = found.select(
        F.col("_id").alias(id_col), "leaf", "subroot", "root", siblings_digest(F.col("steps")).alias("proof_sha256"),
        fold(F.col("_seen"), F.col("steps")).alias("folded_root"),
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
