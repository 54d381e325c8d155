"""Mixing sources to target weights by Pfair scheduling, with DataFrame functions only.

Rows of a source are put in a fixed pseudo-random order and cut into blocks. In the ideal schedule every
source is served all the time at a rate in proportion to its weight; when a source has run out, the others
share its rate. A block is released when the ideal schedule begins it and is due when the ideal schedule
ends it; earliest deadline first then serves every block inside its window, so at any time each source is
less than one block away from the ideal.

Weights are integers, so the schedule falls into rounds in which a source with weight w has w blocks. At
the border of a round nothing is pending, and rounds with the same number of blocks of each source are
scheduled alike: only the rounds in which some source ends differ, which makes at most two kinds of rounds
for each named source, and one more. These few patterns are made once, by a fold over the slots of a round;
each block finds its slot from its number. The tables of patterns depend on the number of named sources and
their weights only, not on the data, and are broadcast for that reason.

Positions inside a source come from counts over 65,536 ranges of a digest, in two levels, and a window
inside one range, so no source is ever gathered in one task.

Defined results: sources that are not named, and null, are pooled and share one weight; every row gets one
position, nothing is dropped or repeated; equal rows get different positions; rows are ordered by the
digest of all their columns, so rows of one id, or of none, are spread like others and their order follows
from their content (only rows equal in every column share a range); an empty table gives an empty result. Columns of the input
stay, except that names beginning with ``_mix_`` are taken; ``slot``, ``block`` and ``position`` are added
by :func:`mix_sources` and replace input columns of these names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 32
REST = ""
ADDED = ("slot", "block", "position")


def _ranked(df: DataFrame, id_col: str, source_col: str, named: list[str]) -> DataFrame:
    """Add ``_mix_source``, its index-free name, and ``_mix_row``, the position in the source from 0."""
    # rows of one id, or of none, are dealt to ranges by their whole content; nulls and empty texts stay apart, and
    # the JSON of a row keeps the names, so no two different rows read alike
    whole = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))
    digest = F.md5(whole.cast("binary"))
    source = F.col(f"`{source_col}`")
    rows = df.withColumn("_mix_source", F.when(source.isin(named), source).otherwise(F.lit(REST)))
    rows = rows.withColumn("_mix_key", digest)
    rows = rows.withColumns({"_mix_high": F.substring("_mix_key", 1, 2), "_mix_low": F.substring("_mix_key", 3, 2)})
    fine = rows.groupBy("_mix_source", "_mix_high", "_mix_low").agg(F.count(F.lit(1)).alias("_mix_n"))
    coarse = rows.groupBy("_mix_source", "_mix_high").agg(F.count(F.lit(1)).alias("_mix_c"))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    within = before(Window.partitionBy("_mix_source", "_mix_high").orderBy("_mix_low"))
    across = before(Window.partitionBy("_mix_source").orderBy("_mix_high"))
    fine = fine.select("_mix_source", "_mix_high", "_mix_low", F.coalesce(F.sum("_mix_n").over(within), F.lit(0)).alias("_mix_a"))
    coarse = coarse.select("_mix_source", "_mix_high", F.coalesce(F.sum("_mix_c").over(across), F.lit(0)).alias("_mix_b"))
    offsets = fine.join(coarse, ["_mix_source", "_mix_high"])
    keys = ["_mix_source", "_mix_high", "_mix_low"]
    inside = F.row_number().over(Window.partitionBy(*keys).orderBy("_mix_key")) - 1
    ranked = rows.withColumn("_mix_inside", inside).join(offsets, keys)
    return ranked.withColumn("_mix_row", F.col("_mix_a") + F.col("_mix_b") + F.col("_mix_inside")).drop(
        *keys[1:], "_mix_key", "_mix_a", "_mix_b", "_mix_inside"
    )


def schedule(blocks: DataFrame) -> DataFrame:
    """Patterns from (source, weight, blocks), one row per source with at least one block.

    One row per source and kind of round: (source, weight, from_round, to_round, first_slot, per_round, slots), where
    ``slots[j]`` is the slot of the source's j-th block in a round. All work is on arrays over the named sources.
    """
    one = blocks.groupBy().agg(F.sort_array(F.collect_list(F.struct("source", "weight", "blocks"))).alias("s"))
    # rounds at which the number of blocks of some source changes
    one = one.withColumn(
        "cuts", F.expr("array_sort(array_distinct(flatten(array(array(0L), transform(s, x -> x.blocks div x.weight), transform(s, x -> x.blocks div x.weight + 1)))))")
    )
    kinds = one.select("s", F.posexplode(F.expr("slice(cuts, 1, size(cuts) - 1)")).alias("k", "from_round"), "cuts")
    kinds = kinds.withColumn("to_round", F.expr("cuts[k + 1]")).drop("cuts", "k")
    kinds = kinds.withColumns(
        {
            # blocks of each source in one round of this kind, and the slot at which the kind begins
            "c": F.expr("transform(s, x -> greatest(0L, least(x.weight, x.blocks - from_round * x.weight)))"),
            "first_slot": F.expr("aggregate(s, 0L, (t, x) -> t + least(x.weight * from_round, x.blocks))"),
        }
    ).withColumn("per_round", F.expr("aggregate(c, 0L, (t, x) -> t + x)"))
    # in a round, source i is served at rate weight i until its blocks of the round are done: at the time m / w the
    # ideal schedule has served the sum of min(w_i m / w, c_i); times w, that is a whole number
    served = "aggregate(sequence(0, size(s) - 1), 0L, (t, i) -> t + least(s[i].weight * {m}, c[i] * s[j].weight))"
    jobs = f"""
        array_sort(flatten(transform(sequence(0, size(s) - 1), j ->
          if(c[j] = 0, array(), transform(sequence(0L, c[j] - 1), m -> struct(
            -(-({served.format(m="(m + 1)")}) div s[j].weight) AS due, j AS j, m AS m, ({served.format(m="m")}) div s[j].weight AS release))))))
    """
    # -(-a div w) truncates towards zero in SQL, so the ceiling is written with a remainder
    jobs = jobs.replace(
        f"-(-({served.format(m='(m + 1)')}) div s[j].weight)",
        f"(({served.format(m='(m + 1)')}) + s[j].weight - 1) div s[j].weight",
    )
    kinds = kinds.filter("per_round > 0").withColumn("jobs", F.expr(jobs))
    pick = "element_at(filter(a.rest, x -> x.release <= t), 1)"
    empty = "slice(jobs, 1, 0)"
    # the filter above may be evaluated later than this, so rounds without blocks must not fail
    slots = "slice(sequence(0L, greatest(per_round, 1L) - 1), 1, cast(per_round as int))"
    kinds = kinds.withColumn(
        "order",
        F.expr(
            f"aggregate({slots}, named_struct('rest', jobs, 'done', {empty}), (a, t) -> named_struct("
            f"'rest', filter(a.rest, y -> not (y.j = {pick}.j and y.m = {pick}.m)), 'done', concat(a.done, array({pick}))), a -> a.done)"
        ),
    )
    rows = kinds.select("s", "from_round", "to_round", "first_slot", "per_round", F.posexplode("order").alias("slot", "job"))
    return rows.groupBy(F.expr("s[job.j].source").alias("source"), F.expr("s[job.j].weight").alias("weight"), "from_round", "to_round", "first_slot", "per_round").agg(
        F.transform(F.sort_array(F.collect_list(F.struct(F.col("job.m").alias("m"), "slot"))), lambda x: x["slot"]).alias("slots")
    )


def mix_sources(
    df: DataFrame, weights: dict[str, int], rest_weight: int = 1, id_col: str = "doc_id", source_col: str = "source", block: int = BLOCK
) -> DataFrame:
    """All rows and columns of ``df`` with ``block`` (number of the row's block in its source), ``slot`` (the block's
    place in the mix) and ``position`` (the row's place; the last block of a source may leave places empty)."""
    if min([*weights.values(), rest_weight], default=1) < 1 or REST in weights:
        raise ValueError("weights are positive integers of named sources")
    rows = _ranked(df.drop(*(set(ADDED) - {id_col, source_col})), id_col, source_col, sorted(weights))
    sizes = df.groupBy(F.when(F.col(f"`{source_col}`").isin(sorted(weights)), F.col(f"`{source_col}`")).otherwise(F.lit(REST)).alias("source"))
    sizes = sizes.agg(F.ceil(F.count(F.lit(1)) / block).cast("long").alias("blocks"))
    weight = F.lit(rest_weight)
    for name in sorted(weights):
        weight = F.when(F.col("source") == name, F.lit(weights[name])).otherwise(weight)
    plan = schedule(sizes.select("source", weight.cast("long").alias("weight"), "blocks"))
    plan = plan.select(*[F.col(c).alias(f"_mix_{c}") for c in plan.columns if c != "source"], F.col("source").alias("_mix_source"))
    rows = rows.withColumn("block", F.expr(f"_mix_row div {int(block)}"))
    # at most (2 n + 1) n rows for n named sources, whatever the data
    found = rows.join(
        F.broadcast(plan.withColumnRenamed("_mix_source", "_mix_name")),
        (F.col("_mix_source") == F.col("_mix_name"))
        & F.expr("block div _mix_weight >= _mix_from_round and block div _mix_weight < _mix_to_round"),
    )
    slot = "_mix_first_slot + (block div _mix_weight - _mix_from_round) * _mix_per_round + _mix_slots[cast(block % _mix_weight as int)]"
    found = found.withColumn("slot", F.expr(slot)).withColumn("position", F.expr(f"slot * {int(block)} + _mix_row % {int(block)}"))
    return found.drop(*[c for c in found.columns if c.startswith("_mix_")])


def in_order(df: DataFrame, weights: dict[str, int], rest_weight: int = 1, id_col: str = "doc_id", source_col: str = "source", block: int = BLOCK) -> DataFrame:
    """The rows and columns of ``df`` in the order of the mix over all partitions."""
    # columns with the names that the mix adds are put aside
    aside = {c: f"_aside_{c}" for c in ADDED if c in df.columns and c not in (id_col, source_col)}
    mixed = mix_sources(df.withColumnsRenamed(aside), weights, rest_weight, id_col, source_col, block)
    ordered = mixed.repartitionByRange("position").sortWithinPartitions("position").drop(*ADDED)
    return ordered.withColumnsRenamed({v: k for k, v in aside.items()}).select(*[f"`{c}`" for c in df.columns])
