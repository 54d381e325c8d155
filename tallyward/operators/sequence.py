"""Per-account event sequences, the model of normal behaviour, and surprise."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyward.functions import expr
from tallyward.operators.quantile import group_quantiles
from tallyward.operators.skew import RANGE, in_ranges, join_grown, positions, previous_row
from tallyward.session import cut_lineage
from tallyward.sources.schema import ASN_TYPES, ENDPOINTS

KEY = ["user_id"]
ORDER = ["ts", "event_id"]
# Rows of an account that one window task orders; a history of any length is cut into such pieces.
PIECE = 4096
CONTENT_BUCKETS = 32
BRANCHES = 16  # parts of an account whose newest rows are found apart
SMOOTH = 16
CHANGES = {"ip_chg": "ip", "dev_chg": "device_fp", "cc_chg": "country"}
NUMERIC = ["delta_log", "hour_sin", "hour_cos", "tokens_log", "success", *CHANGES]


def _history_columns(prev: str = "_prev") -> dict[str, Column]:
    """Gap and change flags against the row before; all 0 on the first row of an account."""
    changed = {
        name: F.coalesce((F.col(c) != F.col(f"{prev}.{c}")).cast("double"), F.lit(0.0)) for name, c in CHANGES.items()
    }
    return {"delta": F.coalesce(F.col("ts") - F.col(f"{prev}.ts"), F.lit(0)).cast("long"), **changed}


def event_deltas(activity: DataFrame) -> DataFrame:
    """Every event with its gap and change flags; accounts of any size."""
    out = previous_row(in_ranges(activity, KEY, ORDER, "log"), ["ts", *CHANGES.values()])
    return out.withColumns(_history_columns()).drop("_prev", RANGE)


def event_history(activity: DataFrame) -> DataFrame:
    """Every event with its gap, change flags and position in the account's history (0 = oldest)."""
    log = in_ranges(activity, KEY, ORDER, "log")
    rows = previous_row(log, ["ts", *CHANGES.values()]).withColumns(_history_columns()).drop("_prev")
    return positions(log, "pos", "_all_rows", rows).drop("_all_rows")


def _pieces(rows: DataFrame, ahead: int, piece: int) -> DataFrame:
    """Add ``_piece``: rows are cut by position, and the first ``ahead`` rows of a piece are also in the one before.

    A window over (account, piece) then sees ``ahead`` rows past each row of the piece, and no account is ordered
    in one task. Rows with ``_own`` are the piece's own ones.
    """
    own = F.expr(f"pos div {piece}")
    both = F.when((F.col("pos") % piece < ahead) & (own > 0), F.array(own, own - 1)).otherwise(F.array(own))
    return rows.withColumn("_piece", F.explode(both)).withColumn("_own", F.col("_piece") == own)


def event_tail(activity: DataFrame, tail: int, branches: int = BRANCHES) -> DataFrame:
    """The most recent ``tail`` events of each account with gap, change flags and position (0 = oldest).

    One event more is kept while gaps are computed, so the first kept event has its true gap. The newest rows are a
    bounded state that merges in levels: those of a map task, then those of a branch of an account (by a hash of the
    event), then those of the account; so at most ``branches`` times tail + 1 rows of one account meet, however many
    tasks had some.
    """
    newest = [F.desc(c) for c in ORDER]
    first = Window.partitionBy(*KEY, "_branch").orderBy(*newest)
    latest = Window.partitionBy(*KEY).orderBy(*newest)
    in_order = Window.partitionBy(*KEY).orderBy(*ORDER)
    dealt = activity.withColumn("_branch", F.pmod(F.xxhash64("event_id"), F.lit(branches)))
    some = dealt.withColumn("_back", F.row_number().over(first)).filter(F.col("_back") <= tail + 1).drop("_branch")
    recent = some.withColumn("_back", F.row_number().over(latest)).filter(F.col("_back") <= tail + 1)
    with_prev = recent.withColumn("_prev", F.lag(F.struct("ts", *CHANGES.values())).over(in_order))
    kept = with_prev.withColumns(_history_columns()).filter(F.col("_back") <= tail)
    return kept.withColumn("pos", F.row_number().over(in_order) - 1).drop("_back", "_prev")


def content_bucket(cluster: Column) -> Column:
    """Hash of a text cluster name into a fixed number of buckets."""
    return (F.crc32(cluster) % CONTENT_BUCKETS).cast("int")


def _index(col: Column, values: list[str]) -> Column:
    out = F.lit(None).cast("int")
    for i, v in reversed(list(enumerate(values))):
        out = F.when(col == v, i).otherwise(out)
    return out


def event_encoding(tail: DataFrame, endpoints: list[str] = ENDPOINTS) -> DataFrame:
    """Numeric and categorical encoding of each event of the tail; expects ``content`` (0..31)."""
    angle = expr.fractional_hour(F.col("ts")) * F.lit(2 * math.pi / 24)
    return tail.select(
        *KEY,
        "event_id",
        "ts",
        "pos",
        "delta",
        (F.log1p("delta") / 14).alias("delta_log"),
        F.sin(angle).alias("hour_sin"),
        F.cos(angle).alias("hour_cos"),
        (F.log1p("tokens_used") / 10).alias("tokens_log"),
        F.col("success").cast("double").alias("success"),
        *CHANGES,
        _index(F.col("asn_type"), ASN_TYPES).alias("asn_idx"),
        _index(F.col("endpoint"), endpoints).alias("endpoint_idx"),
        expr.delta_bucket(F.col("delta")).alias("gap"),
        F.col("content").cast("int").alias("content"),
    )


def transitions(encoded: DataFrame, piece: int = PIECE) -> DataFrame:
    """Each event with the gap bucket and content of the event after it; the last event has none."""
    w = Window.partitionBy(*KEY, "_piece").orderBy("pos")
    rows = _pieces(encoded.select(*KEY, "pos", "ts", "gap", "content"), 1, piece)
    rows = rows.withColumns({"next_gap": F.lead("gap").over(w), "next_content": F.lead("content").over(w)})
    return rows.filter(F.col("_own") & F.col("next_gap").isNotNull()).drop("_piece", "_own")


STATE = ["gap", "content"]


@dataclass(frozen=True)
class TransitionModel:
    """Transition counts of normal accounts; at most 8 * 32 states, whatever the size of the log."""

    totals: DataFrame  # gap, content, total
    gaps: DataFrame  # gap, content, next_gap, n_gap
    contents: DataFrame  # gap, content, next_content, n_content


def transition_model(steps: DataFrame, normals: DataFrame) -> TransitionModel:
    """Count transitions of the accounts in ``normals`` (user_id).

    The joint counts are at most (8 * 32)^2 rows and feed three marginals and every scoring job, so
    they are written once.
    """
    rows = join_grown(steps, normals.select(*KEY), KEY, "left_semi")
    counts = rows.groupBy(*STATE, "next_gap", "next_content").agg(F.count("*").alias("n"))
    counts = cut_lineage(counts, "transitions")
    total = lambda keys, name: counts.groupBy(*keys).agg(F.sum("n").alias(name))
    return TransitionModel(
        total(STATE, "total"), total([*STATE, "next_gap"], "n_gap"), total([*STATE, "next_content"], "n_content")
    )


def transition_table(model: TransitionModel) -> DataFrame:
    """The model as rows (head, gap, content, next, n, total, p) with add-one smoothing."""
    heads = [
        ("gap", model.gaps.withColumnsRenamed({"next_gap": "next", "n_gap": "n"}), expr.DELTA_BUCKETS),
        ("content", model.contents.withColumnsRenamed({"next_content": "next", "n_content": "n"}), CONTENT_BUCKETS),
    ]
    parts = [
        rows.join(F.broadcast(model.totals), STATE).select(
            F.lit(head).alias("head"), *STATE, "next", "n", "total",
            ((F.col("n") + 1) / (F.col("total") + size)).alias("p"),
        )
        for head, rows, size in heads
    ]
    return parts[0].unionByName(parts[1])


def event_surprise(steps: DataFrame, model: TransitionModel) -> DataFrame:
    """-log p of each next gap and next content; unseen transitions get the smoothed floor.

    The three model tables hold at most 8 * 32 * 32 rows, so they are broadcast.
    """
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    loss = lambda n, size: -F.log((zero(n) + 1) / (zero("total") + size))
    joined = (
        steps.join(F.broadcast(model.totals), STATE, "left")
        .join(F.broadcast(model.gaps), [*STATE, "next_gap"], "left")
        .join(F.broadcast(model.contents), [*STATE, "next_content"], "left")
    )
    surprise = loss("n_gap", expr.DELTA_BUCKETS) + loss("n_content", CONTENT_BUCKETS)
    return joined.select(*KEY, "pos", "ts", surprise.alias("surprise"))


def surprise_spike(surprise: DataFrame, width: int = SMOOTH, piece: int = PIECE) -> DataFrame:
    """Peak minus median of the moving average, and the time of the peak, per account.

    Accounts with fewer than two widths of scored transitions get 0 and no time. The score is exact; only to name
    the peak are averages compared at nine digits, so that windows that are equal but for rounding tie and the
    earliest wins.
    """
    w = Window.partitionBy(*KEY, "_piece").orderBy("pos")
    window = w.rowsBetween(0, width - 1)
    rows = _pieces(surprise, width, piece).withColumns(
        {
            "_avg": F.avg("surprise").over(window),
            "_rows": F.count("*").over(window),
            "_at": F.lead("ts", width // 2 + 1).over(w),
        }
    )
    rows = rows.filter("_own").select(*KEY, "pos", "_at", F.when(F.col("_rows") == width, F.col("_avg")).alias("_avg"))
    rows = cut_lineage(rows, "windows")  # read for the peaks and for the medians
    named = F.when(F.col("_avg").isNotNull(), F.struct(F.round("_avg", 9), -F.col("pos")))
    peaks = rows.groupBy(*KEY).agg(F.count("*").alias("transitions"), F.max("_avg").alias("_peak"), F.max_by("_at", named).alias("_when"))
    middles = group_quantiles(rows, KEY, "_avg", {}, "_middle")
    enough = F.col("transitions") >= 2 * width
    return peaks.join(middles, KEY, "left").select(
        *KEY,
        "transitions",
        F.when(enough, F.col("_peak") - F.col("_middle")).otherwise(F.lit(0.0)).alias("spike_score"),
        F.coalesce(F.when(enough, F.col("_when")), F.lit(0)).cast("long").alias("spike_ts"),
    )


def pooled_sequence(encoded: DataFrame, endpoints: list[str] = ENDPOINTS, piece: int = PIECE) -> DataFrame:
    """One row per account: mean and last value of each numeric column, category shares, and the
    frequency of each gap bucket after each gap bucket. ``endpoints`` are those of the encoding."""
    after = F.lead("gap").over(Window.partitionBy(*KEY, "_piece").orderBy("pos"))
    rows = _pieces(encoded, 1, piece).withColumn("_after", after).filter("_own")
    means = [F.avg(c).alias(f"mean_{c}") for c in NUMERIC]
    last = F.max_by(F.struct(*NUMERIC), "pos").alias("_last")
    shares = [
        F.expr(f"avg(if({col} = {i}, 1D, 0D)) as share_{col}_{i}")
        for col, n in (("asn_idx", len(ASN_TYPES)), ("endpoint_idx", len(endpoints)), ("gap", expr.DELTA_BUCKETS))
        for i in range(n)
    ]
    moves = [
        F.expr(f"avg(if(gap = {a} and _after = {b}, 1D, 0D)) as move_{a}_{b}")
        for a in range(expr.DELTA_BUCKETS)
        for b in range(expr.DELTA_BUCKETS)
    ]
    pooled = rows.groupBy(*KEY).agg(F.count("*").alias("length"), *means, last, *shares, *moves)
    return pooled.select(
        *KEY, "length", *[f"mean_{c}" for c in NUMERIC], *[F.col(f"_last.{c}").alias(f"last_{c}") for c in NUMERIC],
        *[c for c in pooled.columns if c.startswith(("share_", "move_"))],
    )


def localisation_error(accounts: DataFrame, spikes: DataFrame, width: int = SMOOTH) -> DataFrame:
    """Median distance in hours between the spike and the known takeover, over scored thieves.

    The distances are counted per second of distance before they are ordered.
    """
    thieves = accounts.filter(F.col("label") == "token_thief").select(*KEY, "takeover_ts")
    scored = join_grown(thieves, spikes.filter(F.col("transitions") >= 2 * width), KEY).select(
        F.lit(1).alias("_all"), F.abs(F.col("spike_ts") - F.col("takeover_ts")).alias("_seconds")
    )
    scored = cut_lineage(scored, "distances")
    middle = group_quantiles(scored, ["_all"], "_seconds", {}, "_median").select("_median").scalar()
    return scored.agg(F.count("*").alias("accounts")).withColumn("median_hours", middle / 3600.0)
