"""Account features: one row per account with 32 behaviour columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyward.functions import expr
from tallyward.operators.entropy import group_entropy
from tallyward.operators.quantile import group_quantiles
from tallyward.operators.skew import RANGE, in_ranges, previous_row
from tallyward.sources.tables import with_prompt_key

KEY = ["user_id"]
ORDER = ["ts", "event_id"]
FAST_SECONDS = 10
NIGHT_HOURS = 6

# Columns that describe or label an account and must never reach a learner.
NON_FEATURES = [
    "user_id", "label", "label_noisy", "subtype", "ring_id", "username", "created_at", "signup_country",
    "payment_hash", "takeover_ts", "first_ts", "last_ts", "tz_offset", "evasion",
]
# Counts that are 0, not missing, for an account without events.
ZERO_FILLED = [
    "n_events", "active_days", "n_ips", "n_asns", "n_countries", "n_devices", "n_uas", "tokens_total",
    "max_events_1h",
]
DISTINCT = {
    "n_ips": "ip",
    "n_asns": "asn",
    "n_countries": "country",
    "n_devices": "device_fp",
    "n_uas": "user_agent",
}


def _deltas(rows: DataFrame) -> DataFrame:
    out = previous_row(in_ranges(rows, KEY, ORDER, "log"), ["ts"])
    return out.withColumn("delta", F.col("ts") - F.col("_prev.ts")).drop(RANGE)


def _row_aggregates(chat: str) -> list[Column]:
    """Aggregates that combine on the map side: a busy account costs one row per task, not a task.

    Hour and gap histograms have closed category sets, so they are plain conditional counts.
    """
    hours = [F.expr(f"count_if(_hod = {h}) as _h{h}") for h in range(24)]
    gaps = [F.expr(f"count_if(_bucket = {b}) as _d{b}") for b in range(expr.DELTA_BUCKETS)]
    return [
        F.count("*").alias("n_events"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
        F.sum(F.col("_new_day").cast("long")).alias("active_days"),
        expr.rate(F.col("asn_type") == "datacenter").alias("dc_frac"),
        expr.rate(F.col("_hod") < NIGHT_HOURS).alias("night_frac"),
        F.avg("prompt_len").alias("mean_prompt_len"),
        F.avg("tokens_used").alias("tokens_mean"),
        F.sum("tokens_used").alias("tokens_total"),
        expr.rate(F.col("success")).alias("success_rate"),
        F.avg("delta").alias("delta_mean"),
        F.stddev_samp("delta").alias("delta_std"),
        expr.rate(F.col("delta") < FAST_SECONDS).alias("frac_fast"),
        expr.rate(F.col("endpoint") == chat).alias("chat_frac"),
        *hours,
        *gaps,
        F.expr("count_if(delta is null) as _dnull"),
    ]


def _row_columns(rows: DataFrame) -> DataFrame:
    """Per-request values read by the aggregates; needs ``_prev``."""
    ts, before = F.col("ts"), F.col("_prev.ts")
    rows = rows.withColumn("delta", ts - before)
    return rows.withColumns(
        {
            "_hod": expr.hour_of_day(ts),
            "_bucket": expr.delta_bucket(F.col("delta")),
            # in time order each new day shows once, so active days need no distinct
            "_new_day": before.isNull() | (expr.day_number(ts) != expr.day_number(before)),
        }
    )


def _with_entropies(agg: DataFrame) -> DataFrame:
    """Entropies over closed category sets, from the count columns of the same aggregate."""
    hours = [f"_h{h}" for h in range(24)]
    gaps = [f"_d{b}" for b in range(expr.DELTA_BUCKETS)] + ["_dnull"]
    out = agg.withColumns({"hour_entropy": expr.entropy_of_counts(hours), "timing_entropy": expr.entropy_of_counts(gaps)})
    return out.drop(*hours, *gaps)


def _ordered(rows: DataFrame, chat: str) -> DataFrame:
    """All features that need the order of the log; accounts of any size.

    The log is dealt once. Gaps and counts come from its windows, peaks from hourly counts, and the quantiles of both
    amounts and gaps from one table of counts per value.
    """
    log = in_ranges(rows, KEY, ORDER, "log")
    ev = _row_columns(previous_row(log, ["ts"]))
    base = _with_entropies(ev.groupBy(*KEY).agg(*_row_aggregates(chat)))
    kinds = {"tokens": "tokens_used", "gaps": "delta"}
    pairs = [F.struct(F.lit(k).alias("_kind"), F.col(c).cast("double").alias("_value")) for k, c in kinds.items()]
    long = ev.select(*KEY, F.inline(F.array(*pairs)))
    found = group_quantiles(long, [*KEY, "_kind"], "_value", {"p10": 10, "p90": 90, "p95": 95}, "median")
    of = lambda kind, col: F.max(F.when(F.col("_kind") == kind, F.col(col)))
    quantiles = found.groupBy(*KEY).agg(
        of("tokens", "p95").cast(rows.schema["tokens_used"].dataType).alias("tokens_p95"), of("gaps", "median").alias("delta_median"),
        of("gaps", "p10").cast("long").alias("delta_p10"), of("gaps", "p90").cast("long").alias("delta_p90"),
    )
    return base.join(hourly_peak(log.df), KEY, "left").join(quantiles, KEY, "left")


def hourly_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("user_id", expr.hour_bucket(F.col("ts")).alias("hour_bucket")).agg(F.count("*").alias("events"))


def hourly_peak(events: DataFrame) -> DataFrame:
    return hourly_counts(events).groupBy(*KEY).agg(F.max("events").alias("max_events_1h"))


def distinct_counts(events: DataFrame) -> DataFrame:
    """Exact distinct counts per account.

    Requests are first reduced to the distinct infrastructure tuples of an account, which are few;
    prompts have a branch of their own because they are nearly as many as the requests. Both
    reductions combine before their shuffle and shuffle by (account, value).
    """
    ev = with_prompt_key(events)
    tuples = ev.select(*KEY, *DISTINCT.values()).distinct()
    infra = tuples.groupBy(*KEY).agg(*[F.count_distinct(c).alias(name) for name, c in DISTINCT.items()])
    prompts = ev.groupBy(*KEY, "prompt_key").agg(F.count("*").alias("_c"))
    dup = prompts.groupBy(*KEY).agg(
        (F.lit(1.0) - expr.ratio(F.count("prompt_key"), F.sum("_c"))).alias("dup_prompt_frac")
    )
    return infra.join(dup, KEY)


SKETCH_BITS = 12


def distinct_sketches(events: DataFrame, bits: int = SKETCH_BITS) -> DataFrame:
    """(user_id, day, one sketch per counted column): a table to keep; sketches of any days and tables merge."""
    ev = with_prompt_key(events).withColumn("day", expr.day_number(F.col("ts")))
    cols = {**DISTINCT, "n_prompts": "prompt_key"}
    kind = {c: ev.schema[c].dataType for c in cols.values()}
    value = lambda c: F.col(c) if isinstance(kind[c], (T.StringType, T.BinaryType)) else F.col(c).cast("long")
    return ev.groupBy(*KEY, "day").agg(*[F.hll_sketch_agg(value(c), F.lit(bits)).alias(name) for name, c in cols.items()])


def distinct_from_sketches(sketches: DataFrame, keys: Sequence[str] = ("user_id",)) -> DataFrame:
    """Approximate distinct counts by ``keys`` over all days of ``sketches``; filter days before for a range of them."""
    names = [*DISTINCT, "n_prompts"]
    return sketches.groupBy(*keys).agg(*[F.hll_sketch_estimate(F.hll_union_agg(c)).alias(c) for c in names])


def distinct_counts_approx(events: DataFrame, bits: int = SKETCH_BITS) -> DataFrame:
    """Opt-in sketch version of the distinct counts; the relative error is about 0.83 / sqrt(2 ** bits)."""
    return distinct_from_sketches(distinct_sketches(events, bits))


def behaviour(activity: DataFrame, chat_endpoint: str = "/v1/chat") -> DataFrame:
    """Per-account behaviour of every account with events."""
    ev = with_prompt_key(activity)
    rows = ev.select(*KEY, *ORDER, "asn_type", "endpoint", "success", "tokens_used", "prompt_len")
    ordered = _ordered(rows, chat_endpoint)
    std, mean = F.col("delta_std"), F.col("delta_mean")
    return ordered.join(distinct_counts(ev), KEY, "left").withColumns(
        {
            "events_per_active_day": expr.ratio(F.col("n_events"), F.col("active_days")),
            "delta_cv": expr.ratio(std, mean),
            "burstiness": expr.ratio(std - mean, std + mean),
        }
    )


def account_features(activity: DataFrame, accounts: DataFrame, chat_endpoint: str = "/v1/chat") -> DataFrame:
    """Every account, with or without events, joined to its behaviour."""
    newest = activity.agg(F.max("ts")).scalar()
    day = F.lit(float(expr.DAY))
    out = accounts.join(behaviour(activity, chat_endpoint), KEY, "left")
    return out.withColumns(
        {
            "account_age_days": (newest - F.col("created_at")) / day,
            "dormancy_days": (F.col("first_ts") - F.col("created_at")) / day,
        }
    ).fillna(0, subset=ZERO_FILLED)


def timing_profile(activity: DataFrame) -> DataFrame:
    """Inter-event statistics of every account."""
    ev = _deltas(activity.select(*KEY, *ORDER))
    delta = F.col("delta")
    base = ev.groupBy(*KEY).agg(
        F.avg(delta).alias("delta_mean"),
        F.stddev_samp(delta).alias("delta_std"),
        expr.rate(delta < FAST_SECONDS).alias("frac_fast"),
    )
    gaps = group_quantiles(ev, KEY, "delta", {"delta_p10": 10, "delta_p90": 90}, "delta_median")
    std, mean = F.col("delta_std"), F.col("delta_mean")
    return base.join(gaps, KEY, "left").withColumns(
        {"delta_cv": expr.ratio(std, mean), "burstiness": expr.ratio(std - mean, std + mean)}
    )


def timing_entropy(activity: DataFrame) -> DataFrame:
    ev = _deltas(activity.select(*KEY, *ORDER))
    return group_entropy(ev.withColumn("bucket", expr.delta_bucket(F.col("delta"))), KEY, "bucket", "timing_entropy")


def hour_entropy(activity: DataFrame) -> DataFrame:
    ev = activity.select(*KEY, expr.hour_of_day(F.col("ts")).alias("hour"))
    return group_entropy(ev, KEY, "hour", "hour_entropy")


def feature_columns(features: DataFrame, exclude: Sequence[str] = NON_FEATURES) -> list[str]:
    """Numeric columns minus identity, label and helper columns."""
    return [f.name for f in features.schema.fields if f.name not in exclude and isinstance(f.dataType, T.NumericType)]


def label_profile(features: DataFrame) -> DataFrame:
    mean = lambda c, d: F.round(F.avg(c), d).alias(c)
    return (
        features.groupBy("label")
        .agg(
            F.count("*").alias("accounts"),
            mean("n_events", 1),
            mean("delta_cv", 2),
            mean("dup_prompt_frac", 3),
            mean("n_devices", 2),
        )
        .orderBy("label")
    )


def activity_summary(activity: DataFrame, accounts: DataFrame) -> DataFrame:
    """Events, active users and users per label.

    Requests are counted per account before the join, so the join moves one row per account.
    """
    per_user = activity.groupBy(*KEY).agg(F.count("*").alias("_events"))
    joined = accounts.select(*KEY, "label").join(per_user, KEY, "left")
    return joined.groupBy("label").agg(
        F.coalesce(F.sum("_events"), F.lit(0)).alias("events"),
        F.count("_events").alias("active_users"),
        F.count("*").alias("users"),
    ).orderBy("label")
