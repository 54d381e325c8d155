"""Per-event sequence signals."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyward.catalog import canon
from tallyward.catalog.registry import DBL, INT, TXT, query, sql
from tallyward.functions import expr
from tallyward.operators import evaluate, review
from tallyward.operators import sequence as seq
from tallyward.operators.split import split_assignment
from tallyward.session import cut_lineage, new_folder
from tallyward.sources import star, tables
from tallyward.sources.schema import ASN_TYPES

KINDS = ["click", "error", "purchase", "signup", "view"]
SHORT_TAIL = 48


@query(
    "event_deltas",
    sql(
        f"{canon.EVENTS}, {canon.DELTAS}",
        "SELECT event_id, user_id, ts, coalesce(delta, 0) AS delta FROM deltas",
        event_id=INT, user_id=INT, ts=INT, delta=INT,
    ),
)
def event_deltas(spark, d):
    return seq.event_deltas(star.events(spark, d)).select("event_id", "user_id", "ts", "delta")


@query(
    "change_flags",
    sql(
        canon.SEQ,
        "SELECT event_id, user_id, ip_chg, dev_chg, cc_chg FROM hist",
        event_id=INT, user_id=INT, ip_chg=DBL, dev_chg=DBL, cc_chg=DBL,
    ),
)
def change_flags(spark, d):
    return seq.event_deltas(star.events(spark, d)).select("event_id", "user_id", *seq.CHANGES)


@query(
    "event_tail",
    sql(
        f"{canon.SEQ}, {canon.tail(SHORT_TAIL)}",
        "SELECT event_id, user_id, ts, pos, delta, ip_chg, dev_chg, cc_chg FROM tail",
        event_id=INT, user_id=INT, ts=INT, pos=INT, delta=INT, ip_chg=DBL, dev_chg=DBL, cc_chg=DBL,
    ),
)
def event_tail(spark, d):
    tail = seq.event_tail(star.events(spark, d), SHORT_TAIL)
    return tail.select("event_id", "user_id", "ts", "pos", "delta", *seq.CHANGES)


def encoded(spark, d):
    return seq.event_encoding(seq.event_history(star.sequence_events(spark, d)), KINDS)


@query(
    "event_encoding",
    sql(
        f"{canon.SEQ}, {canon.tail()}",
        f"""SELECT user_id, event_id, ts, pos, delta, ln(1 + delta) / 14 AS delta_log,
              sin((ts % 86400) / 3600.0 * 2 * pi() / 24) AS hour_sin, cos((ts % 86400) / 3600.0 * 2 * pi() / 24) AS hour_cos,
              ln(1 + tokens_used) / 10 AS tokens_log, cast(success AS integer) AS success, ip_chg, dev_chg, cc_chg,
              list_position({canon.ASN}, asn_type) - 1 AS asn_idx,
              list_position(list_value('click','error','purchase','signup','view'), endpoint) - 1 AS endpoint_idx,
              gap, content FROM tail""",
        user_id=INT, event_id=INT, ts=INT, pos=INT, delta=INT, delta_log=DBL, hour_sin=DBL, hour_cos=DBL,
        tokens_log=DBL, success=DBL, ip_chg=DBL, dev_chg=DBL, cc_chg=DBL, asn_idx=INT, endpoint_idx=INT, gap=INT,
        content=INT,
    ),
)
def event_encoding(spark, d):
    return encoded(spark, d)


def steps(spark, d):
    return seq.transitions(encoded(spark, d))


def model(spark, d, rows=None):
    """Fitted on training accounts whose noisy label is normal."""
    split = split_assignment(star.accounts(spark, d))
    normals = split.filter(~F.col("is_test") & (F.col("label_noisy") == "normal"))
    return seq.transition_model(rows or steps(spark, d), normals)


@query(
    "next_event_targets",
    sql(
        canon.STEPS,
        "SELECT user_id, pos, ts, gap, content, next_gap, next_content FROM steps",
        user_id=INT, pos=INT, ts=INT, gap=INT, content=INT, next_gap=INT, next_content=INT,
    ),
)
def next_event_targets(spark, d):
    return steps(spark, d)


@query(
    "transition_model",
    sql(
        canon.MODEL,
        """SELECT 'gap' AS head, gap, content, next_gap AS next, n_gap AS n, total, (n_gap + 1) / (total + 8) AS p
             FROM gap_n JOIN totals USING (gap, content)
           UNION ALL
           SELECT 'content', gap, content, next_content, n_content, total, (n_content + 1) / (total + 32)
             FROM content_n JOIN totals USING (gap, content)""",
        head=TXT, gap=INT, content=INT, next=INT, n=INT, total=INT, p=DBL,
    ),
)
def transition_model(spark, d):
    return seq.transition_table(model(spark, d))


@query(
    "event_surprise",
    sql(
        canon.SURPRISE, "SELECT user_id, pos, ts, surprise FROM surprise",
        user_id=INT, pos=INT, ts=INT, surprise=DBL,
    ),
)
def event_surprise(spark, d):
    rows = cut_lineage(steps(spark, d), "steps")  # fitted on and scored: the log is ordered once
    return seq.event_surprise(rows, model(spark, d, rows))


def held_out(spark, d):
    """Accounts of the test split; the model was fitted on the others."""
    people = star.accounts(spark, d)
    return people.join(split_assignment(people).filter("is_test").select("user_id"), "user_id", "left_semi")


def spikes(spark, d):
    return seq.surprise_spike(event_surprise(spark, d))


@query(
    "surprise_spike",
    sql(
        canon.SPIKES, "SELECT user_id, transitions, spike_score, spike_ts FROM spikes",
        user_id=INT, transitions=INT, spike_score=DBL, spike_ts=INT,
    ),
)
def surprise_spike(spark, d):
    return spikes(spark, d)


@query(
    "takeover_candidates",
    sql(
        canon.SPIKES,
        """SELECT user_id, takeover_ts, evasion, transitions, spike_score, spike_ts
           FROM accounts JOIN spikes USING (user_id) WHERE label = 'token_thief' AND spike_ts > 0""",
        user_id=INT, takeover_ts=INT, evasion=DBL, transitions=INT, spike_score=DBL, spike_ts=INT,
    ),
)
def takeover_candidates(spark, d):
    return review.takeover_candidates(star.accounts(spark, d), spikes(spark, d))


@query(
    "takeover_localisation",
    sql(
        canon.SPIKES,
        """SELECT count(*) AS accounts, median(abs(spike_ts - takeover_ts) / 3600.0) AS median_hours
           FROM accounts JOIN spikes USING (user_id) JOIN (SELECT user_id, is_test FROM split) USING (user_id)
           WHERE label = 'token_thief' AND transitions >= 32 AND is_test""",
        accounts=INT, median_hours=DBL,
    ),
)
def takeover_localisation(spark, d):
    return seq.localisation_error(held_out(spark, d), spikes(spark, d))


@query(
    "takeover_auc",
    sql(
        canon.SPIKES,
        """SELECT sum(CASE WHEN p.s > n.s THEN 1.0 WHEN p.s = n.s THEN 0.5 ELSE 0 END) / count(*) AS auc
           FROM (SELECT spike_score AS s FROM spikes JOIN split USING (user_id)
                 WHERE is_test AND label = 'token_thief' AND transitions >= 32) p,
                (SELECT spike_score AS s FROM spikes JOIN split USING (user_id)
                 WHERE is_test AND label = 'normal' AND transitions >= 32) n""",
        auc=DBL,
    ),
)
def takeover_auc(spark, d):
    scored = spikes(spark, d).filter("transitions >= 32").join(held_out(spark, d), "user_id")
    pair = scored.filter(F.col("label").isin("token_thief", "normal"))
    return evaluate.roc_auc(pair, "spike_score", F.col("label") == "token_thief").select("auc")


SHARES = {f"share_asn_idx_{i}": f"list_position({canon.ASN}, asn_type) = {i + 1}" for i in range(len(ASN_TYPES))}
SHARES |= {f"share_endpoint_idx_{i}": f"endpoint = '{kind}'" for i, kind in enumerate(KINDS)}
SHARES |= {f"share_gap_{i}": f"gap = {i}" for i in range(expr.DELTA_BUCKETS)}
SHARES |= {
    f"move_{a}_{b}": f"gap = {a} AND after = {b}" for a in range(expr.DELTA_BUCKETS) for b in range(expr.DELTA_BUCKETS)
}


@query(
    "pooled_sequence",
    sql(
        f"{canon.SEQ}, {canon.tail()}, enc AS (SELECT *, ln(1 + delta) / 14 AS delta_log, "
        "sin((ts % 86400) / 3600.0 * 2 * pi() / 24) AS hour_sin, cos((ts % 86400) / 3600.0 * 2 * pi() / 24) AS hour_cos, "
        "ln(1 + tokens_used) / 10 AS tokens_log, lead(gap) OVER (PARTITION BY user_id ORDER BY pos) AS after FROM tail)",
        "SELECT user_id, count(*) AS length, "
        + ", ".join(f"avg(cast({c} AS double)) AS mean_{c}" for c in seq.NUMERIC)
        + ", "
        + ", ".join(f"max(CASE WHEN back = 1 THEN cast({c} AS double) END) AS last_{c}" for c in seq.NUMERIC)
        + ", "
        + ", ".join(f"avg(CASE WHEN {test} THEN 1.0 ELSE 0.0 END) AS {name}" for name, test in SHARES.items())
        + " FROM enc GROUP BY 1",
        user_id=INT, length=INT, **{f"mean_{c}": DBL for c in seq.NUMERIC}, **{f"last_{c}": DBL for c in seq.NUMERIC},
        **dict.fromkeys(SHARES, DBL),
    ),
)
def pooled_sequence(spark, d):
    return seq.pooled_sequence(encoded(spark, d), KINDS)


@query(
    "content_buckets",
    """WITH RECURSIVE bits(n, i, c) AS (
         SELECT n, 0, CAST(n AS bigint) FROM range(256) t(n)
         UNION ALL SELECT n, i + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END FROM bits WHERE i < 8),
       entry AS (SELECT n, c FROM bits WHERE i = 8),
       names AS (SELECT vec_id AS text_id, 'cluster-' || (vec_id // 25) AS name FROM embeddings),
       walk(text_id, name, i, c) AS (
         SELECT text_id, name, 1, 4294967295 FROM names
         UNION ALL SELECT text_id, name, w.i + 1, xor(w.c // 256, e.c) FROM walk w
           JOIN entry e ON e.n = xor(w.c % 256, ascii(substr(name, w.i, 1))) WHERE w.i <= length(name))
       SELECT CAST(text_id AS bigint) AS text_id, CAST(xor(c, 4294967295) % 32 AS bigint) AS content
       FROM walk WHERE i = length(name) + 1""",
)
def content_buckets(spark, d):
    """Names of text clusters as one of 32 contents, by the checksum that the SQL computes bit by bit."""
    name = F.concat(F.lit("cluster-"), F.floor(F.col("vec_id") / 25).cast("long"))
    rows = star.table(spark, d, "embeddings")
    return rows.select(F.col("vec_id").alias("text_id"), seq.content_bucket(name).alias("content"))


@query(
    "events_between",
    sql(
        canon.EVENTS,
        "SELECT event_id, user_id, ts FROM ev WHERE ts >= (SELECT min(ts) FROM ev) + 86400 AND ts < (SELECT min(ts) FROM ev) + 5 * 86400 + 7",
        event_id=INT, user_id=INT, ts=INT,
    ),
)
def events_between(spark, d):
    """The log written by day and read back for a range of time; other days are not opened."""
    rows = star.events(spark, d)
    folder = new_folder(spark, "by-day")
    tables.write_events_by_day(rows, folder)
    start = rows.agg(F.min("ts")).first()[0]
    return tables.read_events_between(spark, folder, start + 86400, start + 5 * 86400 + 7).select("event_id", "user_id", "ts")
