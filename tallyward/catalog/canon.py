"""The canonical views of ``sources.star`` restated as SQL common table expressions."""

ASN = "list_value('residential','mobile','datacenter','university','corporate')"

EVENTS = f"""
keyed AS (SELECT *, cast(regexp_extract(props, '([0-9]+)') AS integer) AS k FROM events),
ev AS (
  SELECT event_id, user_id, cast(floor(epoch(ts)) AS bigint) AS ts,
    'ip' || k AS ip, cast(k // 5 AS bigint) AS asn, {ASN}[k % 5 + 1] AS asn_type,
    'c' || (k // 25) AS country, 'fp' || (k // 10) AS device_fp, 'ua' || (k % 4) AS user_agent,
    event_type AS endpoint, value AS tokens_used, event_type <> 'error' AS success
  FROM keyed)"""

ACTIVITY = f"""{EVENTS},
activity AS (
  SELECT ev.*, d.text AS prompt_text FROM ev LEFT JOIN documents d
    ON d.doc_id = ev.event_id % (SELECT count(*) FROM documents))"""

ACCOUNTS = """
first_order AS (SELECT o_custkey, cast(epoch(min(o_orderdate)) AS bigint) AS created_at FROM orders GROUP BY 1),
people AS (
  SELECT c.*, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'spam_bot' WHEN 'BUILDING' THEN 'normal'
    WHEN 'FURNITURE' THEN 'account_farmer' WHEN 'HOUSEHOLD' THEN 'prompt_sprayer'
    WHEN 'MACHINERY' THEN 'token_thief' ELSE c_mktsegment END AS label FROM customer c),
accounts AS (
  SELECT c_custkey AS user_id, label,
    CASE WHEN c_acctbal < 0 THEN 'debtor' ELSE 'regular' END AS subtype,
    CASE WHEN label <> 'normal' AND c_custkey % 4 = 0 THEN 'ring' || (c_custkey // 40) END AS ring_id,
    c_name AS username, 'n' || c_nationkey AS signup_country,
    CASE WHEN c_custkey % 5 >= 2 THEN 'pay' || (c_custkey // 3) END AS payment_hash,
    cast(c_nationkey AS double) - 12 AS tz_offset,
    CASE WHEN label = 'token_thief' THEN 1704067200 + (c_custkey % 20 + 5) * 86400 END AS takeover_ts,
    CASE WHEN label = 'normal' THEN 0.0 ELSE cast(c_custkey % 101 AS double) / 100 END AS evasion,
    CASE WHEN c_custkey % 37 = 0 THEN 'normal' ELSE label END AS label_noisy, created_at
  FROM people LEFT JOIN first_order ON o_custkey = c_custkey)"""

DELTAS = """
deltas AS (
  SELECT *, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS delta FROM ev)"""

BUCKETS = """
bucketed AS (
  SELECT *, CASE WHEN delta IS NOT NULL
    THEN least(greatest(floor(log10(greatest(cast(delta AS double), 1.0))), 0), 7) END AS bucket FROM deltas)"""

# nearest-rank quantiles over non-null values, integer rank arithmetic
GAP_QUANTILES = """
gap_rank AS (
  SELECT user_id, delta, row_number() OVER (PARTITION BY user_id ORDER BY delta) AS r,
    count(*) OVER (PARTITION BY user_id) AS n FROM deltas WHERE delta IS NOT NULL),
gap_q AS (
  SELECT user_id,
    max(CASE WHEN r = 1 + (10 * (n - 1) + 50) // 100 THEN delta END) AS delta_p10,
    max(CASE WHEN r = 1 + (90 * (n - 1) + 50) // 100 THEN delta END) AS delta_p90,
    median(delta) AS delta_median FROM gap_rank GROUP BY 1)"""

TOKEN_QUANTILES = """
token_rank AS (
  SELECT user_id, tokens_used, row_number() OVER (PARTITION BY user_id ORDER BY tokens_used) AS r,
    count(*) OVER (PARTITION BY user_id) AS n FROM ev),
token_q AS (
  SELECT user_id,
    max(CASE WHEN r = 1 + (95 * (n - 1) + 50) // 100 THEN tokens_used END) AS tokens_p95
  FROM token_rank GROUP BY 1)"""


def entropy(name: str, source: str, category: str, out: str) -> str:
    return f"""
{name}_c AS (SELECT user_id, {category} AS cat, count(*) AS c FROM {source} GROUP BY 1, 2),
{name}_p AS (SELECT user_id, c / sum(c) OVER (PARTITION BY user_id) AS p FROM {name}_c),
{name} AS (SELECT user_id, sum(-p * ln(p)) AS {out} FROM {name}_p GROUP BY 1)"""


HOUR_ENTROPY = entropy("hour_e", "ev", "(ts % 86400) // 3600", "hour_entropy")
TIMING_ENTROPY = entropy("timing_e", "bucketed", "bucket", "timing_entropy")

PEAK = """
peak_c AS (SELECT user_id, ts // 3600 AS h, count(*) AS c FROM ev GROUP BY 1, 2),
peak AS (SELECT user_id, max(c) AS max_events_1h FROM peak_c GROUP BY 1)"""

FEATURES = f"""{ACTIVITY}, {ACCOUNTS}, {DELTAS}, {BUCKETS}, {GAP_QUANTILES}, {TOKEN_QUANTILES},
{HOUR_ENTROPY}, {TIMING_ENTROPY}, {PEAK},
base AS (
  SELECT user_id, count(*) AS n_events, min(ts) AS first_ts, max(ts) AS last_ts,
    count(DISTINCT ts // 86400) AS active_days, count(DISTINCT ip) AS n_ips, count(DISTINCT asn) AS n_asns,
    count(DISTINCT country) AS n_countries, count(DISTINCT device_fp) AS n_devices,
    count(DISTINCT user_agent) AS n_uas,
    avg(CASE WHEN asn_type = 'datacenter' THEN 1.0 ELSE 0.0 END) AS dc_frac,
    avg(CASE WHEN (ts % 86400) // 3600 < 6 THEN 1.0 ELSE 0.0 END) AS night_frac,
    1 - count(DISTINCT prompt_text) / count(*) AS dup_prompt_frac,
    avg(length(prompt_text)) AS mean_prompt_len, avg(tokens_used) AS tokens_mean,
    sum(tokens_used) AS tokens_total, avg(CASE WHEN success THEN 1.0 ELSE 0.0 END) AS success_rate,
    avg(CASE WHEN endpoint = 'view' THEN 1.0 ELSE 0.0 END) AS chat_frac
  FROM activity GROUP BY 1),
gaps AS (
  SELECT user_id, avg(delta) AS delta_mean, stddev_samp(delta) AS delta_std,
    avg(CASE WHEN delta < 10 THEN 1.0 WHEN delta >= 10 THEN 0.0 END) AS frac_fast
  FROM deltas GROUP BY 1),
features AS (
  SELECT a.*, coalesce(n_events, 0) AS n_events, first_ts, last_ts, coalesce(active_days, 0) AS active_days,
    coalesce(n_ips, 0) AS n_ips, coalesce(n_asns, 0) AS n_asns, coalesce(n_countries, 0) AS n_countries,
    coalesce(n_devices, 0) AS n_devices, coalesce(n_uas, 0) AS n_uas, dc_frac, night_frac, dup_prompt_frac,
    mean_prompt_len, tokens_mean, tokens_p95, coalesce(tokens_total, 0) AS tokens_total, success_rate,
    delta_mean, delta_median, delta_std, delta_p10, delta_p90, frac_fast, chat_frac,
    coalesce(max_events_1h, 0) AS max_events_1h, hour_entropy, timing_entropy,
    n_events / nullif(active_days, 0) AS events_per_active_day, delta_std / nullif(delta_mean, 0) AS delta_cv,
    (delta_std - delta_mean) / nullif(delta_std + delta_mean, 0) AS burstiness,
    ((SELECT max(ts) FROM ev) - created_at) / 86400.0 AS account_age_days,
    (first_ts - created_at) / 86400.0 AS dormancy_days
  FROM accounts a LEFT JOIN base USING (user_id) LEFT JOIN gaps USING (user_id)
    LEFT JOIN gap_q USING (user_id) LEFT JOIN token_q USING (user_id) LEFT JOIN peak USING (user_id)
    LEFT JOIN hour_e USING (user_id) LEFT JOIN timing_e USING (user_id))"""


PROMPTS = """
pe AS (
  SELECT event_id, user_id, (user_id * 3 + event_id % 3) % (SELECT count(*) FROM embeddings) AS text_id,
    event_type AS prompt_cluster FROM events)"""

# checksum of short names, bit by bit
CRC = """
bits(n, i, c) AS (
  SELECT n, 0, CAST(n AS bigint) FROM range(256) t(n)
  UNION ALL SELECT n, i + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END FROM bits WHERE i < 8),
entry AS (SELECT n, c FROM bits WHERE i = 8),
group_names AS (SELECT g AS cluster, CAST(g AS varchar) AS name FROM range(97) t(g)),
walk(cluster, name, i, c) AS (
  SELECT cluster, name, 1, 4294967295 FROM group_names
  UNION ALL SELECT cluster, name, w.i + 1, xor(w.c // 256, e.c) FROM walk w
    JOIN entry e ON e.n = xor(w.c % 256, ascii(substr(name, w.i, 1))) WHERE w.i <= length(name)),
group_content AS (SELECT cluster, xor(c, 4294967295) % 32 AS content FROM walk WHERE i = length(name) + 1)"""


def _round(i: int) -> str:
    """Each vector's nearest centroid, then the mean directions."""
    return f"""
near_{i} AS MATERIALIZED (
  SELECT text_id, cluster FROM (
    SELECT text_id, cluster, row_number() OVER (PARTITION BY text_id ORDER BY list_dot_product(u, m) DESC, cluster) AS r
    FROM unit_vec, cent_{i}) WHERE r = 1),
mean_{i} AS (
  SELECT cluster, list(x ORDER BY place) AS v FROM (
    SELECT cluster, place, sum(x) AS x FROM (
      SELECT cluster, unnest(u) AS x, generate_subscripts(u, 1) AS place FROM near_{i} JOIN unit_vec USING (text_id)) GROUP BY 1, 2) GROUP BY 1),
cent_{i + 1} AS MATERIALIZED (
  SELECT c.cluster, coalesce(list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))), m) AS m
  FROM cent_{i} c LEFT JOIN mean_{i} USING (cluster))"""


CONTENT_ROUNDS = 4
CENTROIDS = f"""
wide_vec AS (SELECT vec_id AS text_id, CAST(embedding AS double[]) AS v FROM embeddings),
unit_vec AS MATERIALIZED (SELECT text_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS u FROM wide_vec),
cent_0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256(CAST(text_id AS varchar)), text_id) - 1 AS cluster, u AS m
  FROM unit_vec QUALIFY cluster < 96),{",".join(_round(i) for i in range(CONTENT_ROUNDS))}"""

GROUPS = f"""{CENTROIDS},{_round(CONTENT_ROUNDS).split("mean_")[0].rstrip().rstrip(",")}, {CRC},
content_groups AS (
  SELECT text_id, cluster, content FROM near_{CONTENT_ROUNDS} JOIN group_content USING (cluster))"""

SEQ = f"""{EVENTS}, {PROMPTS}, {GROUPS},
sev AS (
  SELECT ev.*, content FROM ev JOIN pe USING (event_id) JOIN content_groups USING (text_id)),
hist AS (
  SELECT *, coalesce(ts - lag(ts) OVER w, 0) AS delta,
    coalesce(cast(ip <> lag(ip) OVER w AS integer), 0) AS ip_chg,
    coalesce(cast(device_fp <> lag(device_fp) OVER w AS integer), 0) AS dev_chg,
    coalesce(cast(country <> lag(country) OVER w AS integer), 0) AS cc_chg,
    row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS back
  FROM sev WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"""


def tail(n: int | None = None) -> str:
    """The last ``n`` events of each account, or all of them."""
    where = f"WHERE back <= {n}" if n else ""
    return f"""
tail AS (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos,
    least(greatest(floor(log10(greatest(cast(delta AS double), 1.0))), 0), 7) AS gap
  FROM hist {where})"""


STEPS = f"""{SEQ}, {tail()},
steps AS (
  SELECT * FROM (SELECT user_id, pos, ts, gap, content, lead(gap) OVER w AS next_gap, lead(content) OVER w AS next_content
    FROM tail WINDOW w AS (PARTITION BY user_id ORDER BY pos)) WHERE next_gap IS NOT NULL)"""

# train/test split: two rounds of a linear congruence, repeated from functions.expr.arithmetic_hash
def split_hash(key: str, seed: int) -> str:
    return f"((({key} % 2147483647 + {seed}) * 1103515245 + 12345) % 2147483647 * 48271 + 11) % 2147483647"


SPLIT = f"""
ranked AS (
  SELECT user_id, label, label_noisy,
    row_number() OVER (PARTITION BY label ORDER BY {split_hash('user_id', 0)}, user_id) AS r,
    count(*) OVER (PARTITION BY label) AS size FROM accounts),
split AS (SELECT user_id, label, label_noisy, r <= (size * 3 + 5) // 10 AS is_test FROM ranked)"""

MODEL = f"""{STEPS}, {ACCOUNTS}, {SPLIT},
normal_steps AS (
  SELECT * FROM steps SEMI JOIN (SELECT user_id FROM split WHERE NOT is_test AND label_noisy = 'normal') USING (user_id)),
totals AS (SELECT gap, content, count(*) AS total FROM normal_steps GROUP BY 1, 2),
gap_n AS (SELECT gap, content, next_gap, count(*) AS n_gap FROM normal_steps GROUP BY 1, 2, 3),
content_n AS (SELECT gap, content, next_content, count(*) AS n_content FROM normal_steps GROUP BY 1, 2, 3)"""

SURPRISE = f"""{MODEL},
surprise AS (
  SELECT user_id, pos, ts,
    -ln((coalesce(n_gap, 0) + 1) / (coalesce(total, 0) + 8)) - ln((coalesce(n_content, 0) + 1) / (coalesce(total, 0) + 32)) AS surprise
  FROM steps LEFT JOIN totals USING (gap, content) LEFT JOIN gap_n USING (gap, content, next_gap)
    LEFT JOIN content_n USING (gap, content, next_content))"""

SPIKES = f"""{SURPRISE},
smooth AS (
  SELECT user_id, avg(surprise) OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 15 FOLLOWING) AS a,
    lead(ts, 9) OVER (PARTITION BY user_id ORDER BY pos) AS peak_at,
    row_number() OVER (PARTITION BY user_id ORDER BY pos) AS i, count(*) OVER (PARTITION BY user_id) AS n
  FROM surprise),
full_windows AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(a, 9) DESC, i) AS best
  FROM smooth WHERE n >= 32 AND i <= n - 15),
peaks AS (SELECT user_id, max(a) - median(a) AS score, max(CASE WHEN best = 1 THEN peak_at END) AS peak_at FROM full_windows GROUP BY 1),
spikes AS (
  SELECT s.user_id, s.n AS transitions, coalesce(p.score, 0) AS spike_score, coalesce(p.peak_at, 0) AS spike_ts
  FROM (SELECT user_id, count(*) AS n FROM surprise GROUP BY 1) s LEFT JOIN peaks p USING (user_id))"""


PURCHASES = f"""
purchases AS (
  SELECT o_custkey AS user_id, l_partkey || '-' || cast(epoch(l_shipdate) AS bigint) // 86400 AS ip,
    {ASN}[l_partkey % 5 + 1] AS asn_type,
    l_suppkey || '-' || cast(epoch(l_shipdate) AS bigint) // 86400 || '-' || cast(l_quantity AS integer) AS device_fp
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""

EDGES = f"""{ACCOUNTS}, {PURCHASES},
edges AS (
  SELECT user_id, 'ip' AS etype, ip AS entity_id, count(*) AS weight, min(asn_type) AS asn_type FROM purchases GROUP BY 1, 2, 3
  UNION ALL SELECT user_id, 'device', device_fp, count(*), NULL FROM purchases GROUP BY 1, 2, 3
  UNION ALL SELECT user_id, 'payment', payment_hash, 1, NULL FROM accounts WHERE payment_hash IS NOT NULL)"""

LINE_EDGES = """
edges AS (
  SELECT DISTINCT doc_id AS user_id, 'ip' AS etype, sha256(line) AS entity_id
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE length(line) > 0)"""

CAP = " AND (etype <> 'ip' OR fanout <= 10)"
LINKS = f"""
fanout AS (SELECT etype, entity_id, count(DISTINCT user_id) AS fanout, min(user_id) AS hub FROM edges GROUP BY 1, 2),
linking AS (SELECT * FROM fanout WHERE fanout >= 2{CAP}),
links AS (SELECT DISTINCT etype, entity_id, user_id AS src, hub AS dst FROM edges JOIN linking USING (etype, entity_id) WHERE user_id <> hub)"""

# reachability by a recursive union: fine for small components only
COMPONENTS = """
both_ways AS (SELECT src AS a, dst AS b FROM links UNION SELECT dst, src FROM links),
reach(a, b) AS (SELECT a, a FROM both_ways UNION SELECT r.a, w.b FROM reach r JOIN both_ways w ON r.b = w.a),
components AS (SELECT a AS id, min(b) AS component_id FROM reach GROUP BY 1)"""

RINGS = """
sizes AS (SELECT component_id, count(*) AS size FROM components GROUP BY 1),
rings AS (
  SELECT user_id, label, coalesce(component_id, user_id) AS component_id, coalesce(size, 1) AS component_size,
    coalesce(size, 1) >= 5 AS ring_flag
  FROM accounts LEFT JOIN components ON id = user_id LEFT JOIN sizes USING (component_id))"""

VECTORS = """
vec AS (SELECT vec_id AS text_id, embedding, label * 1000 + vec_id // 25 AS cluster FROM embeddings),
dims AS (SELECT text_id, cluster, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM vec),
norms AS (SELECT text_id, sqrt(sum(cast(x AS double) * x)) AS norm FROM dims GROUP BY 1),
unit AS (SELECT text_id, cluster, i, x / norm AS x FROM dims JOIN norms USING (text_id)),
centroid AS (SELECT cluster, i, avg(x) AS m FROM unit GROUP BY 1, 2),
tightness AS (
  SELECT text_id, cluster, sum(x * m) / (sqrt(sum(x * x)) * sqrt(sum(m * m))) AS tight
  FROM unit JOIN centroid USING (cluster, i) GROUP BY 1, 2)"""

CAMPAIGNS = f"""{PROMPTS}, {VECTORS},
clustered AS (SELECT pe.*, cluster, tight FROM pe LEFT JOIN tightness USING (text_id)),
stats AS (
  SELECT cluster, count(*) AS n_events, count(DISTINCT user_id) AS n_accounts, avg(tight) AS tight,
    count(DISTINCT user_id) / (SELECT count(DISTINCT user_id) FROM pe) AS coverage,
    count(*) / count(DISTINCT user_id) AS intensity FROM clustered GROUP BY 1),
campaigns AS (SELECT * FROM stats WHERE tight >= 0.60 AND coverage <= 0.02 AND intensity >= 8)"""

SPRAY = f"""{ACCOUNTS}, {CAMPAIGNS},
hits AS (SELECT user_id, count(*) AS n FROM clustered SEMI JOIN campaigns USING (cluster) GROUP BY 1),
spray AS (
  SELECT a.user_id, label, evasion, coalesce(n, 0) >= 5 AS spray_flag, coalesce(n, 0) AS spray_events
  FROM accounts a LEFT JOIN hits USING (user_id))"""

SCORED = """
scored AS (
  SELECT l.doc_id AS user_id, quality AS truth, toxic, lang, ((n_chars // 20) % 200) / 200.0 AS score,
    (l.doc_id * 17 % 101) / 100.0 AS evasion
  FROM labels l JOIN documents d ON d.doc_id = l.doc_id)"""


def ap(name: str, source: str, score: str, truth: str, keys: str = "") -> str:
    """Average precision in terms of distinct scores, per comma-separated ``keys``."""
    k, g = (f"{keys}, ", f"PARTITION BY {keys}") if keys else ("", "")
    return f"""
{name}_c AS (SELECT {k}{score} AS s, sum(cast({truth} AS bigint)) AS pos, count(*) AS n FROM {source} GROUP BY ALL),
{name}_r AS (
  SELECT *, sum(pos) OVER ({g} ORDER BY s DESC) AS tp, sum(n) OVER ({g} ORDER BY s DESC) AS seen,
    sum(pos) OVER ({g}) AS positives, sum(n) OVER ({g}) AS everyone FROM {name}_c),
{name} AS (
  SELECT {k}max(positives) AS support, max(everyone) AS accounts, sum(pos / nullif(positives, 0) * tp / seen) AS ap
  FROM {name}_r GROUP BY ALL)"""


HALVES = f"""
half_rank AS (
  SELECT user_id, label, label_noisy, is_test,
    row_number() OVER (PARTITION BY is_test ORDER BY {split_hash('user_id', 7)}, user_id) AS r,
    count(*) OVER (PARTITION BY is_test) AS size FROM split),
halves AS (
  SELECT user_id, label, label_noisy, is_test, is_test AND r <= size // 2 AS is_fit,
    is_test AND r > size // 2 AS is_eval FROM half_rank)"""

RISK = f"""{ACCOUNTS}, {SPLIT}, {HALVES},
risks AS (
  SELECT a.*, is_test, is_fit, is_eval,
    round((a.user_id * 7919 % 1000) / 1000.0 * 0.6 + CASE WHEN a.label = 'normal' THEN 0.0 ELSE 0.4 END, 6) AS risk
  FROM accounts a JOIN halves USING (user_id))"""

THRESHOLDS = f"""{RISK},
curve AS (
  SELECT s, sum(p) OVER (ORDER BY s DESC) AS tp, sum(n) OVER (ORDER BY s DESC) AS seen FROM (
    SELECT risk AS s, count(*) FILTER (label_noisy <> 'normal') AS p, count(*) AS n FROM risks WHERE is_fit GROUP BY 1)),
raw AS (
  SELECT coalesce(min(s) FILTER (tp > 0 AND tp / seen >= 0.99), cast('inf' AS double)) AS t1,
    coalesce(min(s) FILTER (tp > 0 AND tp / seen >= 0.90), cast('inf' AS double)) AS t2,
    coalesce(min(s) FILTER (tp > 0 AND tp / seen >= 0.60), cast('inf' AS double)) AS t3 FROM curve),
thr AS (SELECT t1 AS suspend, least(t1, t2) AS challenge, least(t1, t2, t3) AS rate_limit FROM raw)"""

TIERS = f"""{THRESHOLDS},
tiered AS (
  SELECT risks.*, CASE WHEN risk >= suspend THEN 'suspend' WHEN risk >= challenge THEN 'challenge'
    WHEN risk >= rate_limit THEN 'rate_limit' ELSE 'monitor' END AS tier FROM risks, thr)"""
