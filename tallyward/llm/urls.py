"""URL filters: host and path rules, and a character language-model ratio for all other urls.

Two variable-order Markov models over the characters of host and path are smoothed by Witten-Bell
interpolation: a context passes as much weight to the next shorter one as it has seen different next
characters, so rare contexts fall back and frequent ones decide. One model is counted on the urls that a
rule accepts, one on those that a rule rejects. A url's score is the mean over its characters of the
difference of log likelihoods. The threshold is calibrated on a fifth of the ruled urls, which is left out
of the counts: it minimises the sum of both error rates over a fixed scale of scores.

Only DataFrame functions are used. All counts are taken from the distinct longest grams, so a url's text is
shuffled only as its grams, pre-aggregated, and once more to look up their scores.

Defined results: a null url, or one without "://", has an empty host and path, no rule and the score 0 of no
characters; very long urls are read whole; repeated rows are judged alike and returned each; ties with the
threshold are allowed; without ruled urls of both kinds the threshold is 0; an empty table gives an empty
result. Only the two named columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyward.llm.lineage import written

# Fixed values: (verdict, host, path).
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
ORDER = 4
BINS = 1000
WIDTH = 0.01
PAD = "\x02"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path of a url."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    tail = F.substr(rest, F.length(host) + F.lit(1))
    return F.translate(host, CAPITALS, CAPITALS.lower()), F.regexp_extract(tail, "^[^?#]*", 0)


def ruled(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """Rule (longest that fits, else null) and its verdict."""
    rule = verdict = F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, F.lit(h + p)).otherwise(rule)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def _grams(urls: DataFrame) -> DataFrame:
    """One row per character: the gram that ends with it, padded at the front."""
    text = F.concat(F.lit(PAD * ORDER), F.col("host"), F.col("path"))
    places = F.sequence(F.lit(1), F.length(text) - ORDER)
    return urls.filter(F.length(text) > ORDER).withColumn("gram", F.explode(F.transform(places, lambda i: F.substr(text, i, F.lit(ORDER + 1)))))


def _smoothed(counts: DataFrame) -> DataFrame:
    """(gram, delta): difference of log probabilities of the last character, from (gram, good, bad).

    A gram of k + 1 characters is a context of k and the next character. Counts of all shorter grams come from one
    aggregation over the ends of the longest ones, counts of contexts from one over those, and the orders of each
    longest gram are folded from the shortest to the longest.
    """
    ends = F.transform(F.sequence(F.lit(1), F.lit(ORDER + 1)), lambda n: F.substr("gram", F.lit(ORDER + 2) - n, n))
    shorter = counts.select(F.explode(ends).alias("g"), "good", "bad")
    seen = shorter.groupBy("g").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    seen = seen.withColumn("c", F.substr("g", F.lit(1), F.length("g") - 1))
    contexts = seen.groupBy("c").agg(
        F.sum("good").alias("n_good"), F.sum("bad").alias("n_bad"), F.count_if(F.col("good") > 0).alias("t_good"),
        F.count_if(F.col("bad") > 0).alias("t_bad"), F.count(F.lit(1)).alias("v"),
    )
    stats = seen.join(contexts, "c").select("g", F.struct(F.length("g").alias("k"), "good", "bad", "n_good", "n_bad", "t_good", "t_bad", "v").alias("s"))
    orders = counts.select("gram", F.explode(ends).alias("g")).join(stats, "g").groupBy("gram").agg(F.sort_array(F.collect_list("s")).alias("s"))

    def folded(kind: str) -> Column:
        def step(p: Column, s: Column) -> Column:
            n, total, kinds = (s[x].cast("double") for x in (kind, f"n_{kind}", f"t_{kind}"))
            first = (n + 0.5) / (total + 0.5 * s["v"])
            return F.when(s["k"] == 1, first).when(total == 0, p).otherwise((n + kinds * p) / (total + kinds))

        return F.aggregate("s", F.lit(0.0), step)

    return orders.select("gram", (F.ln(folded("good")) - F.ln(folded("bad"))).alias("delta"))


def threshold(scored: DataFrame) -> float:
    """The score that best parts held-out accepted from rejected urls: one row per bin of a fixed scale."""
    bin_ = F.greatest(F.lit(-BINS), F.least(F.lit(BINS), F.floor(F.col("score") / WIDTH))).alias("b")
    rows = scored.groupBy(bin_).agg(F.count_if(F.col("verdict") == "allow").alias("good"), F.count_if(F.col("verdict") == "block").alias("bad"))
    bins = sorted((r["b"], r["good"], r["bad"]) for r in rows.collect())  # at most 2 BINS + 1 rows
    good, bad = sum(b[1] for b in bins), sum(b[2] for b in bins)
    if not good or not bad:
        return 0.0
    best, at, lost, passed = math.inf, 0.0, 0, bad
    for b, g, r in bins:  # errors when this bin's lower edge is the threshold
        errors = lost / good + passed / bad
        if errors < best:
            best, at = errors, b * WIDTH
        lost, passed = lost + g, passed - r
    return at


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """One row per row: (id, host, path, rule, verdict, score)."""
    host, path = split_url(F.col(f"`{url_col}`"))
    urls = pages.select(F.col(f"`{id_col}`").alias("id"), host.alias("host"), path.alias("path"))
    rule, verdict = ruled(F.col("host"), F.col("path"), rules)
    held = F.pmod(F.crc32(F.concat("host", "path").cast("binary")), F.lit(5)) == 1
    urls = urls.select("id", "host", "path", rule.alias("rule"), verdict.alias("ruled"), held.alias("held"))
    # urls are scored once each, however many rows repeat them
    distinct = urls.select("host", "path", "ruled", "held").distinct()
    grams = _grams(distinct)
    count = lambda kind: F.count_if((F.col("ruled") == kind) & ~F.col("held"))
    counts = written(grams.groupBy("gram").agg(count("allow").alias("good"), count("block").alias("bad")), "grams")
    model = written(_smoothed(counts), "deltas")
    scores = grams.select("host", "path", "ruled", "held", "gram").join(model, "gram")
    scores = written(scores.groupBy("host", "path", "ruled", "held").agg(F.avg("delta").alias("score")), "scores")
    at = threshold(scores.filter(F.col("held") & F.col("ruled").isNotNull()).withColumnRenamed("ruled", "verdict"))
    out = urls.join(scores.select("host", "path", "score"), ["host", "path"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    by_model = F.when(F.col("score") >= at, F.lit("allow")).otherwise(F.lit("block"))
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("ruled", by_model).alias("verdict"), "score")
