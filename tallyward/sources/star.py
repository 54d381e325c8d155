"""Canonical views over the star-schema test tables.

The tables hold orders, documents and a click stream; these views give them the column names and
types of an activity log with its accounts, so that every operator runs on whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyward.operators.campaign import CLUSTERS, attach_clusters
from tallyward.operators.content import ROUNDS, ContentModel, content, fit_content, nearest, read_content
from tallyward.sources.schema import ASN_TYPES, GIVEN
from tallyward.sources.stages import StageStore
from tallyward.sources.tables import read_table

# How the market segments stand for account labels.
SEGMENT_LABEL = {
    "AUTOMOBILE": "spam_bot",
    "BUILDING": "normal",
    "FURNITURE": "account_farmer",
    "HOUSEHOLD": "prompt_sprayer",
    "MACHINERY": "token_thief",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, lazily; raises before any work starts when a column is absent or has another type."""
    return read_table(spark, f"{sf_dir}/{name}.parquet", GIVEN[name])


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Activity rows without the prompt."""
    return shape_events(table(spark, sf_dir, "events"))


def shape_events(raw: DataFrame) -> DataFrame:
    """Event columns of the activity log from the click-stream table, batch or streaming."""
    k = F.get_json_object("props", "$.k").cast("int")
    asn_type = F.element_at(F.array(*[F.lit(a) for a in ASN_TYPES]), k % 5 + 1)
    part = lambda n: F.floor(k / n).cast("long")
    return raw.select(
        "event_id",
        "user_id",
        F.unix_timestamp("ts").alias("ts"),
        F.concat(F.lit("ip"), k).alias("ip"),
        part(5).alias("asn"),
        asn_type.alias("asn_type"),
        F.concat(F.lit("c"), part(25)).alias("country"),
        F.concat(F.lit("fp"), part(10)).alias("device_fp"),
        F.concat(F.lit("ua"), k % 4).alias("user_agent"),
        F.col("event_type").alias("endpoint"),
        F.col("value").alias("tokens_used"),
        (F.col("event_type") != "error").alias("success"),
    )


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Activity rows with the prompt of each request, its digest and its length.

    Digest and length are taken once per document, before the join, and the text itself is read
    only by queries that ask for it.
    """
    docs = table(spark, sf_dir, "documents")
    prompts = docs.select(
        F.col("doc_id").alias("prompt_id"),
        F.col("text").alias("prompt_text"),
        F.unhex(F.sha2("text", 256)).alias("prompt_key"),
        F.length("text").alias("prompt_len"),
    )
    n_docs = docs.agg(F.count("*")).scalar()
    rows = events(spark, sf_dir).withColumn("prompt_id", F.col("event_id") % n_docs)
    return rows.join(prompts, "prompt_id", "left").drop("prompt_id")


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    first_order = (
        table(spark, sf_dir, "orders")
        .groupBy(F.col("o_custkey").alias("user_id"))
        .agg(F.unix_timestamp(F.min("o_orderdate")).alias("created_at"))
    )
    return people(spark, sf_dir).join(first_order, "user_id", "left")


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The accounts without ``created_at``, for queries that don't ask for it: they need not read the orders."""
    key = F.col("c_custkey")
    label = F.col("c_mktsegment")
    for segment, name in SEGMENT_LABEL.items():
        label = F.when(F.col("c_mktsegment") == segment, name).otherwise(label)
    normal = F.col("c_mktsegment") == "BUILDING"
    return table(spark, sf_dir, "customer").select(
        key.alias("user_id"),
        label.alias("label"),
        F.when(F.col("c_acctbal") < 0, "debtor").otherwise("regular").alias("subtype"),
        F.when(~normal & (key % 4 == 0), F.concat(F.lit("ring"), F.floor(key / 40).cast("long"))).alias("ring_id"),
        F.col("c_name").alias("username"),
        F.concat(F.lit("n"), F.col("c_nationkey")).alias("signup_country"),
        F.when(key % 5 >= 2, F.concat(F.lit("pay"), F.floor(key / 3).cast("long"))).alias("payment_hash"),
        (F.col("c_nationkey").cast("double") - 12).alias("tz_offset"),
        F.when(F.col("c_mktsegment") == "MACHINERY", F.lit(1704067200) + (key % 20 + 5) * 86400)
        .cast("long")
        .alias("takeover_ts"),
        F.when(normal, F.lit(0.0)).otherwise((key % 101) / F.lit(100.0)).alias("evasion"),
        F.when(key % 37 == 0, "normal").otherwise(label).alias("label_noisy"),
    )


def purchase_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Account graph: accounts that bought the same part on one ship date (as 'ip') or the same
    quantity from one supplier on one ship date (as 'device'), and shared payment instruments."""
    lines = (
        table(spark, sf_dir, "lineitem")
        .join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .select(
            F.col("o_custkey").alias("user_id"),
            F.concat_ws("-", F.col("l_partkey"), F.unix_date(F.to_date("l_shipdate"))).alias("ip"),
            F.element_at(F.array(*[F.lit(a) for a in ASN_TYPES]), (F.col("l_partkey") % 5 + 1).cast("int")).alias(
                "asn_type"
            ),
            F.concat_ws(
                "-", F.col("l_suppkey"), F.unix_date(F.to_date("l_shipdate")), F.col("l_quantity").cast("int")
            ).alias("device_fp"),
        )
    )
    return lines


def shared_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document graph: (doc_id as user_id, digest of each non-empty line as ip); some lines are very common."""
    return (
        table(spark, sf_dir, "documents")
        .select(F.col("doc_id").alias("user_id"), F.explode(F.split("text", "\n")).alias("line"))
        .filter(F.length("line") > 0)
        .select("user_id", F.sha2("line", 256).alias("ip"))
    )


def text_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Given vectors standing for distinct prompts, in given clusters: (text_id, embedding, cluster)."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("text_id"),
        "embedding",
        (F.col("label") * 1000 + F.floor(F.col("vec_id") / 25)).cast("long").alias("cluster"),
    )


def prompt_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each request with the vector of its prompt; an account uses few vectors, repeatedly."""
    n = table(spark, sf_dir, "embeddings").agg(F.count("*")).scalar()
    return table(spark, sf_dir, "events").select(
        "event_id",
        "user_id",
        ((F.col("user_id") * 3 + F.col("event_id") % 3) % n).alias("text_id"),
        F.col("event_type").alias("prompt_cluster"),
    )


def content_model(spark: SparkSession, sf_dir: str) -> ContentModel:
    """Centroids learned from the vectors of the distinct prompts; fitted once and stored."""
    vectors = lambda: text_vectors(spark, sf_dir)
    store = StageStore(spark, [f"{sf_dir}/embeddings.parquet"])
    return read_content(store.table("centroids", lambda: fit_content(vectors()), k=CLUSTERS, rounds=ROUNDS))


def content_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(text_id, cluster, content): learned group and content state of every prompt."""
    group = nearest(content_model(spark, sf_dir), F.col("embedding")).alias("cluster")
    rows = text_vectors(spark, sf_dir).select("text_id", group)
    return rows.withColumn("content", content(F.col("cluster")))


def sequence_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Activity rows with the content state of their prompt, as learned from its vector."""
    groups = content_groups(spark, sf_dir).select("text_id", "content")
    prompts = prompt_events(spark, sf_dir).select("event_id", "text_id")
    known = attach_clusters(prompts, groups, how="inner").select("event_id", "content")
    return events(spark, sf_dir).join(known, "event_id")


def scored_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as a scored population: truth from quality, score from length."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "source", "lang")
    return (
        table(spark, sf_dir, "labels")
        .join(docs, "doc_id")
        .select(
            F.col("doc_id").alias("user_id"),
            F.col("quality").cast("int").alias("truth"),
            F.col("toxic").cast("int").alias("toxic"),
            F.col("lang"),
            (F.floor(F.col("n_chars") / 20) % 200 / F.lit(200.0)).alias("score"),
            ((F.col("doc_id") * 17 % 101) / F.lit(100.0)).alias("evasion"),
        )
    )


def risk_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accounts with a risk from a fixed formula, for queries over decisions."""
    noise = (F.col("user_id") * 7919 % 1000) / F.lit(1000.0)
    lift = F.when(F.col("label") == "normal", 0.0).otherwise(0.4)
    return accounts(spark, sf_dir).withColumn("risk", F.round(noise * 0.6 + lift, 6))
