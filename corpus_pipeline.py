"""A corpus pipeline: quality, near-duplicates, secrets, mix, subwords.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``documents``. The runner writes each result as Parquet and reads it as the next stage's input.

Defined results: rows with null texts fail the quality rules; a row whose near-duplicate group has a smaller id is
dropped, and of rows that repeat an id in one group one stays; texts keep everything but the secrets in them; every
row that reaches the mix is in it once. Further columns of the input pass through the first four stages.

A stored table has no order, and the mix stage may not add columns; so the last stage gives each row its place in the
mix, which follows from the rows alone: ``slot``, ``block`` and ``position``. Readers serve by ``position``; at any
place of it, each source that has not run out is less than one block from its target share.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyward.llm import mixing, pieces, quality, secrets, setsketch
from tallyward.llm.lineage import written
from tallyward.llm.queries import TARGETS, tokenizer


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality cascade."""
    return quality.keep_good(docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each near-duplicate group (runs of five words, similarity 0.8)."""
    return setsketch.one_of_each(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced in their texts."""
    lengths = "n_chars" if "n_chars" in docs.columns else None
    return secrets.redact_documents(docs, secrets.fit(docs), length_col=lengths)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, written in the order of the mix."""
    return mixing.in_order(docs, TARGETS)


def subwords(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the decoded text of each document, and its place in the mix."""
    return pieces.encode_documents(mixing.mix_sources(docs, TARGETS), tokenizer("piece_bpe_32k.model"), keep=mixing.ADDED)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", good_documents),
    ("near-duplicates", one_of_each_group),
    ("secrets", without_secrets),
    ("mix", mixed),
    ("subwords", subwords),
]
# A trained network decides on secrets, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each result written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
