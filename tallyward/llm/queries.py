"""The registered queries of this folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyward.llm import cosine, filter_audit, fixity, licenses, lm_scores, manifest, mixing, pieces, quality, secrets, setsketch, toxicity, urls
from tallyward.llm.lineage import written
from tallyward.llm.registry import ORACLES, QUERIES, query, table
from tallyward.llm.sql import OP12_SQL, OP13_SQL

__all__ = ["ORACLES", "QUERIES"]


def tokenizer(name: str) -> str:
    """Place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op8_sentencepiece_encoding")
def op8(spark, sf_dir):
    return pieces.encode_documents(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


@query("op7_quality_rules")
def op7(spark, sf_dir):
    return quality.quality_report(table(spark, sf_dir, "documents"))


@query("op1_license_scans")
def op1(spark, sf_dir):
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


@query("op2_secret_scans")
def op2(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return secrets.scan_secrets(docs, secrets.fit(docs))


@query("op6_minhash_near_dedup")
def op6(spark, sf_dir):
    """Runs of three words and a similarity of 0.85, as the contract of this query says."""
    return setsketch.near_duplicates(table(spark, sf_dir, "documents"), settings=setsketch.Settings(3, 85, 100))


# Target weights of the sources of the test tables; sources without a name here share the weight 1.
TARGETS = {"src0": 6} | {f"src{k}": 3 - k % 2 for k in range(1, 20)}


@query("op9_mix_sources")
def op9(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return mixing.mix_sources(docs, TARGETS)


@query("op4_url_filters")
def op4(spark, sf_dir):
    return urls.judge_urls(table(spark, sf_dir, "pages"))


@query("op10_embedding_near_dedup")
def op10(spark, sf_dir):
    return cosine.near_vectors(table(spark, sf_dir, "embeddings"))


def _faulty(record, fault):
    """The record as a second replica holds it: a changed byte, a cut, or nothing, where a digest says so."""
    cut = F.substring(record, 1, 40)
    changed = F.concat(F.lit("w"), F.substr(record, F.lit(2)))
    return F.when(fault == "00", changed).when(fault == "01", cut).when(fault != "02", record)


OP3_SQL = """
WITH raw AS (
  SELECT page_id, url, coalesce(html, '') AS body, coalesce(cast(page_id AS varchar), '') AS pid, coalesce(url, '') AS u FROM pages
), rec AS (
  SELECT page_id, md5(pid || ' ' || u) AS k,
    'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || pid || '>' ||
    chr(13) || chr(10) || 'WARC-Target-URI: ' || u || chr(13) || chr(10) || 'Content-Length: ' || cast(octet_length(encode(body)) AS varchar) ||
    chr(13) || chr(10) || chr(13) || chr(10) || body || chr(13) || chr(10) || chr(13) || chr(10) AS r FROM raw
), sized AS (
  SELECT page_id, k, substr(k, 9, 2) AS fault, sha256(r) AS digest, cast(octet_length(encode(r)) AS bigint) AS length FROM rec
), dealt AS (
  SELECT *, cast(cast('0x' || substr(k, 1, 8) AS ubigint) AS bigint) % (SELECT cast(greatest(1, ceil(sum(length) / 1048576.0)) AS bigint) FROM sized) AS archive FROM sized
), placed AS (
  SELECT *, cast(coalesce(sum(length) OVER (PARTITION BY archive ORDER BY k, digest ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bigint) AS "offset" FROM dealt
), l1 AS (
  SELECT archive, "offset" >> 14 AS n, sha256(string_agg(cast("offset" AS varchar) || ':' || digest, ';' ORDER BY "offset", digest)) AS d FROM placed GROUP BY 1, 2
), l2 AS (SELECT archive, n >> 3 AS n, sha256(string_agg(cast(l1.n AS varchar) || ':' || d, ';' ORDER BY l1.n)) AS d FROM l1 GROUP BY 1, 2),
l3 AS (SELECT archive, n >> 3 AS n, sha256(string_agg(cast(l2.n AS varchar) || ':' || d, ';' ORDER BY l2.n)) AS d FROM l2 GROUP BY 1, 2),
root AS (SELECT archive, sha256(string_agg(cast(n AS varchar) || ':' || d, ';' ORDER BY n)) AS root FROM l3 GROUP BY 1)
SELECT page_id, p.archive, "offset", length, digest,
  CASE fault WHEN '00' THEN 'altered' WHEN '01' THEN 'altered' WHEN '02' THEN 'missing' ELSE 'intact' END AS status, root
FROM placed p JOIN root USING (archive)
"""


@query("op3_warc_fixity", OP3_SQL)
def op3(spark, sf_dir):
    """Every page as a record of an archive and of a replica with faults; status of each record after the audit."""
    pages = table(spark, sf_dir, "pages")
    empty = F.lit("")
    key = F.concat_ws(" ", F.coalesce(F.col("page_id").cast("string"), empty), F.coalesce("url", empty))
    record = fixity.warc_record(F.col("page_id"), F.col("url"), F.col("html"))
    other = _faulty(record, F.substring(F.md5(key.cast("binary")), 9, 2))
    rows = pages.select(
        "page_id", key.alias("key"), F.octet_length(record).cast("long").alias("length"), F.sha2(record, 256).alias("digest"),
        F.sha2(other, 256).alias("other"),
    )
    rows = written(fixity.place(written(rows, "records"), F.col("key")).drop("key"), "placed")
    theirs = rows.filter(F.col("other").isNotNull()).select("archive", "offset", F.col("other").alias("digest"))
    checked = fixity.audit_records(rows, fixity.merkle_tree(rows), fixity.merkle_tree(theirs))
    return checked.select("page_id", "archive", "offset", "length", "digest", "status", "root")


@query("op5_lm_scoring")
def op5(spark, sf_dir):
    import public_tokenizers

    return lm_scores.score_documents(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


@query("op11_toxicity")
def op11(spark, sf_dir):
    """Fitted on labels whose fold is not 0."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    fold = toxicity.fold(F.col("doc_id"))
    model = toxicity.fit(docs, labels.filter(fold != 0))
    scored = toxicity.score_documents(docs, model)
    return scored.select("doc_id", (fold == 0).alias("held_out"), "score", "predicted", "n_sentences", "n_blamed", "spans")


@query("op12_merkle_manifest", OP12_SQL)
def op12(spark, sf_dir):
    """The rows checked against the manifest lost the line feeds of their texts where the crc32 of the id is even."""
    docs = table(spark, sf_dir, "documents")
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    unbroken = F.replace(F.col("text"), F.lit("\n"), F.lit(""))
    return manifest.verify_documents(docs, "doc_id", "source", ["doc_id", "source", "lang", "n_chars", "text"], "text", even, unbroken)


@query("op13_filter_audit", OP13_SQL)
def op13(spark, sf_dir):
    return filter_audit.audit_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
