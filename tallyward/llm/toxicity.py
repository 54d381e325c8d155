"""Toxicity by multiple-instance learning: documents have labels, sentences do not.

A sentence has a logistic score over its distinct words, each word giving itself and its beginnings as features, so
forms of a word that were never seen count by their stem. A document is toxic if any of its sentences is: noisy-or,
``1 - (1 - leak) * product of (1 - score of a sentence)``, where the leak stands for labels that no sentence explains. The
weights are found by Adam with soft thresholding on the likelihood of the document labels, so the sentences to blame
are found by the fit itself and are reported as spans.

The classifier is fitted on at most ``SAMPLE_DOCS`` labelled rows, chosen by a hash of their ids, of at most ``SAMPLE_CHARS``
characters each. Every text is scored whole. Word scores are remembered per worker, so a text costs a lookup a word.

Defined results: a null or empty text has no sentences and the leak as its score; repeated rows and null ids are
answered row by row; several labels of one id count as their largest; without labels, or with an empty table, every
score is the share of toxic labels (0 without any); labels, ids and other columns are never inputs of a score. Only the
named columns are read.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyward.llm.words import encode

SAMPLE_DOCS = 6000
SAMPLE_CHARS = 20_000
BUCKETS = 1 << 18
STEMS = (4, 5, 6, 7)  # lengths of the beginnings of a word that are features, its edge mark included
STEPS, RATE, SPARSE = 60, 0.15, 2e-5
BLAME = 0.5  # score from which a sentence is reported
CACHE_WORDS = 200_000
END = re.compile("[.!?\n…。！？]+")
EDGES = re.compile(r"^\W+|\W+$")


def features(token: str) -> list[int]:
    """Buckets of a lower-case word and its beginnings; none for signs alone."""
    word = EDGES.sub("", token)
    if not word:
        return []
    marked = f"^{word}$"
    parts = {marked, *(marked[:k] for k in STEMS if k < len(marked))}
    return [zlib.crc32(encode(p)) % BUCKETS for p in parts]


def sentences(text: str) -> list[tuple[int, int]]:
    """Spans of the sentences that have a word."""
    out, at = [], 0
    for m in END.finditer(text):
        out.append((at, m.start()))
        at = m.end()
    out.append((at, len(text)))
    return [(a, b) for a, b in out if text[a:b].strip()]


@dataclass
class Model:
    weights: np.ndarray = field(default_factory=lambda: np.zeros(BUCKETS, np.float32))
    bias: float = -np.inf  # without a fit no sentence adds anything
    leak: float = 0.0


class Words(dict):
    """Score of each word, remembered for at most ``CACHE_WORDS`` words at a time."""

    def __init__(self, weights: np.ndarray):
        super().__init__()
        self.weights = weights

    def __missing__(self, token: str) -> float:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = float(sum(self.weights[k] for k in features(token)))
        if len(token) < 100:
            self[token] = value
        return value


def sentence_scores(text: str, model: Model, words: Words) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Spans and logits of the sentences of a text."""
    spans = sentences(text)
    sums = [sum(map(words.__getitem__, set(text[a:b].lower().split()))) for a, b in spans]
    return spans, model.bias + np.array(sums, np.float64)


def noisy_or(logits: np.ndarray, leak: float) -> float:
    """Probability that any sentence, or the leak, makes a document toxic."""
    return float(-np.expm1(np.log1p(-leak) - np.logaddexp(0, logits).sum()))


def sigmoid(z):
    return np.exp(-np.logaddexp(0, -z))


class Bags:
    """Labelled documents as index arrays: features of words, words of sentences, sentences of documents."""

    def __init__(self, texts: list[str]):
        known: dict[str, int] = {}
        buckets, sizes, tokens, lengths, counts = [], [], [], [], []
        for text in texts:
            spans = sentences(text)
            counts.append(len(spans))
            for a, b in spans:
                distinct = sorted(set(text[a:b].lower().split()))
                lengths.append(len(distinct))
                for w in distinct:
                    k = known.get(w)
                    if k is None:
                        k = known[w] = len(sizes)
                        more = features(w)
                        buckets += more
                        sizes.append(len(more))
                    tokens.append(k)
        self.n_words, self.n_sentences, self.n_docs = len(sizes), len(lengths), len(texts)
        self.bucket, self.token = np.array(buckets, np.int64), np.array(tokens, np.int64)
        self.word = np.repeat(np.arange(len(sizes)), sizes)
        self.sentence = np.repeat(np.arange(len(lengths)), lengths)
        self.doc = np.repeat(np.arange(len(texts)), counts)


def train(texts: list[str], labels: np.ndarray, steps: int = STEPS, rate: float = RATE, sparse: float = SPARSE) -> Model:
    """Weights, bias and leak of the largest likelihood of the document labels, with an absolute penalty on weights."""
    y = np.asarray(labels, np.float64)
    n, positive = len(y), float(np.sum(y))
    if not 0 < positive < n:
        return Model(leak=min(positive / (n + 1), 0.999))
    bags = Bags(texts)
    w, ends = np.zeros(BUCKETS), np.array([-6.0, -3.0])  # bias, logit of the leak
    m, v, me, ve = np.zeros(BUCKETS), np.zeros(BUCKETS), np.zeros(2), np.zeros(2)
    for step in range(1, steps + 1):
        word = np.bincount(bags.word, w[bags.bucket], bags.n_words)
        z = ends[0] + np.bincount(bags.sentence, word[bags.token], bags.n_sentences)
        leak = sigmoid(ends[1])
        clean = np.bincount(bags.doc, -np.logaddexp(0, z), n) + np.log1p(-leak)  # log of the probability of label 0
        toxic = np.maximum(-np.expm1(clean), 1e-12)
        slope = np.where(y == 1, np.exp(clean) / toxic, -1.0) / n  # of the loss, by clean
        dz = slope[bags.doc] * -sigmoid(z)
        dword = np.bincount(bags.token, dz[bags.sentence], bags.n_words)
        g, ge = np.bincount(bags.bucket, dword[bags.word], BUCKETS), np.array([dz.sum(), (slope * -leak).sum()])
        m, v = 0.9 * m + 0.1 * g, 0.98 * v + 0.02 * g * g
        me, ve = 0.9 * me + 0.1 * ge, 0.98 * ve + 0.02 * ge * ge
        scale = np.sqrt(v / (1 - 0.98**step)) + 1e-5
        w -= rate * m / (1 - 0.9**step) / scale
        w = np.sign(w) * np.maximum(np.abs(w) - rate * sparse / scale, 0)
        ends -= rate * me / (1 - 0.9**step) / (np.sqrt(ve / (1 - 0.98**step)) + 1e-8)
    return Model(w.astype(np.float32), float(ends[0]), float(sigmoid(ends[1])))


def fit(
    df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_docs: int = SAMPLE_DOCS,
    sample_chars: int = SAMPLE_CHARS,
) -> Model:
    """Fit on at most ``sample_docs`` labelled rows; ``labels`` has only the rows to learn from."""
    key, mark = F.col(f"`{id_col}`"), F.xxhash64("_id")
    known = labels.filter(F.col(f"`{label_col}`").isNotNull()).groupBy(key.alias("_id")).agg(F.max(f"`{label_col}`").alias("_y"))
    known = known.filter(F.col("_id").isNotNull()).orderBy(mark, "_id").limit(sample_docs)
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = df.select(key.alias("_id"), text.alias("_text")).filter(F.length("_text") <= sample_chars)
    rows = rows.join(F.broadcast(known), "_id")  # at most sample_docs rows
    found = rows.orderBy(mark, "_id", "_text").limit(sample_docs).collect()
    return train([r["_text"] for r in found], np.array([int(r["_y"] == 1) for r in found], np.int64))


def score_documents(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", blame: float = BLAME) -> DataFrame:
    """One row per row: id, score, predicted, n_sentences, n_blamed, and ``spans`` (start:end of sentences scored ``blame`` or more)."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # 1 MB, of fixed size
    key = df.select(f"`{id_col}`").schema.fields[0].dataType.simpleString()
    line = float(np.log(blame / (1 - blame)))

    def read(batches):
        net = shared.value
        words = Words(net.weights)
        for batch in batches:
            found: dict[str, list] = {n: [] for n in ("score", "predicted", "n_sentences", "n_blamed", "spans")}
            for value in batch.column(1):
                spans, logits = sentence_scores(value.as_py() or "", net, words)
                score = noisy_or(logits, net.leak)
                guilty = np.flatnonzero(logits >= line)
                found["score"].append(score)
                found["predicted"].append(int(score >= 0.5))
                found["n_sentences"].append(len(spans))
                found["n_blamed"].append(len(guilty))
                found["spans"].append(",".join(f"{spans[k][0]}:{spans[k][1]}" for k in guilty))
            kinds = [pa.float64(), pa.int32(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, t) for v, t in zip(found.values(), kinds))], names=["_id", *found])

    rows = df.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text"))
    out = rows.mapInArrow(read, f"_id {key}, score double, predicted int, n_sentences long, n_blamed long, spans string")
    return out.withColumnRenamed("_id", id_col)


def fold(id_col: Column) -> Column:
    """crc32 of an id as text, by 5; a null id is the empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 5
