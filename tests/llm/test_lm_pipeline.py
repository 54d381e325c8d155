"""Language-model scores and the corpus pipeline."""

import collections
import math
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from tallyward.llm import attention, lm_scores, quality, secrets
from tallyward.llm.queries import QUERIES, tokenizer
from tests.llm.helpers import SF, awkward, clashing, doc, documents, empty, prose

WORD = re.compile("[^\x20\x09-\x0d]+")


@pytest.fixture(scope="module")
def small():
    """A model trained on texts in which most tokens follow from the one before."""
    rng = np.random.default_rng(0)
    texts = []
    for _ in range(60):
        t = [int(rng.integers(40))]
        while len(t) < 150:
            t.append((t[-1] * 7 + 3) % 40 if rng.random() < 0.8 else int(rng.integers(40)))
        texts.append(np.array(t, np.int32))
    counts = np.bincount(np.concatenate(texts), minlength=51)
    counts[50] = len(texts)
    model = attention.Model(*attention.classes_of(counts, 20))
    parts = [attention.windows(t, model.edge) for t in texts[:50]]
    attention.train(model, *(np.concatenate(p) for p in zip(*parts)), epochs=12)
    return model, texts, counts


def test_classes_are_a_distribution():
    counts = np.array([1000, 500, 3, 2, 1, 0, 0, 0])
    cls, inside = attention.classes_of(counts, 4)
    for c in range(4):
        assert math.isclose(np.exp(inside[cls == c]).sum(), 1, rel_tol=1e-5)


@pytest.mark.parametrize("n", [0, 1, 31, 32, 33, 63, 64, 65, 200])
def test_windows_score_each_token_once(n):
    ids = np.arange(n, dtype=np.int32)
    inputs, targets, first = attention.windows(ids, 999)
    assert targets[targets >= 0].tolist() == [*range(n), 999]
    for w in range(len(inputs)):
        seen = inputs[w][first[w] :]
        at = w * attention.STRIDE
        want = [999, *range(n)][max(0, at - (attention.WINDOW - attention.STRIDE)) : at + attention.STRIDE]
        assert seen[: len(want)].tolist() == want


def test_model_is_causal_and_normalised(small):
    model, texts, _ = small
    inputs, targets, first = attention.windows(texts[55], model.edge)
    before = model.log_probs(inputs, targets, first)
    changed = inputs.copy()
    changed[:, attention.WINDOW - 1] = 7  # only the last position can tell
    after = model.log_probs(changed, targets, first)
    assert np.allclose(before[:, :-1], after[:, :-1], atol=1e-5)
    each = np.zeros(1)
    for token in range(51):
        t = np.full_like(targets, -1)
        t[0, 3] = token
        each += np.exp(model.log_probs(inputs, t, first)[0, 3])
    assert abs(each[0] - 1) < 1e-3


def test_fast_scores_equal_the_forward_pass(small):
    model, texts, _ = small
    inputs, targets, first = attention.windows(texts[7], model.edge)
    logits = model.forward(inputs, first)[-1].astype(np.float64)
    logits -= np.log(np.exp(logits).sum(2, keepdims=True))
    ids = np.where(targets >= 0, targets, 0)
    want = np.take_along_axis(logits, model.cls[ids][:, :, None], 2)[:, :, 0] + model.inside[ids]
    assert np.allclose(model.log_probs(inputs, targets, first), np.where(targets >= 0, want, 0), atol=1e-3)


def test_attention_beats_frequencies_on_held_out_texts(small):
    model, texts, counts = small
    p = np.log10((counts + 0.5) / (counts + 0.5).sum())
    plain = sum(p[t].sum() + p[50] for t in texts[50:])
    assert model.score(texts[50:]).sum() > plain


def test_gradients_agree_with_differences(small):
    model, texts, _ = small
    w = {k: v.astype(np.float64) for k, v in model.weights.items()}
    exact = attention.Model(model.cls, model.inside, w)
    inputs, targets, first = attention.windows(texts[3][:40], model.edge)

    def loss():
        logits = exact.forward(inputs, first)[-1]
        logits = logits - np.log(np.exp(logits).sum(2, keepdims=True))
        real = targets >= 0
        return -np.take_along_axis(logits, exact.cls[np.where(real, targets, 0)][:, :, None], 2)[:, :, 0][real].mean()

    grads = attention.gradients(exact, inputs, targets, first)
    for name in w:
        at = np.unravel_index(np.argmax(np.abs(grads[name])), grads[name].shape)
        old = w[name][at]
        w[name][at] = old + 1e-5
        up = loss()
        w[name][at] = old - 1e-5
        down = loss()
        w[name][at] = old
        assert math.isclose((up - down) / 2e-5, grads[name][at], rel_tol=0.02, abs_tol=1e-4), name


def test_steps_take_the_gradients(small):
    model, texts, _ = small
    inputs, targets, first = (np.concatenate(p) for p in zip(*[attention.windows(t[: 40 + k], model.edge) for k, t in enumerate(texts[:9])]))
    steps, want = attention.Steps(model, 0.001), attention.gradients(model, inputs, targets, first)
    steps.take(inputs, targets, first)
    assert set(want) == set(model.weights)
    assert all(np.allclose(steps.first[name], 0.1 * g, rtol=1e-3, atol=1e-6) for name, g in want.items())


def plain_logits(model, inputs, first):
    """The network written out, window by window, in double precision."""
    w = {k: v.astype(np.float64) for k, v in model.weights.items()}
    out = []
    for ids, start in zip(inputs, first):
        x = w["id"][ids] + w["class"][model.cls[ids]] + w["place"]
        near = x[attention.NEAR]
        a = near @ w["q"] @ (x @ w["k"]).T / math.sqrt(attention.DIM)
        places = np.arange(attention.WINDOW)
        a = np.where((places[None] > attention.NEAR[:, None]) | (places[None] < start), -np.inf, a)
        a = np.exp(a - a.max(1, keepdims=True))
        mixed = a / a.sum(1, keepdims=True) @ (x @ w["v"])
        top = near + np.maximum(np.hstack([near, mixed @ w["o"]]) @ w["up"], 0) @ w["down"]
        out.append(top @ w["out"] + w["bias"])
    return np.array(out)


@pytest.mark.parametrize("times", [1, 4, 30])
def test_passes_equal_the_network_written_out(small, times):
    # with large products of queries and keys, those of positions that are not seen may be the largest by far
    model, texts, _ = small
    large = {k: v * times if k in ("q", "k", "out") else v for k, v in model.weights.items()}
    model = attention.Model(model.cls, model.inside, large)
    inputs, targets, first = (np.concatenate(p) for p in zip(*[attention.windows(t[: 40 + k], model.edge) for k, t in enumerate(texts[:9])]))
    logits = plain_logits(model, inputs, first)
    size = np.abs(logits).max()
    assert np.abs(model.forward(inputs, first)[-1] - logits).max() < 2e-3 * size
    norm = np.log(np.exp(logits - logits.max(2, keepdims=True)).sum(2)) + logits.max(2)
    ids = np.where(targets >= 0, targets, 0)
    want = np.take_along_axis(logits, model.cls[ids][:, :, None], 2)[:, :, 0] - norm + model.inside[ids]
    assert np.abs(model.log_probs(inputs, targets, first) - np.where(targets >= 0, want, 0)).max() < 2e-3 * max(1, size)
    assert all(np.isfinite(g).all() for g in attention.gradients(model, inputs, targets, first).values())


def brute_base(rows):
    words = {k: [x.encode() for x in WORD.findall("".join(c.lower() if c < "\x80" else c for c in t or ""))] + [b"\xff"] for k, (_, t) in enumerate(rows)}
    counts, held = collections.Counter(), {}
    for k, (i, _) in enumerate(rows):
        held[k] = zlib.crc32(str("" if i is None else i).encode()) % 5 == 1
        if not held[k]:
            counts.update(words[k])
    n, v = sum(counts.values()), len(counts)
    return [
        (i, held[k], len(words[k]), sum(counts[x] > 0 for x in words[k]), n, sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in words[k]))
        for k, (i, _) in enumerate(rows)
    ]


def same(found, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[5])
    found = sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in found), key=key)
    assert len(found) == len(want)
    for a, b in zip(found, sorted(want, key=key)):
        assert a[:5] == b[:5] and math.isclose(a[5], b[5], rel_tol=1e-9)


def score(df, **more):
    import public_tokenizers

    return lm_scores.score_documents(df, tokenizer("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, train_limit=60, **more).collect()


def test_base_scores_equal_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    found = QUERIES["op5_lm_scoring"](spark, SF).collect()
    same(found, brute_base(rows))
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in found)


def test_small_blocks_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(lm_scores, "BLOCK_TOKENS", 100)
    rows = [(k, prose(k % 7, 30 + k)) for k in range(30)]
    same(score(documents(spark, *[doc(i, t) for i, t in rows])), brute_base(rows))


def test_pieces_of_words_are_bounded_by_words(spark):
    words = np.unique(np.random.default_rng(0).integers(0, 1 << 64, size=500, dtype=np.uint64))
    rows = [(b, lm_scores.pack(words), lm_scores.pack(np.full(len(words), b + 1, np.int64))) for b in range(3)]
    stored = spark.createDataFrame(rows, "block long, words binary, counts binary")
    for parts in (1, 2, 7, 100_000):
        got = lm_scores.word_totals(stored, parts).toPandas()
        assert len(got) <= 3 * min(parts, len(words))
        assert (got["n"].sum(), got["v"].sum()) == (6 * len(words), len(words))
        for _, own in got.sort_values("part").groupby("block"):
            assert np.concatenate([lm_scores.unpack(b, np.int64) for b in own["totals"]]).tolist() == [6] * len(words)


def test_changes_are_averaged_on_any_number_of_levels(spark, monkeypatch):
    monkeypatch.setattr(lm_scores, "BRANCH", 3)
    one = lambda task: (task % 2, task, lm_scores.pack(np.array([1.0])), lm_scores.pack(np.array([float(task), 2.0])))
    changes = spark.createDataFrame([one(t) for t in range(100)], "slice int, task long, times binary, change binary")
    got = {r["slice"]: r for r in lm_scores.averaged(changes).collect()}
    assert sorted(got) == [0, 1]
    for k, r in got.items():
        assert lm_scores.unpack(r["times"], np.float64).tolist() == [50.0]
        assert lm_scores.unpack(r["change"], np.float64).tolist() == [sum(range(k, 100, 2)), 100.0]


def test_awkward_documents(spark):
    for df in (awkward(spark), clashing(awkward(spark))):
        found = score(df)
        same(found, brute_base([(r["doc_id"], r["text"]) for r in df.collect()]))
        assert all(math.isfinite(r["score"]) for r in found)
    assert score(empty(spark)) == []


def test_model_learns_from_every_window(spark, monkeypatch):
    import public_tokenizers

    path, pattern = tokenizer("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    with open(path, "rb") as f:
        ranks = spark.sparkContext.broadcast(f.read())
    tool = lm_scores.encoding(ranks.value, pattern)
    # more windows than a document gave to the sample before, and a rare ending that only its last window has
    rows = [(k, prose(k, 40)) for k in range(40)] + [(2000, prose(99, 4000) + " \u4f60\u597d\u4e16\u754c"), (None, None)]
    ids = [tool.encode_ordinary(t or "") for i, t in rows if zlib.crc32(str("" if i is None else i).encode()) % 5 != 1]
    assert max(map(len, ids)) > 50 * attention.STRIDE
    counts = np.bincount(np.concatenate([*map(np.array, ids)]).astype(int), minlength=tool.n_vocab + 1)
    model = attention.Model(*attention.classes_of(counts))
    model.start()
    before = {k: v.copy() for k, v in model.weights.items()}
    df = documents(spark, *[doc(i, t) for i, t in rows]).repartition(5)
    assert lm_scores.train_on_all(df, "doc_id", "text", model, ranks, pattern) == sum(len(x) + 1 for x in ids)
    moved = np.abs(model.weights["id"] - before["id"]).max(1) > 0
    assert (moved[: tool.n_vocab] == (counts[: tool.n_vocab] > 0)).mean() > 0.999 and moved[counts > 0].mean() > 0.95
    assert all(np.abs(v - before[k]).max() > 0 and np.isfinite(v).all() for k, v in model.weights.items())
    # the scoring job itself trains on as many
    seen = []
    whole = lm_scores.train_on_all
    monkeypatch.setattr(lm_scores, "train_on_all", lambda *a: seen.append(whole(*a)))
    score(df)
    assert seen == [sum(len(x) + 1 for x in ids)]


def test_subwords_are_cut_once(spark):
    import public_tokenizers

    path, pattern = tokenizer("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    with open(path, "rb") as f:
        ranks = spark.sparkContext.broadcast(f.read())
    tool = lm_scores.encoding(ranks.value, pattern)
    for df in (awkward(spark), clashing(awkward(spark)), empty(spark)):
        rows = [(r["doc_id"], r["text"] or "") for r in df.collect()]
        want = [(i, zlib.crc32(str("" if i is None else i).encode()) % 5 == 1, tool.encode_ordinary(t)) for i, t in rows]
        stored = lm_scores.written(lm_scores.subword_ids(df, "doc_id", "text", ranks, pattern), "ids")
        found = [(r["doc"], r["held_out"], lm_scores.unplanes(bytes(r["ids"])).tolist()) for r in stored.collect()]
        key = lambda r: (r[0] is None, r[0] or 0, len(r[2]))
        assert sorted(found, key=key) == sorted(want, key=key)
        counts = np.zeros(tool.n_vocab + 1, np.int64)
        for _, held, ids in want:
            if not held:
                counts += np.bincount([*ids, tool.n_vocab], minlength=len(counts))
        assert lm_scores.subword_counts(stored, len(counts)).tolist() == counts.tolist()
        # training and scores need nothing but these
        model = attention.Model(*attention.classes_of(counts))
        model.start()
        assert lm_scores.train_on_all(None, "doc_id", "text", model, None, pattern, stored) == counts.sum()
        scores = sorted(r["score"] for r in lm_scores.model_scores(stored, model).collect())
        assert np.allclose(scores, sorted(model.score([np.array(ids, np.int32) for _, _, ids in want])), rtol=1e-5)


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    whole = {r["doc_id"]: r for r in docs.collect()}
    after = docs
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, after, SF)
        out.write.parquet(f"{tmp_path}/{len(seen)}")
        after = spark.read.parquet(f"{tmp_path}/{len(seen)}")
        seen.append(after.collect())
    good, single, clean, mix, encoded = seen
    want = {i for i, r in whole.items() if quality.first_rejection(quality.Document(r["text"]), list(quality.RULES)) is None}
    assert {r["doc_id"] for r in good} == want
    from tests.llm.test_groups import brute_components

    smallest, _ = brute_components([(r["doc_id"], r["text"]) for r in good], 5, 80, 100)
    assert sorted(r["doc_id"] for r in single) == sorted(set(smallest.values()))
    assert {r["doc_id"] for r in clean} == {r["doc_id"] for r in mix} == {r["doc_id"] for r in encoded} == {r["doc_id"] for r in single}
    for r in clean:
        before = whole[r["doc_id"]]["text"]
        if not secrets.base_spans(before) and "[secret]" not in r["text"]:
            assert r["text"] == before
        assert not secrets.base_spans(r["text"]) and r["n_chars"] == len(r["text"])
    assert all(list(x[0].asDict()) == docs.columns for x in (good, single, clean, mix))
    assert sorted(map(tuple, mix)) == sorted(map(tuple, clean))


def test_the_result_carries_the_mix(spark):
    from tallyward.llm import mixing
    from tallyward.llm.queries import TARGETS

    weights = {"src0": 6, "src1": 2}
    assert all(TARGETS[s] == w for s, w in weights.items())
    # one hot source, ten times the other
    docs = documents(spark, *[doc(k, prose(k, 6), "src1" if k % 11 == 0 else "src0") for k in range(1100)])
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    (_, mix), (_, last) = corpus_pipeline.STAGES[3:]
    found = last(spark, mix(spark, docs, SF), SF).collect()
    assert len(found) == len(source) and len({r["position"] for r in found}) == len(source)
    order = [source[r["doc_id"]] for r in sorted(found, key=lambda r: r["position"])]
    # while both last, shares follow the weights within a block, not the sizes
    for n in range(32, 400):
        assert abs(order[:n].count("src1") - n * 2 / 8) < mixing.BLOCK
    want = {(r["doc_id"], r["slot"], r["block"], r["position"]) for r in mixing.mix_sources(docs, TARGETS).collect()}
    assert {(r["doc_id"], r["slot"], r["block"], r["position"]) for r in found} == want


def test_pipeline_on_awkward_and_empty_tables(spark):
    for df in (awkward(spark), empty(spark)):
        after = df.withColumn("slot", df["doc_id"])
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, after, SF)
            after = spark.createDataFrame(out.collect(), out.schema)
        assert after.count() <= df.count()
