"""Toxicity, the manifest and the filter audit: brute force, edge cases, and the registered queries on whole tables."""

import hashlib
import random
import zlib
from itertools import permutations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyward.llm import filter_audit, manifest, toxicity
from tallyward.llm.queries import ORACLES, QUERIES
from tests.compare import differences
from tests.llm.helpers import SF, awkward, clashing, doc, documents, empty, prose


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, text):
    values = [row["doc_id"], row["source"], row["lang"], row["n_chars"], text]
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def brute_tree(nodes):
    """Levels of a tree, leaves first."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        at = levels[-1]
        levels.append([sha("".join(at[k : k + 3])) for k in range(0, len(at), 3)])
    return levels


def brute_path(levels, at):
    out = []
    for level in levels[:-1]:
        first = at - at % 3
        out.append((level[first:at], level[at + 1 : first + 3]))
        at //= 3
    return out


def brute_manifest(rows):
    order = lambda v: (v is not None, v if v is None or isinstance(v, int) else v.encode())
    groups = {}
    for r in rows:
        groups.setdefault(r["source"], []).append((order(r["doc_id"]), leaf(r, r["text"]), r))
    names = sorted(groups, key=order)
    trees = {}
    for g in names:
        groups[g].sort(key=lambda t: t[:2])
        trees[g] = brute_tree([t[1] for t in groups[g]])
    upper = brute_tree([trees[g][-1][0] for g in names])
    out = []
    for k, g in enumerate(names):
        for at, (_, own, r) in enumerate(groups[g]):
            path = brute_path(trees[g], at) + brute_path(upper, k)
            cut = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0 and r["text"] is not None
            node = leaf(r, r["text"].replace("\n", "")) if cut else own
            for left, right in path:
                node = sha("".join([*left, node, *right]))
            proof = sha("".join("".join([*left, *right]) for left, right in path))
            root = upper[-1][0]
            out.append((r["doc_id"], own, trees[g][-1][0], root, proof, node, node == root))
    return sorted(out, key=repr)


COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def checked(df):
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return manifest.verify_documents(df, "doc_id", "source", COLUMNS, "text", even, F.replace(F.col("text"), F.lit("\n"), F.lit("")))


@pytest.mark.parametrize("sizes", [[1], [1, 2, 3, 4, 9, 10, 26, 27, 28, 81, 82, 250]])
def test_manifest_equals_brute_force(spark, sizes):
    rows = [doc(1000 * g + 7 * k, f"a{k}\nb{g}", None if g == 1 else f"s{g}") for g, n in enumerate(sizes) for k in range(n)]
    random.Random(1).shuffle(rows)
    df = documents(spark, *rows)
    got = checked(df.repartition(5))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute_manifest(df.collect())


def test_manifest_of_awkward_rows(spark):
    df = awkward(spark).union(documents(spark, doc(None, "x", "é"), doc(11, "x", "z"), doc(11, "x", "z"), doc(12, "\n", "")))
    want = brute_manifest(df.collect())
    for rows in (df, clashing(df.repartition(7))):
        assert sorted(map(tuple, checked(rows).collect()), key=repr) == want
    assert checked(empty(spark)).collect() == []


def test_manifest_persists_only_checkpoint_levels(spark):
    rows = spark.range(1000).select(F.col("id").alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("h"))
    tree = manifest.build(rows, F.lit(0), ["k"], "h", ["k"])
    assert [level.count() for level in tree.levels] == [1000, 38, 2]  # levels 0, 3 and 6 of 7


def test_one_changed_row_is_found(spark):
    df = documents(spark, *[doc(k, f"text {k}", f"s{k % 3}") for k in range(100)])
    got = manifest.verify_documents(df, "doc_id", "source", COLUMNS, "text", F.col("doc_id") == 17, F.lit("other"))
    assert [r["doc_id"] for r in got.filter(~F.col("verified")).collect()] == [17]


@pytest.mark.parametrize("name", ["op12_merkle_manifest", "op13_filter_audit"])
def test_query_equals_sql(spark, name):
    assert not differences(spark, SF, QUERIES[name], ORACLES[name])


def brute_audit(rows, labels):
    known = {}
    for d, q, t in labels:
        good, toxic = known.get(d, (False, False))
        known[d] = (good or q == 1, toxic or t == 1)
    texts = {}
    for d, text, _ in rows:
        if d is not None:
            texts[text or ""] = min(d, texts.get(text or "", d))
    fails = []
    for d, text, part in rows:
        text = text or ""
        words = text.encode().split()
        failed = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text),
            "D": any(c in "#$%&*|" for c in text), "E": d is not None and d > texts[text],
        }
        fails.append((part or "", {f for f in failed if failed[f]}, *((False, False) if d is None else known.get(d, (False, False)))))
    out = []
    for part in {f[0] for f in fails}:
        mine = [f for f in fails if f[0] == part]
        found, shapley = [], dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            left = list(mine)
            for step, f in enumerate(order, 1):
                gone = [m for m in left if f in m[1]]
                left = [m for m in left if f not in m[1]]
                shapley[f] += len(gone)
                redundant = sum(f in m[1] for m in mine) - len(gone)
                found.append((f, part, order, step, len(left), len(gone), redundant, sum(m[1] == {f} for m in mine), sum(m[2] for m in gone), sum(m[3] for m in gone)))
        out += [(*row[1:], shapley[row[0]]) for row in found]
    return sorted(out)


def long_text(seed, n, extra=""):
    return prose(seed, n) + extra


def test_audit_equals_brute_force(spark):
    rng = random.Random(3)
    rows = [(k if k % 11 else None, long_text(k % 17, rng.choice([3, 250]), rng.choice(["", " #", " A" * 40, " the" * 400])), rng.choice(["a", "b", None, ""])) for k in range(120)]
    rows += [(5, None, "a"), (6, "", "b"), (7, None, None), (300, rows[0][1], "a"), (300, rows[0][1], "a"), (0, rows[0][1], "b"), (0, rows[0][1], "b"), (None, rows[0][1], "b")]
    labels = [(k, k % 2, k % 3 == 0 and 1 or 0) for k in range(0, 120, 2)] + [(4, None, None), (6, 1, 1), (None, 1, 1), (300, 1, 0), (300, 0, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    want = brute_audit(rows, labels)
    for frame in (df, clashing(df.repartition(9))):
        assert sorted(map(tuple, filter_audit.audit_documents(frame, marks).collect())) == want


def test_audit_of_empty_tables(spark):
    marks = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit_documents(empty(spark), marks).collect() == []
    assert filter_audit.audit_documents(awkward(spark), marks).count() == 600 * 2


def test_packed_fields_hold_every_outcome():
    for mask in range(32):
        removed, redundant = map(filter_audit.unpack, filter_audit.packed(mask))
        for (order, step), gone, late in zip(filter_audit.OUTCOMES, removed, redundant):
            earlier = any(mask >> "ABCDE".index(f) & 1 for f in order[: step - 1])
            fails = mask >> "ABCDE".index(order[step - 1]) & 1
            assert (gone, late) == (int(fails and not earlier), int(fails and earlier))


def test_packed_sums_do_not_run_over():
    most = (1 << 63) - 1
    sums = [0] * filter_audit.WIDTH
    filter_audit._add(sums, 31, True, True, most)
    assert set(filter_audit.unpack(sums[1])) | set(filter_audit.unpack(sums[2])) == {0, most}


def test_many_parts_are_handed_on(spark, monkeypatch):
    counted = spark.range(50).select(F.concat(F.lit("p"), "id").alias("part"), F.lit(False).alias("good"), F.lit(True).alias("toxic"), F.lit(3).alias("mask"), F.lit(2).alias("n"))
    got = filter_audit.audit(counted.unionByName(counted))
    assert got.count() == 50 * 600 and got.filter("step = 5 and (kept != 0 or shapley = 0) and filter_order like '%A'").count() == 0


def test_toxicity_learns_stems_and_names_the_sentence():
    rng = random.Random(2)
    texts, labels = [], []
    for k in range(600):
        lines = [prose(10_000 + 31 * k + j, 8) for j in range(12)]
        if k % 4 == 0:
            lines[rng.randrange(12)] += " grumble" + rng.choice(["", "s", "d", "ton", "fex", "ink"])
        texts.append(". ".join(lines))
        labels.append(int(k % 4 == 0))
    model = toxicity.train(texts, np.array(labels))
    words = toxicity.Words(model.weights)
    text = prose(1, 9) + ". " + prose(2, 5) + " grumblewort " + prose(3, 5) + "! " + prose(4, 9)
    spans, logits = toxicity.sentence_scores(text, model, words)
    assert toxicity.noisy_or(logits, model.leak) > 0.5 and [("grumblewort" in text[a:b]) == (z > 0) for (a, b), z in zip(spans, logits)] == [True] * 3
    clean = ". ".join(prose(50_000 + j, 10) for j in range(300))
    assert toxicity.noisy_or(toxicity.sentence_scores(clean, model, words)[1], model.leak) < 0.5


def test_noisy_or_equals_the_product():
    z = np.array([-3.0, 0.5, -9.0, 2.0])
    p = 1 / (1 + np.exp(-z))
    assert abs(toxicity.noisy_or(z, 0.1) - (1 - 0.9 * np.prod(1 - p))) < 1e-12
    assert toxicity.noisy_or(np.zeros(0), 0.25) == pytest.approx(0.25) and toxicity.noisy_or(np.array([800.0]), 0.0) == 1.0


def test_gradient_of_training_lowers_the_loss_whatever_the_order():
    texts = ["good day. bad word", "good day", "bad word", "good word. fine day"] * 5
    a = toxicity.train(texts, np.array([1, 0, 1, 0] * 5))
    assert a.bias < 0 and np.abs(a.weights).sum() > 0


def test_toxicity_without_labels(spark):
    marks = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit(awkward(spark), marks)
    rows = toxicity.score_documents(awkward(spark), model).collect()
    assert len(rows) == awkward(spark).count() and {(r["score"], r["predicted"]) for r in rows} == {(0.0, 0)}
    assert toxicity.score_documents(empty(spark), model).collect() == []


def test_toxicity_of_awkward_rows(spark):
    marks = spark.createDataFrame([(4, 1), (5, 0), (5, 1), (8, 0), (None, 1), (9, None)], "doc_id long, toxic int")
    model = toxicity.fit(clashing(awkward(spark)), marks)
    rows = toxicity.score_documents(clashing(awkward(spark)), model).collect()
    assert len(rows) == awkward(spark).count() and all(0 <= r["score"] <= 1 for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] in (1, 2, 3)}) == 1
    same = [r["score"] for r in rows if r["doc_id"] == 5]
    assert len(same) == 2 and same[0] == same[1]
    other = toxicity.score_documents(awkward(spark).repartition(6), toxicity.fit(awkward(spark).repartition(3), marks)).collect()
    assert sorted((str(r["doc_id"]), r["score"]) for r in rows) == sorted((str(r["doc_id"]), r["score"]) for r in other)


def test_toxicity_on_held_out_rows_of_a_whole_table(spark):
    sf = "/root/testdata/sf0.1"
    rows = QUERIES["op11_toxicity"](spark, sf).toPandas()
    assert len(rows) == duckdb.sql(f"SELECT count(*) FROM '{sf}/documents.parquet'").fetchall()[0][0]
    assert all(rows.held_out == [zlib.crc32(str(d).encode()) % 5 == 0 for d in rows.doc_id])
    assert all(rows.predicted == (rows.score >= 0.5)) and rows.score.between(0, 1).all()
    truth = duckdb.sql(f"SELECT doc_id, toxic FROM '{sf}/labels.parquet' WHERE toxic IS NOT NULL").df()
    held = rows[rows.held_out].merge(truth, on="doc_id")
    ranks = held.score.rank()
    pos = held.toxic == 1
    auc = (ranks[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())
    assert auc > 0.95 and held.predicted[pos].mean() > 0.8 and held.predicted[~pos].mean() < 0.01
