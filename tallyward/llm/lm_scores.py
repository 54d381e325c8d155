"""Language-model scores of whole texts: a word base line and a self-attention model over subwords.

Word counts cannot be broadcast, and one row per document and word would be shuffled twice. Instead, every
task reads its documents once and writes, for blocks of bounded size, the distinct word hashes of the block
with their training counts, and each document as positions in that list. The lists are cut into ranges of
the hash space, summed over all blocks range by range, and the sums go back to the blocks that asked; there
is one range per block, so the size of a group does not grow with the corpus, and a block writes only the ranges
that it has words in, so their number is bounded by its words. Words are told apart by 64-bit hashes.

The subword counts of the training documents (one number for each id of a fixed vocabulary) are summed over
the corpus and give the classes of the attention model. Texts are cut into subwords once: the ids of each
document are written, and the counts, the training and the scores read them. The network is trained on all windows of all
training documents: it starts from weights found on the driver on at most ``TRAIN_WINDOWS`` windows of a
sample, and ``ROUNDS`` passes, each over its own part of the documents, move them. In a round every task
takes Adam steps over all its windows, and what the tasks changed is averaged in a tree of as many levels as it needs: by the number of
targets, and for each row of the table of subwords by the places that had it, so a subword that few tasks
see is learned from those. The network then scores all texts in a pass of its own.

Defined results: a null or empty text has the end token alone; texts are read whole; rows with the same id
and text are scored alike and returned each; a null id counts as the empty text for the fold; without
training tokens every count is 0 and V is 0; an empty table gives an empty result. Only the named columns
are read.
"""

from __future__ import annotations

import base64
import hashlib
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyward.llm import attention
from tallyward.llm.lineage import drop, written
from tallyward.llm.words import WordHashes, encode

BLOCK_TOKENS = 3_000_000
SAMPLE_DOCS = 900
WINDOWS_A_DOC = 8
TRAIN_WINDOWS = 6000
ROUNDS = 3
RATES = (0.002, 0.001, 0.0005)  # of the rounds
STEP_WINDOWS = 64
COUNT_IDS = 1_000_000  # ids that are counted together
POOL_WINDOWS = 4096  # windows of neighbouring documents that are shuffled together
SLICE_ROWS = 2048  # rows of the table of subwords that are averaged in one group
BRANCH = 32  # tasks, or groups of the level below, whose changes are added in one group
PIECES = 10_000  # ranges of a block that are handed on in one batch
END = b"\xff"  # no word of a text: UTF-8 has no such byte

_ENCODINGS: dict = {}


def encoding(ranks_file: bytes, pattern: str):
    """The byte-pair encoding of a ranks file; made once in a Python worker."""
    key = hashlib.sha256(ranks_file).hexdigest()
    if key not in _ENCODINGS:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks_file.splitlines()) if a}
        _ENCODINGS[key] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[key]


def remainder(doc) -> int:
    return zlib.crc32(str("" if doc is None else doc).encode()) % 5


def pack(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values).tobytes())


def unpack(blob: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), kind)


def planes(values: np.ndarray) -> np.ndarray:
    """Bytes of the values by significance, which packs small numbers well."""
    return values.astype("<u4").view(np.uint8).reshape(-1, 4).T


def unplanes(blob: bytes) -> np.ndarray:
    raw = unpack(blob, np.uint8)
    return np.ascontiguousarray(raw.reshape(4, -1).T).view("<u4").ravel()


def subword_ids(df: DataFrame, id_col: str, text_col: str, ranks, pattern: str) -> DataFrame:
    """(doc, key, held_out, ids) of every document: the hash of its text and its packed subwords."""
    key = df.select(id_col).schema.fields[0].dataType.simpleString()

    def read(batches):
        tool = encoding(ranks.value, pattern)
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64)
                held = pa.array([remainder(doc.as_py()) == 1 for doc in part.column(0)], pa.bool_())
                ids = [pack(planes(np.array(tool.encode_ordinary(t.as_py() or ""), np.uint32))) for t in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), held, pa.array(ids, pa.binary())], names=["doc", "key", "held_out", "ids"])

    source = df.select(F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text"))
    return source.mapInArrow(read, f"doc {key}, key long, held_out boolean, ids binary")


def unpacked(blob: pa.BinaryScalar) -> np.ndarray:
    return unplanes(blob.as_py()).astype(np.int32)


def blocks(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(block, docs, hashes of texts, held_out, sizes, steps, times, words, counts), one row per block of documents."""
    key = df.select(id_col).schema.fields[0].dataType.simpleString()

    def read(batches):
        from pyspark import TaskContext

        cache = WordHashes()
        base, number = TaskContext.get().partitionId() << 24, 0
        docs: list = []
        keys, held, uniques, times, tokens = [], [], [], [], 0

        def close():
            flat = np.concatenate(uniques)
            many = np.concatenate(times)
            train = np.repeat(~np.array(held), [len(u) for u in uniques])
            words, place = np.unique(flat, return_inverse=True)
            counts = np.bincount(place, many * train, len(words)).astype(np.int64)
            steps = np.concatenate([np.diff(np.sort(p), prepend=0) for p in np.split(place, np.cumsum([len(u) for u in uniques])[:-1])])
            return pa.RecordBatch.from_pydict(
                {
                    "block": [base + number], "docs": pa.array([docs], pa.list_(kind)), "keys": [keys], "held": [held],
                    "sizes": [[len(u) for u in uniques]], "steps": [pack(planes(steps))], "times": [pack(planes(many))],
                    "words": [pack(words)], "counts": [pack(counts)],
                }
            )

        kind = pa.string()
        for batch in batches:
            kind = batch.schema.field(0).type
            for doc, text_key, value in zip(*batch.columns):
                text, doc = value.as_py() or "", doc.as_py()
                words = encode(text).lower().split()
                words.append(END)
                found, n = np.unique(cache.of(words), return_counts=True)
                out = remainder(doc) == 1
                docs.append(doc)
                keys.append(text_key.as_py())
                held.append(out)
                uniques.append(found)
                times.append(n)
                tokens += len(words)
                if tokens >= BLOCK_TOKENS:
                    yield close()
                    number += 1
                    docs, keys, held, uniques, times, tokens = [], [], [], [], [], 0
        if docs:
            yield close()

    source = df.select(F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text"))
    return source.mapInArrow(
        read,
        f"block long, docs array<{key}>, keys array<long>, held array<boolean>, sizes array<long>, steps binary, times binary, "
        "words binary, counts binary",
    )


def ranges_of(words: np.ndarray, parts: int) -> np.ndarray:
    """Number of the range of the hash space, of ``parts`` equal ones, that each word hash falls into."""
    return np.minimum(words // np.uint64(max(1, (1 << 64) // parts) if parts > 1 else (1 << 64) - 1), np.uint64(parts - 1)).astype(np.int64)


def word_totals(stored: DataFrame, parts: int) -> DataFrame:
    """(block, part, totals, n, v, first): corpus counts for the words of a block, range by range of the hash space.

    ``n`` and ``v`` are the training tokens and distinct training words of the range, on one row of each range.
    """

    def cut(batches):
        for batch in batches:
            for block, words, counts in zip(*batch.columns):
                w, c = unpack(words.as_py(), np.uint64), unpack(counts.as_py(), np.int64)
                # words are sorted, so ranges with words are runs of them
                part = ranges_of(w, parts)
                first = np.flatnonzero(np.diff(part, prepend=-1))
                pieces = list(zip(np.split(w, first[1:]), np.split(c, first[1:])))
                for k in range(0, len(first), PIECES):
                    some = pieces[k : k + PIECES]
                    yield pa.RecordBatch.from_pydict(
                        {
                            "part": pa.array(part[first[k : k + PIECES]], pa.int32()), "block": [block.as_py()] * len(some),
                            "words": [p.tobytes() for p, _ in some], "counts": [q.astype(np.uint32).tobytes() for _, q in some],
                        }
                    )

    def total(data: pa.Table) -> pa.Table:
        words = [np.frombuffer(w, np.uint64) for w in data.column("words").to_pylist()]
        counts = [np.frombuffer(c, np.uint32) for c in data.column("counts").to_pylist()]
        known, place = np.unique(np.concatenate(words), return_inverse=True)
        sums = np.bincount(place, np.concatenate(counts), len(known)).astype(np.int64)
        back = np.split(sums[place], np.cumsum([len(w) for w in words])[:-1])
        rows = data.num_rows
        return pa.table(
            {
                "block": data.column("block"), "part": data.column("part"), "totals": pa.array([pack(b) for b in back], pa.binary()),
                "n": pa.array([int(sums.sum())] + [0] * (rows - 1), pa.int64()), "v": pa.array([int((sums > 0).sum())] + [0] * (rows - 1), pa.int64()),
            }
        )

    pieces = stored.select("block", "words", "counts").mapInArrow(cut, "part int, block long, words binary, counts binary")
    return pieces.groupBy("part").applyInArrow(total, "block long, part int, totals binary, n long, v long")


def base_scores(stored: DataFrame, totals: DataFrame, n: int, v: int) -> DataFrame:
    """(doc, key, held_out, n_tokens, n_known, base_score) of every document of every block."""
    key = stored.schema["docs"].dataType.elementType.simpleString()

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        order = np.argsort(right.column("part").to_numpy())
        blobs = right.column("totals").to_pylist()
        c = np.concatenate([unpack(blobs[k], np.int64) for k in order])
        logs = np.log10((c + 0.5) / (n + 0.5 * (v + 1)))
        row = {name: left.column(name)[0].as_py() for name in ("keys", "held", "sizes", "steps", "times")}
        sizes = np.array(row["sizes"])
        ends = np.cumsum(sizes)
        # positions of a document are sorted, and stored as steps from the one before
        steps = unplanes(row["steps"]).astype(np.int64)
        running = np.cumsum(steps)
        starts = ends - sizes
        place = running - np.repeat(running[starts] - steps[starts], sizes)
        times = unplanes(row["times"]).astype(np.int64)
        return pa.table(
            {
                "doc": left.column("docs").combine_chunks().flatten(), "key": pa.array(row["keys"], pa.int64()),
                "held_out": pa.array(row["held"], pa.bool_()), "n_tokens": np.add.reduceat(times, starts),
                "n_known": np.add.reduceat(times * (c[place] > 0), starts), "base_score": np.add.reduceat(times * logs[place], starts),
            }
        )

    ours = stored.select("block", "docs", "keys", "held", "sizes", "steps", "times").groupBy("block")
    return ours.cogroup(totals.select("block", "part", "totals").groupBy("block")).applyInArrow(
        score, f"doc {key}, key long, held_out boolean, n_tokens long, n_known long, base_score double"
    )


def subword_counts(stored: DataFrame, n_ids: int) -> np.ndarray:
    """Counts of all ids, and of ends, in the training documents: one row per id of the vocabulary comes to the driver."""

    def count(batches):
        total, some, held = np.zeros(n_ids, np.int64), [], 0
        for batch in batches:
            for blob in batch.column(0):
                some.append(unpacked(blob))
                total[-1] += 1
                held += len(some[-1])
                if held >= COUNT_IDS:
                    total += np.bincount(np.concatenate(some), minlength=n_ids)
                    some, held = [], 0
        if some:
            total += np.bincount(np.concatenate(some), minlength=n_ids)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["id", "n"])

    rows = stored.filter(~F.col("held_out")).select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(n_ids, np.int64)
    out[rows["id"].to_numpy()] = rows["n"].to_numpy()
    return out


def _other_weights(model: attention.Model) -> list[str]:
    return sorted(set(model.weights) - {"id"})


def _changes(start: attention.Model, steps: attention.Steps):
    """(slice, weights of its rows, their changes times these weights); slice -1 has all but the table of subwords."""
    new = steps.model.weights
    rest = np.concatenate([(new[k] - start.weights[k]).ravel() for k in _other_weights(start)]).astype(np.float64)
    yield -1, np.array([steps.targets], np.float64), rest * steps.targets
    change = new["id"] - start.weights["id"]
    for k in range(0, len(change), SLICE_ROWS):
        times = steps.seen[k : k + SLICE_ROWS].astype(np.float64)
        if times.any():
            yield k // SLICE_ROWS, times, change[k : k + SLICE_ROWS] * times[:, None]


def _added(data: pa.Table) -> pa.Table:
    """One row for the rows of a slice, with the sums of weights and of changes."""
    rows = data.sort_by("task")
    total = lambda name: pack(sum(unpack(b, np.float64) for b in rows.column(name).to_pylist()))
    least = rows.slice(0, 1)
    return pa.table(
        {"slice": least.column("slice"), "task": least.column("task"), "times": pa.array([total("times")], pa.binary()), "change": pa.array([total("change")], pa.binary())}
    )


def averaged(changes: DataFrame) -> DataFrame:
    """The rows of each slice added up, ``BRANCH`` at a time; each level is written."""
    width = BRANCH
    level = written(changes.groupBy("slice", F.expr(f"task div {width}")).applyInArrow(lambda _, data: _added(data), changes.schema), "changes")
    tasks = level.agg(F.max("task").alias("last")).first()["last"] or 0
    while tasks // width >= BRANCH:
        width *= BRANCH
        above = level.groupBy("slice", F.expr(f"task div {width}")).applyInArrow(lambda _, data: _added(data), changes.schema)
        below, level = level, written(above, "changes")
        drop(below)
    return level.groupBy("slice").applyInArrow(_added, changes.schema)


def train_round(stored: DataFrame, model: attention.Model, part: int, parts: int, rate: float) -> int:
    """Move the model by all windows of the training documents whose text hash falls into the part; the number of targets."""
    shared = stored.sparkSession.sparkContext.broadcast(model)  # of fixed size
    schema = "slice int, task long, times binary, change binary"

    def learn(batches):
        from pyspark import TaskContext

        start, task = shared.value, TaskContext.get().partitionId()
        steps, rng = attention.Steps(start, rate), np.random.default_rng(task)
        pool, held = [], 0

        def use():
            inputs, targets, first = (np.concatenate(p) for p in zip(*pool))
            order = rng.permutation(len(inputs))
            for k in range(0, len(order), STEP_WINDOWS):
                pick = order[k : k + STEP_WINDOWS]
                steps.take(inputs[pick], targets[pick], first[pick])

        for batch in batches:
            for blob in batch.column(0):
                inputs, targets, first = attention.windows(unpacked(blob), start.edge)
                for k in range(0, len(inputs), POOL_WINDOWS):
                    cut = slice(k, k + POOL_WINDOWS)
                    pool.append((inputs[cut], targets[cut], first[cut]))
                    held += len(first[cut])
                    if held >= POOL_WINDOWS:
                        use()
                        pool, held = [], 0
        if pool:
            use()
        if steps.step:
            for number, times, change in _changes(start, steps):
                yield pa.RecordBatch.from_pydict(
                    {"slice": pa.array([number], pa.int32()), "task": [task], "times": [pack(times)], "change": [pack(change)]}
                )

    mine = ~F.col("held_out") & (F.pmod("key", F.lit(parts)) == part)
    changes = stored.filter(mine).select("ids").mapInArrow(learn, schema)
    rows = averaged(changes).collect()  # one row a slice of the model
    shared.destroy()
    targets = 0
    for row in rows:
        times, change = unpack(row["times"], np.float64), unpack(row["change"], np.float64)
        if row["slice"] < 0:
            targets, at = int(times[0]), 0
            for name in _other_weights(model):
                w = model.weights[name]
                w += (change[at : at + w.size] / times[0]).reshape(w.shape).astype(np.float32)
                at += w.size
        else:
            k = row["slice"] * SLICE_ROWS
            mean = change.reshape(len(times), -1) / np.maximum(times, 1)[:, None]
            model.weights["id"][k : k + len(times)] += mean.astype(np.float32)
    return targets


def train_on_all(df: DataFrame, id_col: str, text_col: str, model: attention.Model, ranks, pattern: str, stored: DataFrame | None = None) -> int:
    """Train the model on every window of every training document; the number of targets it was trained on.

    ``stored`` has the documents' :func:`subword_ids`, if they are written already.
    """
    ids = subword_ids(df, id_col, text_col, ranks, pattern) if stored is None else stored
    return sum(train_round(ids, model, k, ROUNDS, RATES[k]) for k in range(ROUNDS))


def train_windows(df: DataFrame, id_col: str, text_col: str, ranks, pattern: str, sample_docs: int, limit: int) -> tuple:
    """At most ``limit`` windows (inputs, targets, first) of a sample of training documents, for the first weights."""
    n = df.count()
    sample = df.select(id_col, text_col).sample(min(1.0, sample_docs / max(n, 1)), seed=13)

    def read(batches):
        tool = encoding(ranks.value, pattern)
        for batch in batches:
            for doc, value in zip(*batch.columns):
                if remainder(doc.as_py()) == 1:
                    continue
                text = value.as_py() or ""
                inputs, targets, first = attention.windows(np.array(tool.encode_ordinary(text), np.int32), tool.n_vocab)
                rng = np.random.default_rng(zlib.crc32(encode(text)))
                pick = np.sort(rng.permutation(len(inputs))[:WINDOWS_A_DOC])
                yield pa.RecordBatch.from_pydict(
                    {"mark": rng.integers(1 << 40, size=len(pick)), "inputs": list(inputs[pick]), "targets": list(targets[pick]), "first": first[pick].astype(np.int64)}
                )

    rows = sample.mapInArrow(read, "mark long, inputs array<int>, targets array<int>, first long")
    found = rows.orderBy("mark").limit(limit).collect()
    shape = lambda name, width: np.array([r[name] for r in found], np.int32).reshape(len(found), width)
    return shape("inputs", attention.WINDOW), shape("targets", attention.STRIDE), np.array([r["first"] for r in found], np.int64)


def model_scores(stored: DataFrame, model: attention.Model) -> DataFrame:
    """(doc, key, score) of every row."""
    shared = stored.sparkSession.sparkContext.broadcast(model)  # of fixed size: the vocabulary and the layers

    def read(batches):
        net = shared.value
        tables = net.tables()
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64)
                scores = net.score([unpacked(blob) for blob in part.column(2)], tables=tables)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(scores)], names=["doc", "key", "score"])

    return stored.select("doc", "key", "ids").mapInArrow(read, f"doc {stored.schema['doc'].dataType.simpleString()}, key long, score double")


def score_documents(
    df: DataFrame, ranks_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = SAMPLE_DOCS,
    train_limit: int = TRAIN_WINDOWS,
) -> DataFrame:
    """One row per row: (id, held_out, n_tokens, n_known, train_tokens, base_score, score)."""
    spark = df.sparkSession
    with open(ranks_file, "rb") as f:
        ranks = spark.sparkContext.broadcast(f.read())  # a vocabulary file, under 1 MB
    stored = written(blocks(df, id_col, text_col), "blocks")
    n_blocks = stored.count()
    totals = written(word_totals(stored, max(1, n_blocks)), "totals")
    sums = totals.agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()
    n, v = sums["n"] or 0, sums["v"] or 0
    base = written(base_scores(stored, totals, n, v), "base")
    n_ids = encoding(ranks.value, pattern).n_vocab + 1
    drop(stored)
    drop(totals)
    ids = written(subword_ids(df, id_col, text_col, ranks, pattern), "ids")
    model = attention.Model(*attention.classes_of(subword_counts(ids, n_ids)))
    attention.train(model, *train_windows(df, id_col, text_col, ranks, pattern, sample_docs, train_limit))
    train_on_all(df, id_col, text_col, model, ranks, pattern, ids)
    scored = model_scores(ids, model)
    # rows with the same id and text have the same values, so one of them is enough on the joined side
    once = base.dropDuplicates(["doc", "key"]).select(F.col("doc").alias("_doc"), F.col("key").alias("_key"), "held_out", "n_tokens", "n_known", "base_score")
    out = scored.join(once, scored["doc"].eqNullSafe(once["_doc"]) & (scored["key"] == once["_key"]))
    return out.select(
        F.col("doc").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(int(n)).cast("long").alias("train_tokens"), "base_score", "score"
    )
