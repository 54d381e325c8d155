"""Boosted trees for several classes: softmax rounds on histograms that are added up in the cluster.

Columns are cut into at most ``BINS`` ranges at their quantiles, and the rows of the training accounts become blocks of
one byte per value, written once. In every round one tree per class grows level by level. For a level, each task adds
gradients and curvatures of its blocks by class, node, column and range; sums of one column meet in one small group,
which finds the best cut of every node, and one row per column comes back to the driver. So what moves is a
histogram of fixed size per task and column, whatever the number of accounts.

Scores of earlier rounds are recomputed from the trees, which travel with the tasks; every ``KEEP`` rounds they are
written next to the blocks, so a pass never applies more than ``KEEP`` rounds.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyward.operators.detect import MISSING, check_columns
from tallyward.operators.skew import join_grown
from tallyward.operators.split import class_weights
from tallyward.session import cut_lineage, drop_table, per_core
from tallyward.sources.schema import NORMAL

BINS, ROUNDS, DEPTH, RATE = 32, 12, 3, 0.45
L2, LEAST_GAIN, LEAST_CURVATURE = 1.0, 1e-6, 1e-3
KEEP = 16
BLOCK_ROWS = 20_000


@dataclass
class Tree:
    """A complete tree: column and last range on the left of each inner node (-1: all go left), value of each leaf."""

    column: np.ndarray
    upto: np.ndarray
    value: np.ndarray

    def leaves(self, x: np.ndarray, depth: int) -> np.ndarray:
        """Number of the node that each row reaches on level ``depth``, from 0."""
        at = np.zeros(len(x), np.int64)
        rows = np.arange(len(x))
        for level in range(depth):
            node = at + (1 << level) - 1
            column = self.column[node]
            right = (column >= 0) & (x[rows, np.maximum(column, 0)] > self.upto[node])
            at = 2 * at + right
        return at


@dataclass
class Booster:
    columns: list[str]
    classes: list[str]
    edges: list[np.ndarray]
    rounds: list[list[Tree]] = field(default_factory=list)
    start: np.ndarray | None = None
    gain: np.ndarray | None = None
    depth: int = DEPTH

    def binned(self, values: list[np.ndarray]) -> np.ndarray:
        return np.stack([np.searchsorted(e, v, side="left").astype(np.uint8) for e, v in zip(self.edges, values)], 1)

    def margins(self, x: np.ndarray, first: int = 0) -> np.ndarray:
        """Sum of the trees from round ``first`` on, by row and class."""
        out = np.zeros((len(x), len(self.classes)))
        for trees in self.rounds[first:]:
            for k, tree in enumerate(trees):
                out[:, k] += tree.value[tree.leaves(x, self.depth)]
        return out


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def column_edges(filled: DataFrame, columns: Sequence[str], bins: int, error: float | None = None) -> list[np.ndarray]:
    """Cut points of each column at its quantiles; one pass for all columns.

    Quantiles are sketched to a quarter of a range, so cut points may move by that with the layout of the rows; with an
    ``error`` of 0 they are exact.
    """
    cuts = filled.approxQuantile(list(columns), [k / bins for k in range(1, bins)], 0.25 / bins if error is None else error)
    return [np.unique(np.array(c, np.float64)) for c in cuts]


def blocks(train: DataFrame, booster: Booster) -> DataFrame:
    """(x, y, w, z): bytes of the ranges, classes, weights and scores of up to ``BLOCK_ROWS`` accounts."""

    def pack(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(k, BLOCK_ROWS)
                x = booster.binned([c.to_numpy(zero_copy_only=False).astype(np.float64) for c in part.columns[2:]])
                y = part.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                w = part.column(1).to_numpy(zero_copy_only=False).astype(np.float64)
                z = np.tile(booster.start, (len(y), 1))
                yield pa.RecordBatch.from_pydict({"x": [x.tobytes()], "y": [y.tobytes()], "w": [w.tobytes()], "z": [z.tobytes()]})

    ordered = train.select("_y", "weight", *[F.col(f"`{c}`").cast("double") for c in booster.columns])
    return ordered.mapInArrow(pack, "x binary, y binary, w binary, z binary")


def _arrays(row, booster: Booster) -> tuple[np.ndarray, ...]:
    y = np.frombuffer(row[1], np.int64)
    return np.frombuffer(row[0], np.uint8).reshape(len(y), -1), y, np.frombuffer(row[2], np.float64), np.frombuffer(row[3], np.float64).reshape(len(y), -1)


def _histograms(x, g, h, nodes, n_nodes: int, bins: int) -> np.ndarray:
    """Sums of gradient and curvature: [column, class, node, range, 2]."""
    n_columns, n_classes = x.shape[1], g.shape[1]
    out = np.zeros((n_columns, n_classes, n_nodes, bins, 2))
    for k in range(n_classes):
        for c in range(n_columns):
            place = nodes[k] * bins + x[:, c]
            out[c, k, :, :, 0] = np.bincount(place, g[:, k], n_nodes * bins).reshape(n_nodes, bins)
            out[c, k, :, :, 1] = np.bincount(place, h[:, k], n_nodes * bins).reshape(n_nodes, bins)
    return out


def best_cuts(sums: np.ndarray) -> np.ndarray:
    """[class, node] -> gain, last range on the left, and the sums of both sides, from [class, node, range, 2]."""
    left = np.cumsum(sums, 2)[:, :, :-1]
    total = sums.sum(2)
    right = total[:, :, None] - left
    worth = lambda s: s[..., 0] ** 2 / (s[..., 1] + L2)
    gain = worth(left) + worth(right) - worth(total)[:, :, None]
    gain = np.where((left[..., 1] < LEAST_CURVATURE) | (right[..., 1] < LEAST_CURVATURE), -1.0, gain)
    at = gain.argmax(2)
    pick = lambda a: np.take_along_axis(a, at[:, :, None, None], 2)[:, :, 0]
    found = np.take_along_axis(gain, at[:, :, None], 2)[:, :, 0]
    return np.concatenate([found[..., None], at[..., None], pick(left), pick(right)], 2)


def level_cuts(stored: DataFrame, booster: Booster, growing: list[Tree], level: int, kept: int, bins: int) -> np.ndarray:
    """Best cuts of the nodes of a level: [column, class, node, 6], summed and searched in the cluster."""
    n_nodes, n_classes = 1 << level, len(booster.classes)
    shared = stored.sparkSession.sparkContext.broadcast((booster, growing))  # trees of fixed size

    def add(batches):
        net, trees = shared.value
        total = None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                x, y, w, z = _arrays(row, net)
                p = softmax(z + net.margins(x, kept))
                g = w[:, None] * (p - (y[:, None] == np.arange(n_classes)))
                h = w[:, None] * np.maximum(p * (1 - p), 1e-9)
                found = _histograms(x, g, h, [t.leaves(x, level) for t in trees], n_nodes, bins)
                total = found if total is None else total + found
        if total is not None:
            yield pa.RecordBatch.from_pydict({"column": pa.array(range(len(total)), pa.int32()), "sums": [t.tobytes() for t in total]})

    def search(data: pa.Table) -> pa.Table:
        sums = sum(np.frombuffer(b, np.float64) for b in data.column("sums").to_pylist())
        cuts = best_cuts(sums.reshape(n_classes, n_nodes, bins, 2))
        return pa.table({"column": data.column("column").slice(0, 1), "cuts": pa.array([cuts.tobytes()], pa.binary())})

    rows = per_core(stored).mapInArrow(add, "column int, sums binary").groupBy("column").applyInArrow(search, "column int, cuts binary").collect()  # a row a column
    shared.destroy()
    out = np.zeros((len(booster.columns), n_classes, n_nodes, 6))
    for r in rows:
        out[r["column"]] = np.frombuffer(r["cuts"], np.float64).reshape(n_classes, n_nodes, 6)
    return out


def grow(stored: DataFrame, booster: Booster, kept: int, bins: int, rate: float) -> list[Tree]:
    """One tree per class."""
    n, inner = len(booster.classes), (1 << booster.depth) - 1
    trees = [Tree(np.full(inner, -1), np.full(inner, bins), np.zeros(inner + 1)) for _ in range(n)]
    for level in range(booster.depth):
        cuts = level_cuts(stored, booster, trees, level, kept, bins)
        best = np.round(cuts[..., 0], 9).argmax(0)  # the first column of the largest gain
        for k, tree in enumerate(trees):
            for node in range(1 << level):
                c = best[k, node]
                gain, upto, gl, hl, gr, hr = cuts[c, k, node]
                split = gain > LEAST_GAIN
                if split:
                    tree.column[node + (1 << level) - 1], tree.upto[node + (1 << level) - 1] = c, int(upto)
                    booster.gain[c] += gain
                if level == booster.depth - 1:
                    whole = -rate * (gl + gr) / (hl + hr + L2)
                    tree.value[2 * node : 2 * node + 2] = (-rate * gl / (hl + L2), -rate * gr / (hr + L2)) if split else (whole, whole)
    return trees


def _with_scores(stored: DataFrame, booster: Booster, kept: int) -> DataFrame:
    """The blocks with the scores of all rounds so far."""

    def add(batches):
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                x, y, w, z = _arrays(row, booster)
                yield pa.RecordBatch.from_pydict({"x": [row[0]], "y": [row[1]], "w": [row[2]], "z": [(z + booster.margins(x, kept)).tobytes()]})

    return stored.mapInArrow(add, stored.schema)


def fit_boosted(
    view: DataFrame, columns: Sequence[str], split: DataFrame, rounds: int = ROUNDS, depth: int = DEPTH, bins: int = BINS, rate: float = RATE,
    error: float | None = None,
) -> Booster:
    """Class-weighted softmax boosting on ``columns`` of ``view`` (one row per account), on the noisy labels of the training accounts."""
    check_columns(columns)
    filled = view.select("user_id", *columns).fillna(MISSING)
    classes = sorted(r["label"] for r in split.select("label").distinct().collect())  # a closed set of labels
    place = F.create_map(*[F.lit(v) for k, c in enumerate(classes) for v in (c, k)])
    weights = class_weights(split).select("label_noisy", "weight")
    train = filled.join(split.filter(~F.col("is_test")), "user_id").join(F.broadcast(weights), "label_noisy")
    train = cut_lineage(train.withColumn("_y", place[F.col("label_noisy")]).filter(F.col("_y").isNotNull()), "train")
    booster = Booster(list(columns), classes, column_edges(train, columns, bins, error), depth=depth)
    booster.start, booster.gain = np.zeros(len(classes)), np.zeros(len(columns))
    stored, kept = cut_lineage(blocks(train, booster), "blocks"), 0
    for k in range(rounds):
        if k - kept >= KEEP:
            new = cut_lineage(_with_scores(stored, booster, kept), "blocks")
            drop_table(stored)
            stored, kept = new, k
        booster.rounds.append(grow(stored, booster, kept, bins, rate))
    drop_table(stored)
    drop_table(train)
    return booster


def score_boosted(booster: Booster, view: DataFrame, split: DataFrame, prefix: str) -> DataFrame:
    """Abuse score, one probability per abusive class, and is_test of every account in ``view``."""
    filled = view.select("user_id", *[F.col(f"`{c}`").cast("double") for c in booster.columns]).fillna(MISSING)
    kind = view.schema["user_id"].dataType.simpleString()
    names = [f"{prefix}_abuse", *[f"{prefix}_{c}" for c in booster.classes if c != NORMAL]]
    shared = view.sparkSession.sparkContext.broadcast(booster)  # trees of fixed size

    def score(batches):
        net = shared.value
        for batch in batches:
            x = net.binned([c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]])
            p = softmax(net.start + net.margins(x))
            by_class = [p[:, k] for k, c in enumerate(net.classes) if c != NORMAL]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v) for v in [sum(by_class), *by_class])], names=["user_id", *names])

    out = filled.mapInArrow(score, f"user_id {kind}, " + ", ".join(f"`{n}` double" for n in names))
    return join_grown(out, split.select("user_id", "is_test"), "user_id")


def boosted_importance(booster: Booster, spark: SparkSession, rows: int = 15) -> DataFrame:
    """The columns with the largest share of all gain."""
    share = booster.gain / max(booster.gain.sum(), 1e-12)
    ranked = sorted(zip(booster.columns, share.tolist()), key=lambda t: (-t[1], t[0]))[:rows]
    return spark.createDataFrame([(i + 1, c, v) for i, (c, v) in enumerate(ranked)], "rank int, feature string, importance double")


def save_booster(booster: Booster, path: str) -> None:
    """One row of text; the model has a fixed number of trees of fixed depth."""
    state = asdict(booster)
    plain = json.dumps(state, default=lambda a: a.tolist())
    SparkSession.active().createDataFrame([(plain,)], "booster string").coalesce(1).write.parquet(path)


def load_booster(path: str) -> Booster:
    state = json.loads(SparkSession.active().read.parquet(path).first().booster)
    rounds = [[Tree(np.array(t["column"], np.int64), np.array(t["upto"], np.int64), np.array(t["value"])) for t in trees] for trees in state.pop("rounds")]
    edges = [np.array(e, float) for e in state.pop("edges")]
    sums = {n: None if state[n] is None else np.array(state[n]) for n in ("start", "gain")}
    return Booster(**{**state, **sums}, edges=edges, rounds=rounds)
