"""A small causal self-attention language model in numpy, over classes of subword ids.

Subwords are put into classes of about equal probability by their frequency in the corpus (a frequent
subword is a class of its own). The network sees the subwords before a position through one layer of masked
self-attention and a feed-forward layer, and gives a distribution over the class of the next subword; inside
a class, a subword has its smoothed corpus frequency. So the whole is a distribution over all subwords.

Texts are read in overlapping windows of ``WINDOW`` positions. A window scores the subwords after its last
``STRIDE`` positions, which see at least ``WINDOW - STRIDE`` positions before them, so each subword is scored
once. Windows of many texts are stacked and go through the network together.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

WINDOW, STRIDE = 64, 32
DIM, HIDDEN, CLASSES = 24, 48, 160
NEAR = np.arange(WINDOW - STRIDE, WINDOW)
#: Which positions a scored position sees.
MASK = np.where(np.arange(WINDOW)[None, :] <= NEAR[:, None], 0.0, -1e9).astype(np.float32)


#: The same as factors, and the exponent above which values are shifted first.
SEEN = (MASK == 0).astype(np.float32)
LARGE = 60.0
RUN = 128  # rows of a product that is small enough to be taken in place

Tables = tuple[np.ndarray, np.ndarray]


def classes_of(counts: np.ndarray, n_classes: int = CLASSES) -> tuple[np.ndarray, np.ndarray]:
    """Class of every subword and its log probability inside the class, from corpus counts."""
    smooth = counts.astype(np.float64) + 0.5
    order = np.argsort(-smooth, kind="stable")
    share = smooth[order] / smooth.sum()
    cls = np.empty(len(counts), np.int32)
    # walk down the frequencies; a class is closed when it holds its part of what is left
    at, left, room = 0, 1.0, n_classes
    mass = 0.0
    for k, s in zip(order, share):
        cls[k] = at
        mass += s
        if room > 1 and mass >= left / room:
            left, mass, room, at = left - mass, 0.0, room - 1, at + 1
    total = np.bincount(cls, smooth, n_classes)
    return cls, np.log(smooth / total[cls]).astype(np.float32)


def windows(ids: np.ndarray, edge: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(inputs, targets, first valid position) of one text; -1 pads targets behind the end.

    The text is read as edge, ids, edge; every id and the last edge are targets once.
    """
    n = len(ids) + 1
    rows = -(-n // STRIDE)
    padded = np.full(WINDOW - STRIDE + rows * STRIDE, edge, np.int32)
    padded[WINDOW - STRIDE + 1 : WINDOW - STRIDE + n] = ids
    target = np.full(rows * STRIDE, -1, np.int32)
    target[: n - 1] = ids
    target[n - 1] = edge
    inputs = np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::STRIDE]
    first = np.maximum(WINDOW - STRIDE - STRIDE * np.arange(rows), 0)
    return inputs, target.reshape(rows, STRIDE), first


def _with_ones(values: np.ndarray) -> np.ndarray:
    out = np.empty((len(values), values.shape[1] + 1), values.dtype)
    out[:, :-1], out[:, -1] = values, 1
    return out


def _shift(logits: np.ndarray) -> None:
    """Take the largest value off each row, if some value is large."""
    if max(logits.max(initial=0), -logits.min(initial=0)) > LARGE:
        logits -= logits.max(1, keepdims=True)


def _exponentials(logits: np.ndarray) -> np.ndarray:
    """The sum of the exponentials of each row, which take the place of the logits."""
    np.exp(logits, out=logits)
    return logits @ np.ones(logits.shape[1], logits.dtype)


def _over_rows(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """``x.T @ y`` of long and narrow arrays, by runs of rows; a wide product would copy both first."""
    if not len(x) or len(x) % RUN:
        return x.T @ y
    runs = lambda z: z.reshape(-1, RUN, z.shape[1])
    return (runs(x).transpose(0, 2, 1) @ runs(y)).sum(0)


@dataclass
class Model:
    """Weights, and the two tables over subwords."""

    cls: np.ndarray
    inside: np.ndarray
    weights: dict[str, np.ndarray] = field(default_factory=dict)

    @property
    def edge(self) -> int:
        return len(self.cls) - 1

    def start(self, seed: int = 1) -> None:
        rng = np.random.default_rng(seed)
        n = int(self.cls.max()) + 1
        made = lambda *shape, s=None: rng.normal(0, s or shape[0] ** -0.5, shape).astype(np.float32)
        self.weights = {
            "id": made(len(self.cls), DIM, s=0.05), "class": made(n, DIM, s=0.3), "place": made(WINDOW, DIM, s=0.1),
            "q": made(DIM, DIM), "k": made(DIM, DIM), "v": made(DIM, DIM), "o": made(DIM, DIM), "up": made(2 * DIM, HIDDEN),
            "down": made(HIDDEN, DIM), "out": made(DIM, n), "bias": np.zeros(n, np.float32),
        }

    def tables(self, ids: np.ndarray | slice = slice(None)) -> Tables:
        """What the layers read of subwords, wherever they stand: their vectors, and their keys, values and a one."""
        w = self.weights
        vectors = w["id"][ids] + w["class"][self.cls[ids]]
        return vectors, _with_ones(vectors @ np.hstack([w["k"], w["v"]]))

    def forward(self, inputs: np.ndarray, first: np.ndarray, tables: Tables | None = None) -> tuple:
        """All values on the way to the logits of the classes, which come last; ``inputs`` are rows of ``tables``.

        Keys and values are linear, so those of a subword and of a place are made once and added. Masks are factors,
        exponentials are taken without a shift unless some value is large, and weights of attention are divided by their
        sum after they are applied. Sums and biases come with the products, as columns of ones.
        """
        w = self.weights
        vectors, both = tables or self.tables()
        kv = both.take(inputs, axis=0)
        of_place = np.zeros_like(kv[0])
        of_place[:, : 2 * DIM] = w["place"] @ np.hstack([w["k"], w["v"]])
        kv += of_place
        near = vectors.take(inputs[:, NEAR], axis=0)
        near += w["place"][NEAR]
        q = (near.reshape(-1, DIM) @ (w["q"] * w["q"].dtype.type(DIM**-0.5))).reshape(near.shape)
        a = q @ kv[:, :, :DIM].transpose(0, 2, 1)
        starts = np.flatnonzero(first)
        if max(a.max(initial=0), -a.min(initial=0)) > LARGE:
            a += MASK
            for row in starts:
                a[row, :, : first[row]] = -1e9
            a -= a.max(2, keepdims=True)
        np.exp(a, out=a)
        a *= SEEN
        for row in starts:
            a[row, :, : first[row]] = 0
        mixed = a @ kv[:, :, DIM:]
        joined = np.empty((*near.shape[:2], 2 * DIM), near.dtype)
        joined[:, :, :DIM] = near
        np.divide(mixed[:, :, :DIM], mixed[:, :, DIM:], out=joined[:, :, DIM:])
        joined = joined.reshape(-1, 2 * DIM)
        hidden = joined @ self.up()
        np.maximum(hidden, 0, out=hidden)
        top = hidden @ w["down"]
        top += near.reshape(-1, DIM)
        top = _with_ones(top)
        return q, kv, a, mixed[:, :, DIM:], joined, hidden, top, (top @ np.vstack([w["out"], w["bias"]])).reshape(*near.shape[:2], -1)

    def up(self) -> np.ndarray:
        """The product of the layer after attention and the first of the feed-forward layer."""
        w = self.weights
        return np.vstack([w["up"][:DIM], w["o"] @ w["up"][DIM:]])

    def log_probs(self, inputs: np.ndarray, targets: np.ndarray, first: np.ndarray, tables: Tables | None = None) -> np.ndarray:
        """Natural log probability of each target; 0 behind the end of a text."""
        logits = self.forward(inputs, first, tables)[-1].reshape(targets.size, -1)
        real = targets >= 0
        ids = np.where(real, targets, 0)
        _shift(logits)
        chosen = logits[np.arange(len(logits)), self.cls[ids].ravel()].reshape(targets.shape)
        return np.where(real, chosen - np.log(_exponentials(logits)).reshape(targets.shape) + self.inside[ids], 0)

    def score(self, texts: list[np.ndarray], batch: int = 64, tables: Tables | None = None) -> np.ndarray:
        """Log10 probability of each text, given as subword ids; ``tables`` of all ids may be handed in."""
        parts = [windows(ids, self.edge) for ids in texts]
        owner = np.repeat(np.arange(len(texts)), [len(p[0]) for p in parts])
        total = np.zeros(len(texts))
        if not parts:
            return total
        inputs, targets, first = (np.concatenate(p) for p in zip(*parts))
        tables = tables or self.tables()
        for k in range(0, len(inputs), batch):
            cut = slice(k, k + batch)
            found = self.log_probs(inputs[cut], targets[cut], first[cut], tables).sum(1, dtype=np.float64)
            np.add.at(total, owner[cut], found)
        return total / np.log(10)


def train(model: Model, inputs: np.ndarray, targets: np.ndarray, first: np.ndarray, epochs: int = 3, batch: int = 32, rate: float = 0.004, seed: int = 2) -> None:
    """Adam on the mean negative log probability of the classes of the targets."""
    rng = np.random.default_rng(seed)
    model.start()
    w, moments, step = model.weights, {}, 0
    steps = max(1, epochs * -(-len(inputs) // batch))
    for _ in range(epochs):
        order = rng.permutation(len(inputs))
        for k in range(0, len(order), batch):
            pick = order[k : k + batch]
            grads = gradients(model, inputs[pick], targets[pick], first[pick])
            step += 1
            now = rate * min(1.0, step / 30) * (1 - step / (steps + 1))
            for name, g in grads.items():
                m, v = moments.setdefault(name, (np.zeros_like(w[name]), np.zeros_like(w[name])))
                m *= 0.9
                m += 0.1 * g
                v *= 0.99
                v += 0.01 * g * g
                w[name] -= (now / (1 - 0.9**step) * m / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32)


class Steps:
    """Adam steps on a copy of a model; rows of the table of subwords are moved only in steps that see them.

    The weights lie side by side with their moments: those of a subword in one row, all others in one line.
    """

    def __init__(self, model: Model, rate: float):
        n, others = len(model.cls), sorted(set(model.weights) - {"id"})
        self.rows = np.zeros((n, 3, DIM), model.weights["id"].dtype)
        self.rows[:, 0] = model.weights["id"]
        self.line = np.zeros((3, sum(model.weights[k].size for k in others)), self.rows.dtype)
        views, at = [{"id": self.rows[:, k]} for k in range(3)], 0
        for name in others:
            w = model.weights[name]
            for view, line in zip(views, self.line):
                view[name] = line[at : at + w.size].reshape(w.shape)
            views[0][name][:] = w
            at += w.size
        weights, self.first, self.second = views
        self.model, self.others = Model(model.cls, model.inside, weights), others
        self.seen = np.zeros(n, np.int64)  # positions that had each subword
        self.rate, self.step, self.targets = rate, 0, 0

    def take(self, inputs: np.ndarray, targets: np.ndarray, first: np.ndarray) -> None:
        ids, times, g = _backward(self.model, inputs, targets, first)
        self.seen[ids] += times
        self.targets += int((targets >= 0).sum())
        self.step += 1
        rows = self.rows.take(ids, axis=0)
        self._move(rows[:, 0], rows[:, 1], rows[:, 2], g["id"])
        self.rows[ids] = rows
        self._move(*self.line, np.concatenate([g[name].ravel() for name in self.others]))

    def _move(self, weights: np.ndarray, first: np.ndarray, second: np.ndarray, change: np.ndarray) -> None:
        first *= 0.9
        first += 0.1 * change
        second *= 0.99
        second += 0.01 * change * change
        now = self.rate * min(1.0, self.step / 30) / (1 - 0.9**self.step)
        weights -= now * first / (np.sqrt(second / (1 - 0.99**self.step)) + 1e-8)


def gradients(model: Model, inputs: np.ndarray, targets: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
    ids, _, g = _backward(model, inputs, targets, first)
    rows, g["id"] = g["id"], np.zeros_like(model.weights["id"])
    g["id"][ids] = rows
    return g


def _backward(model: Model, inputs: np.ndarray, targets: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    """The distinct subwords of the inputs, how often each is there, and the gradients; that of "id" has a row for each of these.

    Gradients of the rows of logits are kept up to a factor of each row, which is applied where rows are narrow.
    """
    w = model.weights
    there = np.zeros(len(model.cls), bool)
    there[inputs] = True
    ids = np.flatnonzero(there)
    number = np.zeros(len(model.cls), np.int64)
    number[ids] = np.arange(len(ids))
    at = number[inputs]
    vectors, both = model.tables(ids)
    q, kv, a, total, joined, hidden, top, dl = model.forward(at, first, (vectors, both))
    dl = dl.reshape(len(top), -1)
    real = targets.ravel() >= 0
    _shift(dl)
    sums = _exponentials(dl)
    dl[np.arange(len(dl)), model.cls[np.where(real, targets.ravel(), 0)]] -= sums
    share = (real / (max(1, real.sum()) * sums)).astype(dl.dtype)[:, None]
    dout = _over_rows(top * share, dl)
    dtop = (dl @ w["out"].T) * share
    dhidden = dtop @ w["down"].T
    dhidden *= hidden > 0
    djoined = dhidden @ model.up().T
    dup = _over_rows(joined, dhidden)
    g = {
        "out": dout[:DIM], "bias": dout[DIM], "down": _over_rows(hidden, dtop), "o": dup[DIM:] @ w["up"][DIM:].T,
        "up": np.vstack([dup[:DIM], w["o"].T @ dup[DIM:]]),
    }
    near, mixed, dmixed = joined[:, :DIM], joined[:, DIM:], djoined[:, DIM:]
    dmix = np.empty((*a.shape[:2], DIM + 1), a.dtype)
    dmix[:, :, :DIM] = dmixed.reshape(*a.shape[:2], DIM)
    dmix[:, :, DIM] = -np.einsum("ij,ij->i", dmixed, mixed).reshape(a.shape[:2])
    dmix /= total
    ds = dmix @ kv[:, :, DIM:].transpose(0, 2, 1)
    ds *= a
    scale = w["q"].dtype.type(DIM**-0.5)
    dq = (ds @ kv[:, :, :DIM]).reshape(-1, DIM)
    g["q"] = _over_rows(near, dq) * scale
    dkv = np.empty((*inputs.shape, 2 * DIM), a.dtype)
    np.matmul(ds.transpose(0, 2, 1), q, out=dkv[:, :, :DIM])
    np.matmul(a.transpose(0, 2, 1), dmix[:, :, :DIM], out=dkv[:, :, DIM:])
    dkv = dkv.reshape(-1, 2 * DIM)
    x = vectors.take(at, axis=0)
    x += w["place"]
    dkeys = _over_rows(x.reshape(-1, DIM), dkv)
    g["k"], g["v"] = dkeys[:, :DIM], dkeys[:, DIM:]
    dx = (dkv @ np.vstack([w["k"].T, w["v"].T])).reshape(x.shape)
    dtop += djoined[:, :DIM]
    dtop += dq @ (w["q"].T * scale)
    dx[:, NEAR[0] :] += dtop.reshape(*a.shape[:2], DIM)
    g["place"] = (np.ones(len(dx), dx.dtype) @ dx.reshape(len(dx), -1)).reshape(WINDOW, DIM)
    at = at.ravel().astype(np.uint16 if len(ids) < 1 << 16 else np.int64)  # short integers are sorted faster
    times = np.bincount(at, minlength=len(ids))
    g["id"] = np.add.reduceat(dx.reshape(-1, DIM).take(np.argsort(at, kind="stable"), axis=0), np.cumsum(times) - times, axis=0)
    member = np.zeros((w["class"].shape[0], len(ids)), dx.dtype)
    member[model.cls[ids], np.arange(len(ids))] = 1
    g["class"] = member @ g["id"]
    return ids, times, g
