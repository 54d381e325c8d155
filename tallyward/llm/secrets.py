"""Secret scans: base patterns, and a character convolutional network over every other candidate.

Base spans are found with the given patterns, behind cheap tests of the whole text (a keyword, a run of
hexadecimal digits). A candidate is any other run of token characters that is long enough to hide a
secret; the network reads each candidate together with the characters around it. Long candidates are read
in overlapping windows and keep their highest score, so nothing is cut off.

The network (numpy) embeds character classes, convolves, pools over the candidate and over its context,
and ends in a logistic unit. It is trained on labelled findings: spans confirmed by a base pattern and
well-known token formats are secrets (``KNOWN``, in the corpus as in made findings); other candidates of the sample are not. Each finding
gives one of its windows, chosen by a hash. The sample is bounded by
``SAMPLE_FINDINGS`` of each kind. A fifth of the rows, by a hash of the text, is held out from the fit. The
network scores all secrets of all held-out rows, and one row per bin of a fixed scale comes back; Platt
scaling takes these bins and made findings that were held out, each label with the same weight. The threshold is set on
what the network alone must find, since spans of a base pattern are returned anyway: secrets of well-known formats
outside base spans in all held-out rows, and fresh made findings of every format. It is the highest one that keeps
``RECALL`` of the former and ``FORMAT_RECALL`` of each format of the latter, however low that is; only where the rows give no
finding of any kind, so that nothing tells how many of their runs would pass, is it ``LEAST_THRESHOLD`` at least. Candidates without a label
are not in the calibration. The network keeps the recall of each format and the share of harmless made runs that pass.

A candidate is asked unless a base span covers it but for a few characters, so a secret that a base pattern finds in part is
reported whole.

Defined results: a null or empty text has no spans and the digest of the empty string; texts are read
whole; overlapping kinds are all reported; rows are independent, so repeated rows and null ids are
answered row by row; with an empty table, or one without candidates, the network is trained on the
well-known formats alone. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyward.llm.words import encode

# The base patterns, in the order of their kinds.
KINDS = ["assign", "access", "hex"]
ASSIGN = re.compile(
    "([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]"
    "|[aA][pP][iI]_?[kK][eE][yY])"
    "[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]+")
LEAST = {"assign": 6, "access": 20, "hex": 24}
KEYWORD = re.compile(rb"passw(?:or)?d|secret|token|api_?key")
CANDIDATE = re.compile("[A-Za-z0-9+/_.=-]{16,}")
LEAST_CANDIDATE = 16
SAMPLE_FINDINGS = 1500
SAMPLE_ROWS = 4000
RECALL = 0.99
FORMAT_RECALL = 0.95  # of every well-known format
MADE_A_FORMAT = 80  # made findings of each format in the calibration
UNCOVERED = 8  # characters outside base spans from which a candidate is asked
LEAST_THRESHOLD = 0.5  # of a network that is not calibrated yet, or has seen made findings only
HELD_OUT = 5  # one row of so many is held out
BINS, BINS_A_UNIT = 4096, 128  # bins of logits on either side of 0
CONTEXT, BODY = 16, 48
WIDTH = BODY + 2 * CONTEXT
FILTERS, EMBED, KERNEL = 12, 8, 5

_HEXES = bytes(ord("h") if chr(i) in "0123456789abcdef" else 32 for i in range(256))
_RUNS = bytes(ord("h") if chr(i).isascii() and (chr(i).isalnum() or chr(i) in "+/_.=-") else 32 for i in range(256))
_LOWER = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))


def character_class(c: str) -> int:
    """Class of a character: hexadecimal and other letters by case, digits, single signs, space, other."""
    if "0" <= c <= "9":
        return 1
    if "a" <= c <= "f":
        return 2
    if "g" <= c <= "z":
        return 3 + (c in "aeiou")
    if "A" <= c <= "F":
        return 5
    if "G" <= c <= "Z":
        return 6 + (c in "AEIOU")
    signs = "+/_.=-:\"'@ \n|$#%&*!<>,;(){}[]\\?~^`\t"
    return 8 + signs.index(c) if c in signs else 63


_CLASSES = np.array([character_class(chr(i)) if i < 128 else 63 for i in range(256)], np.uint8)
CLASSES = 64


def base_spans(text: str, raw: bytes | None = None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns, in the order of start, then kind."""
    raw = encode(text) if raw is None else raw
    out = []
    if KEYWORD.search(raw.translate(_LOWER)):
        out += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if b"AKIA" in raw:
        out += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    if b"h" * LEAST["hex"] in raw.translate(_HEXES):
        out += [(m.start(), m.end(), 2) for m in HEX.finditer(text) if m.end() - m.start() >= LEAST["hex"]]
    return [(a, b, KINDS[k]) for a, b, k in sorted(out, key=lambda s: (s[0], s[2], s[1]))]


def candidates(text: str, raw: bytes | None = None) -> list[tuple[int, int]]:
    """Runs of token characters that are long enough, of letters alone or not."""
    raw = encode(text) if raw is None else raw
    if b"h" * LEAST_CANDIDATE not in raw.translate(_RUNS):
        return []
    return [m.span() for m in CANDIDATE.finditer(text)]


def outside(spans: list[tuple[int, int]], taken: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """Spans that overlap none of the taken ones; both ordered by start."""
    out, k, reach = [], 0, -1
    for a, b in spans:
        while k < len(taken) and taken[k][0] < b:
            reach = max(reach, taken[k][1])
            k += 1
        if reach <= a:
            out.append((a, b))
    return out


def uncovered(spans: list[tuple[int, int]], taken: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """Spans with at least ``UNCOVERED`` characters, or all of theirs, outside the taken ones; both ordered by start."""
    out, k = [], 0
    for a, b in spans:
        while k < len(taken) and taken[k][1] <= a:
            k += 1
        at, free = a, 0
        for s, e, _ in taken[k:]:
            if s >= b:
                break
            free, at = free + max(0, s - at), max(at, e)
        if free + max(0, b - at) >= min(UNCOVERED, b - a):
            out.append((a, b))
    return out


def windows(text: str, start: int, end: int) -> list[tuple[str, int]]:
    """Windows over a candidate with its context, as (characters, length of the candidate's part)."""
    out = []
    for at in range(start, max(start + 1, end - BODY // 2), BODY // 2):
        stop = min(end, at + BODY)
        before = text[max(0, at - CONTEXT) : at].rjust(CONTEXT)
        out.append((before + text[at:stop].ljust(BODY) + text[stop : stop + CONTEXT].ljust(CONTEXT), stop - at))
        if stop == end:
            break
    return out


def encode_windows(items: list[tuple[str, int]]) -> tuple[np.ndarray, np.ndarray]:
    codes = np.frombuffer("".join(t for t, _ in items).encode("utf-32-le", "replace"), np.uint32).reshape(len(items), WIDTH)
    inside = (np.arange(WIDTH)[None, :] >= CONTEXT) & (np.arange(WIDTH)[None, :] < CONTEXT + np.array([n for _, n in items])[:, None])
    return _CLASSES[np.minimum(codes, 255)], inside


def sigmoid(z):
    return np.exp(-np.logaddexp(0, -z))


@dataclass
class Network:
    """Weights of the network, its calibration (slope, offset) and its threshold."""

    embed: np.ndarray
    conv: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: float = 0.0
    slope: float = 1.0
    offset: float = 0.0
    threshold: float = LEAST_THRESHOLD
    recall: float = 1.0  # reached on the findings of the calibration
    format_recall: dict | None = None  # by well-known format
    false_alarms: float = 0.0  # share of made harmless runs

    def forward(self, codes: np.ndarray, inside: np.ndarray) -> tuple:
        x = self.embed[codes]  # rows, width, embed
        columns = np.lib.stride_tricks.sliding_window_view(x, KERNEL, axis=1).transpose(0, 1, 3, 2)
        columns = columns.reshape(len(x), WIDTH - KERNEL + 1, KERNEL * EMBED)
        z = columns @ self.conv + self.bias
        act = np.maximum(z, 0)
        mid = inside[:, KERNEL // 2 : WIDTH - KERNEL // 2]
        n_in = np.maximum(mid.sum(1, keepdims=True), 1)
        pooled_max = np.where(mid[:, :, None], act, 0).max(1)
        pooled_mean = (act * mid[:, :, None]).sum(1) / n_in
        context = (act * ~mid[:, :, None]).sum(1) / np.maximum((~mid).sum(1, keepdims=True), 1)
        h = np.concatenate([pooled_max, pooled_mean, context], 1)
        return columns, act, mid, n_in, h, h @ self.out + self.out_bias

    def score(self, items: list[tuple[str, int]]) -> np.ndarray:
        """Calibrated probabilities."""
        return self.calibrated(self.logits(items))

    def logits(self, items: list[tuple[str, int]]) -> np.ndarray:
        parts = [self.forward(*encode_windows(items[k : k + 512]))[-1] for k in range(0, len(items), 512)]
        return np.concatenate(parts) if parts else np.zeros(0)

    def calibrated(self, logits: np.ndarray) -> np.ndarray:
        return sigmoid(self.slope * logits + self.offset)


def train(items: list[tuple[str, int]], labels: np.ndarray, epochs: int = 12, seed: int = 5) -> Network:
    """Fit by Adam on two thirds of the findings; calibrate and set the threshold on the rest."""
    rng = np.random.default_rng(seed)
    net = Network(
        rng.normal(0, 0.3, (CLASSES, EMBED)), rng.normal(0, 0.2, (KERNEL * EMBED, FILTERS)), np.zeros(FILTERS),
        rng.normal(0, 0.2, 3 * FILTERS),
    )
    order = rng.permutation(len(items))
    held, fit = order[: len(items) // 3], order[len(items) // 3 :]
    codes, inside = encode_windows(items)
    moments: dict[str, list] = {}
    step = 0
    for _ in range(epochs):
        rng.shuffle(fit)
        for k in range(0, len(fit), 64):
            pick = fit[k : k + 64]
            step += 1
            columns, act, mid, n_in, h, logit = net.forward(codes[pick], inside[pick])
            err = (sigmoid(logit) - labels[pick]) / len(pick)
            dh = err[:, None] * net.out
            shown = np.where(mid[:, :, None], act, 0)
            top = (shown == shown.max(1, keepdims=True)) & mid[:, :, None]
            dact = dh[:, None, :FILTERS] * top / np.maximum(top.sum(1, keepdims=True), 1)
            dact = dact + dh[:, None, FILTERS : 2 * FILTERS] * mid[:, :, None] / n_in[:, :, None]
            dact = dact + dh[:, None, 2 * FILTERS :] * ~mid[:, :, None] / np.maximum((~mid).sum(1), 1)[:, None, None]
            dz = dact * (act > 0)
            dcol = (dz @ net.conv.T).reshape(len(pick), -1, KERNEL, EMBED)
            dx = np.zeros((len(pick), WIDTH, EMBED))
            for j in range(KERNEL):
                dx[:, j : j + dcol.shape[1]] += dcol[:, :, j]
            dembed = np.zeros_like(net.embed)
            np.add.at(dembed, codes[pick].ravel(), dx.reshape(-1, EMBED))
            grads = {
                "embed": dembed, "conv": np.tensordot(columns, dz, ((0, 1), (0, 1))), "bias": dz.sum((0, 1)),
                "out": h.T @ err, "out_bias": err.sum(),
            }
            for name, g in grads.items():
                m, v = moments.setdefault(name, [np.zeros_like(g), np.zeros_like(g)])
                moments[name] = [m, v] = [0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g]
                change = 0.01 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
                setattr(net, name, getattr(net, name) - change)
    calibrate(net, net.forward(codes[held], inside[held])[-1], labels[held])
    return net


def calibrate(net: Network, logits: np.ndarray, labels: np.ndarray) -> None:
    """Scaling and threshold from single findings."""
    scale(net, logits, labels, np.ones(len(logits)))
    scores = np.sort(net.calibrated(logits[labels == 1]))
    if len(scores) and len(scores) < len(logits):
        at = int((1 - RECALL) * len(scores))
        net.threshold, net.recall = float(scores[at] - 1e-9), 1 - at / len(scores)


def scale(net: Network, logits: np.ndarray, labels: np.ndarray, times: np.ndarray) -> None:
    """Platt scaling by Newton steps with the usual smoothed targets, over logits that occur some number of times."""
    n_pos, n_neg = (times * labels).sum(), (times * (1 - labels)).sum()
    if not n_pos or not n_neg:
        return
    target = np.where(labels == 1, (n_pos + 1) / (n_pos + 2), 1 / (n_neg + 2))
    a, b = 1.0, 0.0
    for _ in range(30):
        p = sigmoid(a * logits + b)
        w = times * np.maximum(p * (1 - p), 1e-6)
        g = np.array([(times * (p - target) * logits).sum(), (times * (p - target)).sum()])
        hess = np.array([[(w * logits**2).sum(), (w * logits).sum()], [(w * logits).sum(), w.sum()]]) + 1e-3 * np.eye(2)
        a, b = np.array([a, b]) - np.linalg.solve(hess, g)
    if not np.isfinite([a, b]).all() or a <= 0:
        a, b = 1.0, 0.0
    net.slope, net.offset = float(a), float(b)


def least_bin(bins: dict[int, int]) -> tuple[int, float]:
    """The highest bin whose lower edge keeps ``RECALL`` of the counted scores, and the recall that it reaches."""
    total, kept = sum(bins.values()), 0
    for b in sorted(bins, reverse=True):
        kept += bins[b]
        if kept >= RECALL * total:
            return b, kept / total
    return -BINS, 1.0


# Well-known token formats: prefix, alphabet, length.
_HEX, _AZ09, _B64 = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
FORMATS = [
    ("", _HEX, 32), ("", _HEX, 40), ("", _HEX, 64), ("AKIA", _AZ09, 16), ("ASIA", _AZ09, 16), ("ghp_", _B64, 36), ("gho_", _B64, 36),
    ("github_pat_", _B64, 60), ("glpat-", _B64, 20), ("xoxb-", "0123456789", 24), ("xoxp-", _B64, 40), ("sk_live_", _B64, 24),
    ("rk_live_", _B64, 24), ("AIza", _B64 + "-_", 35), ("eyJhbGciOi", _B64 + "-_.", 80), ("SG.", _B64, 64), ("hf_", _B64, 34),
    ("npm_", _B64, 36), ("", _B64 + "+/", 40), ("", _B64, 24), ("sk-", _B64, 48), ("dop_v1_", _HEX, 64),
]
# The formats that a prefix tells, as they are found in candidates of the corpus.
KNOWN = re.compile(
    "(?<![A-Za-z0-9])(?:gh[opsur]_[A-Za-z0-9]{36}|github_pat_[A-Za-z0-9_]{40}|glpat-[A-Za-z0-9_-]{20}|xox[abeprs]-[A-Za-z0-9-]{20}"
    "|[sr]k_live_[A-Za-z0-9]{24}|AIza[A-Za-z0-9_-]{35}|eyJ[A-Za-z0-9_-]{8,}[.]eyJ[A-Za-z0-9_-]{8}|eyJhbGciOi[A-Za-z0-9_.-]{40}"
    "|SG[.][A-Za-z0-9_.-]{60}|hf_[A-Za-z0-9]{34}|npm_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{48}|dop_v1_[0-9a-f]{64}|ASIA[A-Z0-9]{16})"
)
LEADS = ['key = "', "Authorization: Bearer ", "secret: ", "export TOKEN=", " ", "auth=", "'", '"', "client_secret=", "pwd: "]


def _harmless(rng: random.Random) -> str:
    """A long run of token characters that is no secret."""
    word = lambda: "".join(rng.choice(["er", "an", "th", "ing", "ion", "ter", "ge", "lo", "ma", "ci"]) for _ in range(rng.randint(2, 4)))
    return rng.choice(
        [
            lambda: "".join(rng.choices("0123456789", k=rng.randint(16, 19))),
            lambda: f"{word()}.{word()}.example.com/{word()}/{word()}.html",
            lambda: f"{word()}-{word()}-{word()}-{rng.randint(1, 2030)}",
            lambda: f"{word()}_{word()}_{word()}",
            lambda: f"{rng.randint(1990, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}.{word()}.{word()}",
            lambda: f"/{word()}/{word()}/{word()}/{word()}",
            lambda: "-" * rng.randint(16, 60),
            lambda: "=" * rng.randint(16, 60),
            lambda: "." * rng.randint(16, 60),
            lambda: f"v{rng.randint(1, 9)}.{rng.randint(0, 30)}.{rng.randint(0, 9)}-{word()}.{word()}",
            lambda: f"{word().title()}{word().title()}{word().title()}.{word()}",
            lambda: "".join(word() for _ in range(rng.randint(4, 6))),
        ]
    )()


def made_findings(n: int, seed: int = 11) -> list[tuple[str, int, int, int]]:
    """Labelled findings of well-known formats and of harmless runs in turn, as (text, start, end, label); the k-th secret
    has the k-th format, round and round."""
    rng, out = random.Random(seed), []
    for k in range(n):
        if k % 2:
            prefix, alphabet, size = FORMATS[k // 2 % len(FORMATS)]
            body, lead = prefix + "".join(rng.choices(alphabet, k=size)), rng.choice(LEADS)
        else:
            body, lead = _harmless(rng), rng.choice([" ", "\n", "(", " the ", " de ", "see "])
        tail = '"' if lead.endswith('"') else rng.choice([" ", "\n", ". ", ", "])
        out.append((f"and the {lead}{body}{tail}of the", 8 + len(lead), 8 + len(lead) + len(body), k % 2))
    return out


def held_out(text_col: str):
    return F.pmod(F.xxhash64(F.col(f"`{text_col}`")), F.lit(HELD_OUT)) == 0


def labelled(text: str) -> list[tuple[int, int, int]]:
    """(start, end, label) of the findings of a text: 1 for secrets by their form, 0 for other candidates."""
    raw = encode(text)
    base = base_spans(text, raw)
    found = [(a, b, int(KNOWN.search(text, a, b) is not None)) for a, b in outside(candidates(text, raw), base)]
    for a, b, kind in base:
        # only the value of an assignment is the secret; its name is context
        m = ASSIGN.match(text, a) if kind == "assign" else None
        found.append((m.start(2) if m else a, b, 1))
    return found


def known_outside(text: str) -> list[tuple[int, int]]:
    """Candidates of a well-known format outside the base spans."""
    raw = encode(text)
    found = candidates(text, raw)
    return [(a, b) for a, b in outside(found, base_spans(text, raw)) if KNOWN.search(text, a, b)] if found else []


def secret_bins(df: DataFrame, net: Network, text_col: str = "text") -> dict[int, int]:
    """Number of secrets that only the network finds, by bin of their logit (the highest one of their windows), over all rows."""
    weights = df.sparkSession.sparkContext.broadcast(net)  # some kilobytes, of fixed size

    def read(batches):
        for batch in batches:
            found: dict[int, int] = {}
            for part, texts in _chunks(batch, 0):
                items, owner, n = [], [], 0
                for text in texts:
                    for a, b in known_outside(text):
                        more = windows(text, a, b)
                        items += more
                        owner += [n] * len(more)
                        n += 1
                best = np.full(n, -np.inf)
                np.maximum.at(best, np.array(owner, np.int64), weights.value.logits(items))
                for b, times in zip(*np.unique(np.clip(np.floor(best * BINS_A_UNIT), -BINS, BINS).astype(np.int64), return_counts=True)):
                    found[int(b)] = found.get(int(b), 0) + int(times)
            yield pa.RecordBatch.from_pydict({"bin": pa.array(found.keys(), pa.int64()), "n": pa.array(found.values(), pa.int64())})

    bins = df.select(text_col).mapInArrow(read, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n"))
    return {r["bin"]: r["n"] for r in bins.collect()}  # at most 2 BINS + 1 rows


def findings(df: DataFrame, text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Labelled windows (window, size, secret) from a sample of about ``sample_rows`` rows."""
    n = df.count()
    sample = df.filter(~held_out(text_col)).select(text_col).sample(min(1.0, sample_rows / max(n, 1)), seed=3)

    def read(batches):
        for batch in batches:
            out: dict[str, list] = {"window": [], "size": [], "secret": []}
            for value in batch.column(0):
                text = value.as_py() or ""
                for a, b, label in labelled(text):
                    more = windows(text, a, b)
                    window, size = more[zlib.crc32(encode(text[a:b])) % len(more)]
                    out["window"].append(window)
                    out["size"].append(size)
                    out["secret"].append(label)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("window", pa.string()), ("size", pa.int64()), ("secret", pa.int64())]))

    return sample.mapInArrow(read, "window string, size long, secret long")


def fit(df: DataFrame, text_col: str = "text", sample_findings: int = SAMPLE_FINDINGS, sample_rows: int = SAMPLE_ROWS) -> Network:
    """Train on at most ``sample_findings`` labelled findings of each kind from the sample, chosen by hash, and
    as many made ones."""
    found = findings(df, text_col, sample_rows)
    pick = F.xxhash64("window")
    taken = []
    for label in (0, 1):
        rows = found.filter(F.col("secret") == label).distinct().orderBy(pick, "window").limit(sample_findings).collect()
        taken += [((r["window"], r["size"]), label) for r in rows]
    real = len(taken)
    for text, a, b, label in made_findings(sample_findings):
        taken.append((windows(text, a, b)[0], label))
    net = train([item for item, _ in taken], np.array([label for _, label in taken]))
    bins = secret_bins(df.filter(held_out(text_col)), net, text_col)
    set_threshold(net, bins, least=0.0 if real or bins else LEAST_THRESHOLD)
    return net


def set_threshold(net: Network, bins: dict[int, int], least: float = 0.0) -> None:
    """Scaling and threshold, ``least`` at least, from the counted secrets of the held-out rows and fresh made findings."""
    made = made_findings(2 * MADE_A_FORMAT * len(FORMATS), seed=12)  # not those of the fit
    logits, labels = net.logits([windows(t, a, b)[0] for t, a, b, _ in made]), np.array([x[3] for x in made])
    places, times = np.array([*bins], np.int64), np.array([*bins.values()], float)
    x = np.concatenate([logits, (places + 0.5) / BINS_A_UNIT])
    y = np.concatenate([labels, np.ones(len(places))])
    many = np.concatenate([np.ones(len(logits)), times])
    n_neg = (labels == 0).sum()
    scale(net, x, y, np.where(y == 1, many * n_neg / many[y == 1].sum(), many))
    by_format = {k: np.sort(logits[labels == 1][k :: len(FORMATS)]) for k in range(len(FORMATS))}
    line = min(v[int((1 - FORMAT_RECALL) * len(v))] for v in by_format.values())
    if bins:
        line = min(line, least_bin(bins)[0] / BINS_A_UNIT)
    if least:
        line = max(line, (np.log(least / (1 - least)) - net.offset) / net.slope)
    net.recall = float(times[places / BINS_A_UNIT >= line].sum() / times.sum()) if bins else 1.0
    net.format_recall = {FORMATS[k]: float((v >= line).mean()) for k, v in by_format.items()}
    net.false_alarms = float((logits[labels == 0] >= line).mean())
    net.threshold = max(least, float(net.calibrated(np.array(line)) - 1e-9))


def detect(texts: list[str], net: Network) -> list[list[tuple[int, int, str]]]:
    """All spans of each text: the base ones, and candidates that the network takes for secrets."""
    spans, asked, owner = [], [], []
    for k, text in enumerate(texts):
        raw = encode(text)
        base = base_spans(text, raw)
        spans.append(base)
        for a, b in uncovered(candidates(text, raw), base):
            for window in windows(text, a, b):
                asked.append(window)
                owner.append((k, a, b))
    best: dict = {}
    for who, score in zip(owner, net.score(asked)):
        best[who] = max(best.get(who, 0.0), score)
    for (k, a, b), score in best.items():
        if score >= net.threshold:
            spans[k].append((a, b, "model"))
    order = {kind: i for i, kind in enumerate([*KINDS, "model"])}
    return [sorted(s, key=lambda x: (x[0], order[x[2]], x[1])) for s in spans]


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def _chunks(batch: pa.RecordBatch, place: int, rows: int = 512):
    for k in range(0, batch.num_rows, rows):
        part = batch.slice(k, rows)
        yield part, [t.as_py() or "" for t in part.column(place)]


def scan_secrets(df: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: id, n_assign, n_access, n_hex, n_model, base_sha256, spans."""
    weights = df.sparkSession.sparkContext.broadcast(net)  # some kilobytes, of fixed size

    def report(batches):
        for batch in batches:
            for part, texts in _chunks(batch, 1):
                found = detect(texts, weights.value)
                counts = [[sum(kind == k for _, _, kind in spans) for spans in found] for k in [*KINDS, "model"]]
                digests = [hashlib.sha256(joined([s for s in spans if s[2] != "model"]).encode()).hexdigest() for spans in found]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()),
                     pa.array([joined(s) for s in found], pa.string())],
                    names=[id_col, "n_assign", "n_access", "n_hex", "n_model", "base_sha256", "spans"],
                )

    key = df.select(id_col).schema.fields[0].dataType.simpleString()
    schema = f"`{id_col}` {key}, n_assign long, n_access long, n_hex long, n_model long, base_sha256 string, spans string"
    return df.select(id_col, text_col).mapInArrow(report, schema)


def redact(text: str, spans: list[tuple[int, int, str]], mark: str = "[secret]") -> str:
    """The text with each maximal run of overlapping spans replaced by a mark; an assignment keeps its name."""
    out, at, cover = [], 0, []
    for a, b, kind in spans:
        m = ASSIGN.match(text, a) if kind == "assign" else None
        cover.append((m.start(2) if m else a, b))
    for a, b in sorted(cover):
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], mark]
        at = b
    return "".join([*out, text[at:]])


def redact_documents(df: DataFrame, net: Network, text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """All rows and columns of ``df`` with secrets replaced in the text; a length column follows the text."""
    weights = df.sparkSession.sparkContext.broadcast(net)
    place = df.columns.index(text_col)
    size_at = df.columns.index(length_col) if length_col else None

    def clean(batches):
        for batch in batches:
            for part, texts in _chunks(batch, place):
                found = detect(texts, weights.value)
                columns = list(part.columns)
                before = part.column(place).to_pylist()
                after = [None if t is None else redact(t, s) if s else t for t, s in zip(before, found)]
                columns[place] = pa.array(after, part.schema.field(place).type)
                if size_at is not None:
                    old = part.column(size_at).to_pylist()
                    new = [len(t) if s and t is not None else n for t, s, n in zip(after, found, old)]
                    columns[size_at] = pa.array(new, part.schema.field(size_at).type)
                yield pa.RecordBatch.from_arrays(columns, schema=part.schema)

    return df.mapInArrow(clean, df.schema)
