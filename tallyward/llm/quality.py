"""Quality rules as a short-circuit cascade.

Each rule looks at a document whose measures are computed only when a rule asks for them, and are then
shared. Cost and selectivity of every rule are estimated on a sample (a Spark job over about
``SAMPLE_ROWS`` rows; only one line per rule comes back), and rules run in the order of rejections per
second of cost until one rejects. The order never changes which documents are kept.

Defined results: a null text counts as empty; a text without words fails as too short; rules and counts
read whole texts of any length; rows are independent, so repeated rows and null ids give the same answer
for each row; an empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyward.llm.words import encode

SAMPLE_ROWS = 2000
# Separators of words, and symbols.
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
_LETTERS = bytes(ord("a") if chr(i).isascii() and chr(i).isalpha() or i > 127 else 32 for i in range(256))
_OTHERS = bytes(i for i in range(128) if not chr(i).isalpha() and chr(i) not in BLANKS)


class Document:
    """Measures of one text, each computed at most once."""

    def __init__(self, text: str | None):
        self.text = text or ""
        self.raw = encode(self.text)

    @cached_property
    def words(self) -> list[bytes]:
        return self.raw.split()

    @property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, BLANKS))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS))

    @cached_property
    def lines(self) -> list[str]:
        return [line for line in self.text.split("\n") if line.strip(BLANKS)]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words inside three-word windows that occur twice or more, all occurrences counted."""
        w = self.words
        windows = list(zip(w, w[1:], w[2:]))
        if len(set(windows)) == len(windows):
            return 0
        first: dict = {}
        marked = bytearray(len(w))
        for i, window in enumerate(windows):
            j = first.setdefault(window, i)
            if j != i:
                marked[i : i + 3] = marked[j : j + 3] = b"\x01\x01\x01"
        return marked.count(1)

    @cached_property
    def n_letter_words(self) -> int:
        """Words with a letter or a non-ASCII character."""
        return len(self.raw.translate(_LETTERS, _OTHERS).split())

    @cached_property
    def n_capitals(self) -> int:
        return len(self.raw) - len(self.raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))

    @property
    def base_failed(self) -> bool:
        return self.n_words < 50 or 100 * self.n_repeat_words > 50 * self.n_words


Rule = Callable[[Document], bool]
# A rule is true for a document to reject.
RULES: dict[str, Rule] = {
    "few_words": lambda d: d.n_words < 50,
    "repeated_windows": lambda d: 100 * d.n_repeat_words > 50 * d.n_words,
    "symbols_per_word": lambda d: 10 * d.n_symbols > d.n_words,
    "shouting": lambda d: 10 * d.text.count("!") > 3 * d.n_words,
    "capitals": lambda d: 10 * d.n_capitals > 4 * d.word_chars,
    "letterless_words": lambda d: 10 * d.n_letter_words < 7 * d.n_words,
    "word_length": lambda d: not 5 * d.n_words <= 2 * d.word_chars <= 24 * d.n_words,
    "repeated_lines": lambda d: 2 * d.n_dup_lines > len(d.lines),
    "dangling_lines": lambda d: 10 * sum(x.rstrip(BLANKS).endswith(("...", "…")) for x in d.lines) > 3 * len(d.lines),
}
BASE = ("few_words", "repeated_windows")


def estimate(df: DataFrame, rules: Sequence[str], text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(rule, rows, rejected, seconds) over a sample of about ``sample_rows`` rows."""
    n = df.count()
    sample = df.select(text_col).sample(min(1.0, sample_rows / max(n, 1)), seed=7)

    def measure(batches):
        spent, rejected, rows = dict.fromkeys(rules, 0.0), dict.fromkeys(rules, 0), 0
        for batch in batches:
            for text in batch.column(0):
                rows += 1
                for rule in rules:  # a fresh document for each rule: its own cost, nothing shared
                    start = time.perf_counter()
                    rejected[rule] += RULES[rule](Document(text.as_py()))
                    spent[rule] += time.perf_counter() - start
        if rows:
            yield pa.RecordBatch.from_pydict(
                {"rule": list(rules), "rows": [rows] * len(rules), "rejected": list(rejected.values()), "seconds": list(spent.values())}
            )

    each = sample.mapInArrow(measure, "rule string, rows long, rejected long, seconds double")
    return each.groupBy("rule").agg(F.sum("rows").alias("rows"), F.sum("rejected").alias("rejected"), F.sum("seconds").alias("seconds"))


def plan(df: DataFrame, rules: Sequence[str] = tuple(RULES), text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> list[str]:
    """Rules by estimated rejections per cost, best first; one more rejection is assumed for each, so
    that rules without any in the sample are ordered by cost."""
    found = {r["rule"]: r for r in estimate(df, rules, text_col, sample_rows).collect()}  # one row per rule
    gain = {r: (found[r]["rejected"] + 1) / (found[r]["seconds"] + 1e-9) if r in found else 0.0 for r in rules}
    return sorted(rules, key=lambda r: (-gain[r], r))


def first_rejection(document: Document, order: Sequence[str]) -> str | None:
    """The first rule in order that rejects the document."""
    return next((rule for rule in order if RULES[rule](document)), None)


def keep_good(df: DataFrame, text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of ``df`` that no rule rejects, with all their columns."""
    order = plan(df, text_col=text_col, sample_rows=sample_rows)
    place = df.columns.index(text_col)

    def keep(batches):
        for batch in batches:
            good = [first_rejection(Document(t.as_py()), order) is None for t in batch.column(place)]
            yield batch.filter(pa.array(good, pa.bool_()))

    return df.mapInArrow(keep, df.schema)


def quality_report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The base measures of every row and its verdict: (id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept)."""
    order = plan(df, [r for r in RULES if r not in BASE], text_col, sample_rows)
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def report(batches):
        for batch in batches:
            found: dict[str, list] = {c: [] for c in [*counts, "base_failed", "kept"]}
            for text in batch.column(1):
                d = Document(text.as_py())
                for c in counts:
                    found[c].append(getattr(d, c))
                found["base_failed"].append(d.base_failed)
                found["kept"].append(not d.base_failed and first_rejection(d, order) is None)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, found.values())], names=[id_col, *found])

    key = df.select(id_col).schema.fields[0].dataType.simpleString()
    schema = f"`{id_col}` {key}, {', '.join(f'{c} long' for c in counts)}, base_failed boolean, kept boolean"
    return df.select(id_col, text_col).mapInArrow(report, schema)
