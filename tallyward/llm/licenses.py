"""License scans with ordered signature rules.

Rules are regular expressions over the lower-cased words of a text joined by single spaces. They are
written as families (title, identifier, address, notice) crossed with the forms in which a license is
named, which gives a few hundred rules. A keyword automaton reads each text once; only rules whose
keyword occurs are tried. Detections are word intervals with the priority of their form. They are
resolved in the order of priority, length and start: a detection inside an interval already accepted is
suppressed.

The base phrases are counted on their own and never suppressed.

Defined results: a null or empty text has no words, no places and score 0; texts are read whole; ties
between rules go to the earlier rule; rows are independent, so repeated rows and null ids are answered
row by row; an empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tallyward.llm.words import encode

# The base phrases and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Word characters: digits, letters and everything outside ASCII; capitals are lowered.
_WORDS = bytes((i + 32 if 65 <= i <= 90 else i) if i > 127 or chr(i).isalnum() else 32 for i in range(256))

LIC = r"licen[cs]e"
VER = r"(?: version| v)?"
# label, identifier as words, keyword, title
FAMILIES = [
    ("gpl-1.0", "gpl 1 0", "g", rf"(?:gnu )?(?:general public {LIC}|gpl){VER} ?1(?: 0)?"),
    ("gpl-2.0", "gpl 2 0", "g", rf"(?:gnu )?(?:general public {LIC}|gpl){VER} ?2(?: 0)?"),
    ("gpl-3.0", "gpl 3 0", "g", rf"(?:gnu )?(?:general public {LIC}|gpl){VER} ?3(?: 0)?"),
    ("lgpl-2.0", "lgpl 2 0", "lesser", rf"(?:gnu )?(?:library general public {LIC}|lgpl){VER} ?2 0"),
    ("lgpl-2.1", "lgpl 2 1", "lesser", rf"(?:gnu )?(?:lesser general public {LIC}|lgpl){VER} ?2 1"),
    ("lgpl-3.0", "lgpl 3 0", "lesser", rf"(?:gnu )?(?:lesser general public {LIC}|lgpl){VER} ?3(?: 0)?"),
    ("agpl-3.0", "agpl 3 0", "affero", rf"(?:gnu )?(?:affero general public {LIC}|agpl){VER} ?3(?: 0)?"),
    ("gfdl-1.3", "gfdl 1 3", "documentation", rf"(?:gnu )?free documentation {LIC}{VER} ?1 3"),
    ("gpl", "gpl", "g", rf"gnu general public {LIC}|gnu gpl"),
    ("lgpl", "lgpl", "lesser", rf"(?:gnu )?lesser general public {LIC}|gnu lgpl"),
    ("agpl", "agpl", "affero", rf"(?:gnu )?affero general public {LIC}|gnu agpl"),
    ("gfdl", "gfdl", "documentation", rf"gnu free documentation {LIC}"),
    ("apache-1.0", "apache 1 0", "apache", rf"apache(?: software)? {LIC}{VER} ?1 0"),
    ("apache-1.1", "apache 1 1", "apache", rf"apache(?: software)? {LIC}{VER} ?1 1"),
    ("apache-2.0", "apache 2 0", "apache", rf"apache(?: software)? {LIC}{VER} ?2(?: 0)?"),
    ("apache", "apache", "apache", rf"apache(?: software)? {LIC}"),
    ("mit", "mit", "mit", rf"mit {LIC}|expat {LIC}|x11 {LIC}"),
    ("mit-0", "mit 0", "mit", rf"mit no attribution {LIC}"),
    ("bsd-2-clause", "bsd 2 clause", "bsd", rf"(?:simplified|2 clause|two clause|freebsd) bsd {LIC}|bsd 2 clause {LIC}"),
    ("bsd-3-clause", "bsd 3 clause", "bsd", rf"(?:modified|new|revised|3 clause|three clause) bsd {LIC}|bsd 3 clause {LIC}"),
    ("bsd-4-clause", "bsd 4 clause", "bsd", rf"(?:original|old|4 clause|four clause) bsd {LIC}|bsd 4 clause {LIC}"),
    ("0bsd", "0bsd", "bsd", rf"zero clause bsd {LIC}|bsd zero clause {LIC}|0bsd"),
    ("bsd", "bsd", "bsd", rf"bsd(?: style)? {LIC}|berkeley software distribution {LIC}"),
    ("isc", "isc", "isc", rf"isc {LIC}"),
    ("mpl-1.0", "mpl 1 0", "mozilla", rf"(?:mozilla public {LIC}|mpl){VER} ?1 0"),
    ("mpl-1.1", "mpl 1 1", "mozilla", rf"(?:mozilla public {LIC}|mpl){VER} ?1 1"),
    ("mpl-2.0", "mpl 2 0", "mozilla", rf"(?:mozilla public {LIC}|mpl){VER} ?2(?: 0)?"),
    ("epl-1.0", "epl 1 0", "eclipse", rf"(?:eclipse public {LIC}|epl){VER} ?1(?: 0)?"),
    ("epl-2.0", "epl 2 0", "eclipse", rf"(?:eclipse public {LIC}|epl){VER} ?2(?: 0)?"),
    ("cddl-1.0", "cddl 1 0", "common", rf"common development and distribution {LIC}{VER} ?1 0|cddl{VER} ?1 0"),
    ("cddl-1.1", "cddl 1 1", "common", rf"common development and distribution {LIC}{VER} ?1 1|cddl{VER} ?1 1"),
    ("cpl-1.0", "cpl 1 0", "common", rf"common public {LIC}{VER}(?: 1 0)?"),
    ("eupl-1.1", "eupl 1 1", "european", rf"(?:european union public {LIC}|eupl){VER} ?1 1"),
    ("eupl-1.2", "eupl 1 2", "european", rf"(?:european union public {LIC}|eupl){VER} ?1 2"),
    ("artistic-1.0", "artistic 1 0", "artistic", rf"artistic {LIC}{VER} ?1 0"),
    ("artistic-2.0", "artistic 2 0", "artistic", rf"artistic {LIC}{VER} ?2 0"),
    ("zlib", "zlib", "zlib", rf"zlib(?: libpng)? {LIC}"),
    ("libpng", "libpng", "libpng", rf"(?:png reference library|libpng) {LIC}"),
    ("bsl-1.0", "bsl 1 0", "boost", rf"boost software {LIC}{VER}(?: 1 0)?"),
    ("busl-1.1", "busl 1 1", "business", rf"business source {LIC}{VER}(?: 1 1)?"),
    ("unlicense", "unlicense", "unlicense", r"(?:the )?unlicense"),
    ("wtfpl", "wtfpl", "wtf", rf"do what the f\w* you want to public {LIC}|wtfpl"),
    ("psf-2.0", "psf 2 0", "python", rf"python software foundation {LIC}{VER}(?: 2)?|psf {LIC}"),
    ("python-2.0", "python 2 0", "python", rf"python {LIC}{VER}(?: 2(?: 0)?)?"),
    ("php-3.01", "php 3 01", "php", rf"php {LIC}{VER}(?: 3 01)?"),
    ("ruby", "ruby", "ruby", rf"ruby {LIC}"),
    ("openssl", "openssl", "openssl", rf"openssl {LIC}"),
    ("curl", "curl", "curl", rf"curl {LIC}"),
    ("postgresql", "postgresql", "postgresql", rf"postgresql {LIC}"),
    ("ofl-1.1", "ofl 1 1", "font", rf"(?:sil )?open font {LIC}{VER}(?: 1 1)?"),
    ("osl-3.0", "osl 3 0", "open", rf"open software {LIC}{VER}(?: 3 0)?"),
    ("afl-3.0", "afl 3 0", "academic", rf"academic free {LIC}{VER}(?: 3 0)?"),
    ("ms-pl", "ms pl", "microsoft", rf"microsoft public {LIC}"),
    ("ms-rl", "ms rl", "microsoft", rf"microsoft reciprocal {LIC}"),
    ("ncsa", "ncsa", "ncsa", rf"(?:university of illinois )?ncsa(?: open source)? {LIC}"),
    ("upl-1.0", "upl 1 0", "universal", rf"universal permissive {LIC}{VER}(?: 1 0)?"),
    ("sspl-1.0", "sspl 1 0", "server", rf"server side public {LIC}{VER}(?: 1)?"),
    ("elastic-2.0", "elastic 2 0", "elastic", rf"elastic {LIC}{VER}(?: 2 0)?"),
    ("odbl-1.0", "odbl 1 0", "database", rf"open (?:data commons )?(?:open )?database {LIC}{VER}(?: 1 0)?"),
    ("odc-by-1.0", "odc by 1 0", "commons", rf"open data commons attribution {LIC}{VER}(?: 1 0)?"),
    ("pddl-1.0", "pddl 1 0", "public domain", rf"public domain dedication and {LIC}{VER}(?: 1 0)?"),
    ("cdla-permissive-2.0", "cdla permissive 2 0", "community", rf"community data {LIC} agreement permissive{VER}(?: 2 0)?"),
    ("openrail-m", "openrail", "rail", rf"(?:bigscience |creativeml )?open ?rail(?: \+{{0,2}}m| m)?(?: {LIC})?"),
]
# Creative Commons: clause words crossed with versions.
CC_CLAUSES = {
    "by": r"(?:by|attribution)",
    "by-sa": r"(?:by sa|attribution share ?alike)",
    "by-nd": r"(?:by nd|attribution no ?deriv(?:ative)?s?)",
    "by-nc": r"(?:by nc|attribution non ?commercial)",
    "by-nc-sa": r"(?:by nc sa|attribution non ?commercial share ?alike)",
    "by-nc-nd": r"(?:by nc nd|attribution non ?commercial no ?deriv(?:ative)?s?)",
}
CC_VERSIONS = ["1.0", "2.0", "2.5", "3.0", "4.0"]
NOTICES = [
    ("mit", "permission is hereby", r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("isc", "permission to use", r"permission to use copy modify and or distribute this software for any purpose with or without fee"),
    ("bsd", "redistribution and use", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("gpl", "free software you can", r"free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("zlib", "provided as is", r"this software is provided as is without any express or implied warranty in no event"),
    ("unlicense", "unencumbered", r"free and unencumbered software released into the public domain"),
    ("cc0-1.0", "cc0", r"cc0(?: 1 0)?(?: universal)?"),
    ("cc0-1.0", "zero", r"creative commons zero(?: v)?(?: 1 0)?(?: universal)?"),
    ("public-domain", "public domain", r"(?:released|dedicated|placed) (?:to|into|in) the public domain"),
    ("proprietary", "all rights reserved", r"(?:copyright .{0,60})?all rights reserved"),
    ("copyright", "copyright", r"copyright (?:c )?(?:19|20)\d\d"),
]
GRANT = (
    r"(?:licen[cs]ed|released|distributed|available|published|provided|shared|covered|issued|redistributed)"
    r" (?:to you )?under (?:the )?(?:terms (?:and conditions )?of (?:the )?)?"
)
# form: (pattern around a title or identifier, priority, score)
FORMS = {
    "identifier": (r"spdx licen[cs]e identifier {id}(?: only| or later)?", 90, 1.0),
    "grant": (GRANT + r"(?:{title}|{id}(?: licen[cs]e)?)", 80, 1.0),
    "either": (r"(?:either )?(?:{title}) or (?:at your option )?any later version", 85, 1.0),
    "field": (r"licen[cs]e (?:is )?(?:{title}|{id})", 70, 0.9),
    "title": (r"(?:{title})", 50, 0.8),
}


class Rule:
    __slots__ = ("label", "keywords", "pattern", "priority", "score", "rank")

    def __init__(self, label, keywords, pattern, priority, score, rank):
        self.label, self.keywords, self.priority, self.score, self.rank = label, keywords, priority, score, rank
        self.pattern = re.compile(rf"(?<= )(?:{pattern})(?= )")


def _families():
    yield from FAMILIES
    for clause, words in CC_CLAUSES.items():
        for version in CC_VERSIONS:
            v = version.replace(".", " ")
            title = rf"(?:cc|creative commons) {words}(?: licen[cs]e)?(?: international| unported)?{VER} {v}(?: international| unported| licen[cs]e)*"
            yield f"cc-{clause}-{version}", f"cc {clause.replace('-', ' ')} {v}", "cc", title
        yield f"cc-{clause}", f"cc {clause.replace('-', ' ')}", "cc", rf"(?:cc|creative commons) {words}"


# Keywords that open the gate for a family, where its own keyword is short or one of several: every alternative of a
# title has one. Identifiers are keywords of their own.
GATES = {
    "g": ["gpl", "general public"],
    "lesser": ["lgpl", "lesser general", "library general"],
    "affero": ["agpl", "affero"],
    "mozilla": ["mozilla", " mpl"],
    "eclipse": ["eclipse public", " epl"],
    "common": ["common ", " cddl"],
    "european": ["european union public", " eupl"],
    "mit": [" mit licen", " expat licen", " x11 licen", " mit no "],
    "bsd": ["bsd", "berkeley software"],
    "isc": [" isc "],
    "php": [" php "],
    "curl": [" curl "],
    "ruby": [" ruby "],
    "font": ["open font", " ofl "],
    "open": ["open software", " osl "],
    "academic": ["academic free", " afl "],
    "wtf": ["wtfpl", "do what the f"],
    "rail": ["rail"],
    "libpng": ["libpng", "png reference"],
    "cc": [" cc by", " cc attribution", "creative commons"],
    "python": ["python", "psf licen"],
    "microsoft": ["microsoft", " ms pl", " ms rl"],
    "universal": ["universal permissive", " upl "],
    "server": ["server side", " sspl "],
    "database": ["database", " odbl "],
    "commons": ["commons", " odc by"],
    "public domain": ["public domain", " pddl "],
    "community": ["community data", " cdla "],
    "business": ["business source", " busl "],
    "boost": ["boost software", " bsl "],
}


@lru_cache(maxsize=1)
def rules() -> list[Rule]:
    out: list[Rule] = []
    for label, name, keyword, title in _families():
        for form, (pattern, priority, score) in FORMS.items():
            if form == "either" and not label.startswith(("gpl", "lgpl", "agpl", "gfdl")):
                continue
            keywords = GATES.get(keyword, [keyword]) + [f" {name} "] * ("{id}" in pattern)
            out.append(Rule(label, keywords, pattern.format(id=name, title=title), priority, score, len(out)))
    for label, keyword, pattern in NOTICES:
        priority, score = (60, 0.5) if label in ("proprietary", "copyright") else (95, 1.0)
        out.append(Rule(label, GATES.get(keyword, [keyword]), pattern, priority, score, len(out)))
    return out


@lru_cache(maxsize=1)
def gate():
    """Automaton from keyword to the rules it opens."""
    import ahocorasick

    opened: dict[str, list[int]] = {}
    for rule in rules():
        for keyword in rule.keywords:
            opened.setdefault(keyword, []).append(rule.rank)
    machine = ahocorasick.Automaton()
    for keyword, ranks in opened.items():
        machine.add_word(keyword, ranks)
    machine.make_automaton()
    return machine


def normal_words(text: str | None) -> list[bytes]:
    return encode(text).translate(_WORDS).split()


class Reach:
    """The furthest end among intervals that start at or before a word (a tree of prefix maxima)."""

    def __init__(self, n: int):
        self.best = [0] * (n + 1)

    def add(self, first: int, end: int) -> None:
        k = first + 1
        while k < len(self.best):
            self.best[k] = max(self.best[k], end)
            k += k & -k

    def furthest(self, first: int) -> int:
        k, end = first + 1, 0
        while k:
            end = max(end, self.best[k])
            k -= k & -k
        return end


def word_starts(joined: str) -> np.ndarray:
    """Offsets of the spaces of a joined text; word k starts behind the k-th of them."""
    return np.flatnonzero(np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32) == 32)


def detect(joined: str) -> list[tuple[int, int, Rule]]:
    """Resolved detections (first word, end word, rule) in a text of words joined by spaces."""
    opened = {r for _, ranks in gate().iter(joined) for r in ranks}
    if not opened:
        return []
    starts = word_starts(joined)
    found = []
    for rank in sorted(opened):
        rule = rules()[rank]
        for m in rule.pattern.finditer(joined):
            first = int(np.searchsorted(starts, m.start())) - 1
            found.append((first, first + m.group().count(" ") + 1, rule))
    found.sort(key=lambda d: (-d[2].priority, d[0] - d[1], d[0], d[2].rank))
    kept: list[tuple[int, int, Rule]] = []
    reach = Reach(len(starts))
    for first, end, rule in found:
        if end > reach.furthest(first):
            kept.append((first, end, rule))
            reach.add(first, end)
    return sorted(kept, key=lambda d: (d[0], d[1], d[2].rank))


def base_places(joined: str) -> list[tuple[int, str]]:
    """(first word, label) of every place of a base phrase."""
    out = []
    for phrase, label in BASE.items():
        word, seen, at = 0, 0, joined.find(f" {phrase} ")
        while at >= 0:
            word += joined.count(" ", seen, at)
            seen = at
            out.append((word, label))
            at = joined.find(f" {phrase} ", at + 1)
    return out


def scan(text: str | None) -> tuple:
    words = normal_words(text)
    joined = f" {b' '.join(words).decode('utf-8', 'replace')} "
    places, found = base_places(joined), detect(joined)
    starts = [first for first, _ in places]
    base = {label for _, label in places}
    labels = base | {rule.label for _, _, rule in found}
    score = max([0.6 * bool(base), *(rule.score for _, _, rule in found)])
    return (
        len(words), len(places), min(starts, default=None), max(starts, default=None),
        ",".join(sorted(base)), ",".join(sorted(labels)), float(score),
        [{"label": rule.label, "first_word": a, "end_word": b} for a, b, rule in found],
    )


def scan_licenses(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections."""
    span = pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64())])
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(span)]
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections"]

    def report(batches):
        for batch in batches:
            rows = [scan(t.as_py()) for t in batch.column(1)]
            columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[id_col, *names])

    key = df.select(id_col).schema.fields[0].dataType.simpleString()
    schema = (
        f"`{id_col}` {key}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
        "score double, detections array<struct<label: string, first_word: long, end_word: long>>"
    )
    return df.select(id_col, text_col).mapInArrow(report, schema)
