"""Small corpora with the awkward cases: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import random

from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def documents(spark, *rows):
    return spark.createDataFrame(list(rows), "doc_id long, text string, lang string, source string, n_chars long")


def doc(doc_id, text, source="src0"):
    return (doc_id, text, "en", source, None if text is None else len(text))


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("abdefgilnorstu", k=rng.randint(2, 9))) for _ in range(n))


def awkward(spark):
    long = prose(1, 30_000)
    return documents(
        spark, doc(1, None), doc(2, ""), doc(3, " \n\t "), doc(4, long), doc(5, prose(2, 80)), doc(5, prose(2, 80)), doc(None, prose(3, 80)),
        doc(7, None, None), doc(8, "Größe 你好世界 niño 😀 ▁x  y"), doc(9, prose(2, 80)),
    )


def clashing(df):
    """The same rows with columns whose names the operators use for their results."""
    names = ["n_words", "n_tokens", "kept", "component_id", "labels", "spans", "score", "slot", "position", "cls", "u", "block"]
    return df.withColumns({n: F.lit("x") for n in names})


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


class Union:
    """Brute-force grouping: breadth-first search over an adjacency map."""

    def __init__(self, nodes):
        self.near = {n: set() for n in nodes}

    def link(self, a, b):
        self.near[a].add(b)
        self.near[b].add(a)

    def smallest(self):
        out = {}
        for start in sorted(self.near):
            if start in out:
                continue
            todo, seen = [start], {start}
            while todo:
                for other in self.near[todo.pop()] - seen:
                    seen.add(other)
                    todo.append(other)
            out |= dict.fromkeys(seen, start)
        return out
