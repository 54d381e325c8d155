"""MinHash near-duplicates with SetSketch registers.

A document is the set of its distinct runs of words. Equal sets are one class, however many documents
share it. A class has ``bands * rows`` registers: the minimum of an exponential variable over the set, on
a scale of powers of ``BASE`` and truncated to 16 bits. Registers of a union are the maxima of the
registers, and two sets share a register with a probability just above their similarity.

1. Classes that agree on all registers of a band are joined to the smallest class of that band value;
   connected components of these joins hold every pair that can be found.
2. Components are cut into blocks, bounded in classes and in bytes of their sets. Inside a block, pairs whose sizes
   allow a link and that are not yet connected are compared by their equal registers; for those with enough, the
   similarity is estimated by maximum likelihood from the registers of both, and pairs that may reach the threshold
   are verified on their full sets.
3. A component of several blocks is compared block by block with its first block. Every pair that is
   still unconnected has an end outside the largest cluster found so far; these rest classes are the
   queries of a last comparison against all blocks.

Only connections count, so pairs inside one cluster are skipped and copies are never expanded into pairs.
Bands follow from the threshold: as many registers a band as keep a pair at the threshold from missing all bands with
probability 1e-6. For 0.85 these are 32 bands of 6 (3e-7), for 0.8 they are 38 of 5 (3e-7). A pair at the threshold
has too few equal registers with probability 4e-9.

Defined results: documents without words or text have an empty set, link with nothing and are their own
component; a text shorter than a run is one run; repeated rows and repeated ids belong to the class of
their text, each row is returned; a null id takes the smallest id of its component and is kept only where
no id is known; ties are resolved by the smallest id; an empty table gives an empty result. Columns may have any names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyward.llm.linked import components
from tallyward.llm.lineage import drop, written
from tallyward.llm.words import WordHashes, encode, mix, shingles

BASE = 1.001
TOP = 65_535
REGISTERS = 192
MISS = 1e-6
BLOCK = 512
BLOCK_BYTES = 32 << 20  # of the sets of a block
SALTS = 16
SEED = 20_240_601


@dataclass(frozen=True)
class Settings:
    """Words of a run and the threshold as a fraction numerator / denominator; the bands follow from it."""

    size: int = 5
    numerator: int = 80
    denominator: int = 100

    def miss(self, rows: int) -> float:
        """Probability that a pair at the threshold shares no band of so many registers."""
        return (1 - (self.numerator / self.denominator) ** rows) ** (REGISTERS // rows)

    @property
    def rows(self) -> int:
        return max([r for r in range(1, 17) if self.miss(r) <= MISS], default=1)

    @property
    def bands(self) -> int:
        return REGISTERS // self.rows

    @property
    def registers(self) -> int:
        return self.bands * self.rows

    def linked(self, common: int, a: int, b: int) -> bool:
        return self.denominator * common >= self.numerator * (a + b - common)

    def below(self, deviations: int) -> float:
        """So many standard deviations of a share of equal registers under the threshold."""
        j = self.numerator / self.denominator
        return max(0.0, j - deviations * (j * (1 - j) / self.registers) ** 0.5)

    @property
    def floor(self) -> float:
        """Estimates below this are dropped."""
        return self.below(6)

    @property
    def fewest(self) -> float:
        """Pairs with fewer equal registers are not estimated; sets at the threshold share at least its part of them."""
        return self.below(7) * self.registers


def named(column: str):
    """A column of the input, whatever signs its name has."""
    return F.col("`" + column.replace("`", "``") + "`")


def multipliers(n: int) -> np.ndarray:
    return np.random.default_rng(SEED).integers(1, 1 << 31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def registers(items: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """SetSketch registers of a set of 64-bit hashes."""
    low = items.astype(np.uint32)
    high = (items >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(factors), 0xFFFFFFFF, np.uint32)
    for k in range(0, len(items), 1024):
        values = np.multiply.outer(low[k : k + 1024], factors)
        values += high[k : k + 1024, None]
        np.minimum(least, values.min(0), out=least)
    u = (least.astype(np.float64) + 0.5) / 2.0**32
    # the minimum of exponentials with rate 20 is the transform of the minimum of the uniforms
    scale = np.floor(1 - np.log(-np.log1p(-u) / 20) / np.log(BASE))
    return np.clip(scale, 0, TOP).astype(np.uint16)


def estimate(one: np.ndarray, many: np.ndarray, n_one: int, n_many: np.ndarray) -> np.ndarray:
    """Maximum-likelihood similarity of one set to many, from registers and known set sizes."""
    above = (one[None, :] > many).sum(1)[:, None]
    below = (one[None, :] < many).sum(1)[:, None]
    equal = many.shape[1] - above - below
    u = (n_one / (n_one + n_many))[:, None]
    v = 1 - u
    grid = np.linspace(0, 1, 101)[None, :] * np.minimum(u / v, v / u)
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
    more, less = p(u - v * grid), p(v - u * grid)
    log = lambda x: np.log(np.maximum(x, 1e-12))
    likelihood = above * log(more) + below * log(less) + equal * log(1 - more - less)
    return np.take_along_axis(grid, likelihood.argmax(1)[:, None], 1)[:, 0]


def band_keys(registers: np.ndarray, rows: int) -> np.ndarray:
    """64-bit key of every band; registers as a matrix with one line per set."""
    n, m = registers.shape
    keys = np.zeros((n, m // rows), np.uint64)
    keys += np.arange(m // rows, dtype=np.uint64)[None, :]
    parts = registers.reshape(n, m // rows, rows).astype(np.uint64)
    for k in range(rows):
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, k])
    return keys


def sketch_documents(df: DataFrame, id_col: str, text_col: str, s: Settings) -> DataFrame:
    """(doc, text_hash, cls, n, regs): class digest, set size and registers of every row."""

    def read(batches):
        hashes, factors = WordHashes(), multipliers(s.registers)
        for batch in batches:
            cls, sizes, regs = [], [], []
            for text in batch.column(2):
                items = shingles(hashes.of(encode(text.as_py()).lower().split()), s.size)
                sizes.append(len(items))
                cls.append(xxhash.xxh3_128_digest(items.tobytes()) if len(items) else None)
                regs.append(registers(items, factors).tobytes() if len(items) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(cls, pa.binary()), pa.array(sizes, pa.int64()), pa.array(regs, pa.binary())],
                names=["doc", "text_hash", "cls", "n", "regs"],
            )

    doc, text = named(id_col), named(text_col)
    key = df.select(doc).schema.fields[0].dataType.simpleString()
    source = df.select(doc.alias("doc"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    return source.mapInArrow(read, f"doc {key}, text_hash long, cls binary, n long, regs binary")


def band_rows(classes: DataFrame, s: Settings) -> DataFrame:
    """(band, cls) for every band of every class."""

    def spread(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            regs = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(batch.num_rows, -1)
            keys = band_keys(regs, s.rows)
            names = batch.column(0).take(pa.array(np.repeat(np.arange(batch.num_rows), s.bands)))
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), names], names=["band", "cls"])

    return classes.select("cls", "regs").mapInArrow(spread, "band long, cls binary")


def compare(names, sizes, regs, sets, clusters, queries: range, against: range, s: Settings) -> list[tuple]:
    """Verified links that connect clusters: each query is compared with the later positions of ``against``."""
    first: dict = {}
    cluster = np.array([i if c is None else first.setdefault(c, i) for i, c in enumerate(clusters)], np.int64)
    out = []
    for i in queries:
        start = max(against.start, i + 1)
        if start >= against.stop:
            continue
        others = sizes[start : against.stop]
        fits = s.denominator * np.minimum(sizes[i], others) >= s.numerator * np.maximum(sizes[i], others)
        near = np.flatnonzero(fits & (cluster[start : against.stop] != cluster[i])) + start
        near = near[np.count_nonzero(regs[near] == regs[i], axis=1) >= s.fewest]
        if not len(near):
            continue
        guess = estimate(regs[i], regs[near], sizes[i], sizes[near])
        for j in near[np.argsort(-guess, kind="stable")][: int((guess >= s.floor).sum())]:
            if cluster[j] == cluster[i]:
                continue
            common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if s.linked(common, int(sizes[i]), int(sizes[j])):
                cluster[cluster == cluster[j]] = cluster[i]
                out.append((names[i], names[j]))
    return out


def links_in_tasks(rows: DataFrame, s: Settings) -> DataFrame:
    """(a, b) links found in each task; rows are (task, part, asks, cls, cluster, n, regs, items).

    Parts of a task are independent. In a part, all pairs are compared when every row asks; otherwise the
    rows that ask are compared with all.
    """

    def work(table: pa.Table) -> pa.Table:
        found: list[tuple] = []
        parts: dict = {}
        columns = [table.column(c).to_pylist() for c in ("part", "asks", "cls", "cluster", "n", "regs", "items")]
        for part, asks, *rest in zip(*columns):
            parts.setdefault(part, {}).setdefault((not asks, rest[0]), rest)
        for members in parts.values():
            # rows that ask come first; a class that asks is not also among the others
            order = sorted(members)
            asking = {name for other, name in order if not other}
            order = [k for k in order if not k[0] or k[1] not in asking]
            if len(order) < 2:
                continue
            rows = [members[k] for k in order]
            names, clusters = [r[0] for r in rows], [r[1] for r in rows]
            sizes = np.array([r[2] for r in rows], np.int64)
            regs = np.frombuffer(b"".join(r[3] for r in rows), np.uint16).reshape(len(rows), -1)
            sets = [np.frombuffer(r[4], np.uint64) for r in rows]
            found += compare(names, sizes, regs, sets, clusters, range(len(asking)), range(len(rows)), s)
        return pa.table({"a": pa.array([a for a, _ in found], pa.binary()), "b": pa.array([b for _, b in found], pa.binary())})

    packed = rows.select("task", "part", "asks", "cls", "cluster", "n", "regs", "items")
    return packed.groupBy("task").applyInArrow(work, "a binary, b binary")


def candidate_sets(df: DataFrame, wanted: DataFrame, id_col: str, text_col: str, s: Settings) -> DataFrame:
    """(cls, comp, n_blocks, block, n, regs, items): the full sets of the candidate classes, read from one text of each.

    ``wanted`` names for each class the id and the text hash of that text.
    """
    doc, text = named(id_col), named(text_col)
    texts = df.select(doc.alias("_doc"), F.xxhash64(text).alias("_hash"), text.alias("_text"))
    at = (F.col("_hash") == F.col("text_hash")) & F.col("_doc").eqNullSafe(F.col("rep"))
    rows = texts.join(wanted, at).select("cls", "comp", "n_blocks", "block", "regs", "_text")

    def read(batches):
        hashes = WordHashes()
        for batch in batches:
            keep, items = [], []
            for k, (cls, text) in enumerate(zip(batch.column(0), batch.column(5))):
                found = shingles(hashes.of(encode(text.as_py()).lower().split()), s.size)
                if xxhash.xxh3_128_digest(found.tobytes()) == cls.as_py():
                    keep.append(k)
                    items.append(found.tobytes())
            part = batch.take(pa.array(keep, pa.int64()))
            sizes = pa.array([len(x) // 8 for x in items], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*part.columns[:4], sizes, part.column(4), pa.array(items, pa.binary())],
                names=["cls", "comp", "n_blocks", "block", "n", "regs", "items"],
            )

    return rows.mapInArrow(read, "cls binary, comp binary, n_blocks int, block int, n long, regs binary, items binary")


def told(rows: DataFrame, facts: DataFrame, how: str = "inner") -> DataFrame:
    """Each class with the facts of its component; one component may hold most classes, so the key is salted."""
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt")
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("cls"), F.lit(SALTS)).cast("int"))
    return salted.join(facts.select("*", salts), ["comp", "_salt"], how).drop("_salt")


def _links(df: DataFrame, classes: DataFrame, id_col: str, text_col: str, s: Settings, block: int) -> DataFrame:
    """Written verified links between classes, enough to connect all that are connected."""
    bands = band_rows(classes, s)
    shared = bands.groupBy("band").agg(F.min("cls").alias("root"), F.max("cls").alias("_last")).filter(F.col("root") != F.col("_last"))
    stars = bands.join(shared.select("band", "root"), "band").filter(F.col("cls") != F.col("root")).select("cls", "root").distinct()
    found = components(stars, "cls", "root").select(F.col("id").alias("cls"), F.col("root").alias("comp"))
    comps = written(found.join(classes.select("cls", "n"), "cls"), "candidates")
    needed = F.ceil(F.greatest(F.count(F.lit(1)) / block, 8 * F.sum("n") / BLOCK_BYTES)).cast("int")
    sizes = comps.groupBy("comp").agg(needed.alias("_blocks")).filter(F.col("_blocks") > 1)  # few components have several
    placed = told(comps.drop("n"), sizes, "left").withColumn("n_blocks", F.coalesce("_blocks", F.lit(1)))
    placed = placed.select("cls", "comp", "n_blocks", F.pmod(F.hash("cls"), F.col("n_blocks")).alias("block"))
    wanted = placed.join(classes.select("cls", "rep", "text_hash", "regs"), "cls")
    sets = written(candidate_sets(df, wanted, id_col, text_col, s), "sets")

    packs = F.lit(max(1, comps.agg(needed.alias("packs")).first()["packs"] or 1))
    one = F.col("n_blocks") == 1
    # small components share tasks; a block of a large one has a task to itself
    own = sets.select(
        F.when(one, F.concat(F.lit("p"), F.pmod(F.hash("comp"), packs))).otherwise(F.concat_ws("/", F.hex("comp"), "block")).alias("task"),
        F.concat_ws("/", F.hex("comp"), "block").alias("part"), F.lit(True).alias("asks"), F.lit(None).cast("binary").alias("cluster"), "cls", "n", "regs", "items",
    )
    links = written(links_in_tasks(own, s), "links")
    large = sets.filter(~one)
    if large.isEmpty():
        drop(sets)
        drop(comps)
        return links

    def clustered(rows: DataFrame, links: DataFrame) -> DataFrame:
        labels = components(links, "a", "b").select(F.col("id").alias("cls"), F.col("root").alias("cluster"))
        return rows.join(labels, "cls", "left").withColumn("cluster", F.coalesce("cluster", "cls"))

    def spread(asking: DataFrame, base: DataFrame, name: str, links: DataFrame) -> DataFrame:
        """Compare the asking rows, in the groups ``_g``, with every block of their component; base has ``_groups``, their number."""
        columns = ["cls", "cluster", "n", "regs", "items"]
        key = F.concat_ws("/", F.hex("comp"), "_g", "_b").alias("task")
        ask = asking.withColumn("_b", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
        rest = base.withColumn("_g", F.explode(F.sequence(F.lit(0), F.col("_groups") - 1))).withColumn("_b", F.col("block"))
        ask = ask.select(key, key.alias("part"), F.lit(True).alias("asks"), *columns)
        rest = rest.select(key, key.alias("part"), F.lit(False).alias("asks"), *columns)
        more = links_in_tasks(ask.unionByName(rest), s)
        return written(links.unionByName(more), f"{name}-all")

    base = written(clustered(large, links), "clustered")
    found = spread(base.filter(F.col("block") == 0).withColumn("_g", F.lit(0)), base.withColumn("_groups", F.lit(1)), "first", links)
    drop(base)
    drop(links)
    base = written(clustered(large, found), "clustered")
    counts = base.groupBy("comp", "cluster").agg(F.count(F.lit(1)).alias("_n"))
    largest = counts.groupBy("comp").agg(F.max_by("cluster", F.struct("_n", "cluster")).alias("_top"))
    rest = told(base, largest).filter(F.col("cluster") != F.col("_top")).drop("_top")
    left = rest.groupBy("comp").agg(needed.alias("_groups"))
    rest = told(rest, left).withColumn("_g", F.pmod(F.xxhash64("cls", F.lit(1)), F.col("_groups")).cast("int"))
    links = spread(rest, told(base, left), "rest", found)
    for table in (base, found, sets, comps):
        drop(table)
    return links


def _grouped(df: DataFrame, id_col: str, text_col: str, s: Settings, block: int) -> DataFrame:
    """(doc, text_hash, n, cls, root, component_id) of every row; root is the smallest class of the component."""
    rows = written(sketch_documents(df, id_col, text_col, s), "sketches")
    found = rows.filter(F.col("n") > 0)
    # one text stands for a class: the one with the smallest id
    classes = found.groupBy("cls").agg(
        F.min("doc").alias("rep"), F.min_by("text_hash", F.struct(F.col("doc").isNull(), "doc", "text_hash")).alias("text_hash"),
        F.max("n").alias("n"), F.max("regs").alias("regs"),
    )
    classes = written(classes, "classes")
    links = _links(df, classes, id_col, text_col, s, block)
    labels = components(links, "a", "b").select(F.col("id").alias("cls"), "root")
    drop(links)
    rooted = classes.select("cls", "rep").join(labels, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    smallest = rooted.groupBy("root").agg(F.min("rep").alias("_least"))
    rooted = rooted.join(smallest, "root").select("cls", "root", "_least")
    out = rows.select("doc", "text_hash", "n", "cls").join(rooted, "cls", "left")
    return out.select("doc", "text_hash", "n", "cls", "root", F.coalesce("_least", "doc").alias("component_id"))


def near_duplicates(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings(), block: int = BLOCK
) -> DataFrame:
    """One row per row of ``df``: (id, n_shingles, component_id, kept)."""
    rows = _grouped(df, id_col, text_col, settings, block)
    kept = F.col("doc").eqNullSafe(F.col("component_id"))
    return rows.select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), "component_id", kept.alias("kept"))


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings(), block: int = BLOCK) -> DataFrame:
    """The rows of ``df``, with all columns, that stay when one row of each component is kept: a row with the smallest
    id. Of rows with equal id and text one stays; rows without words are never near-duplicates of different rows."""
    rows = _grouped(df, id_col, text_col, settings, block).filter(F.col("doc").eqNullSafe(F.col("component_id")))
    alone = F.col("root").isNull()  # such a row is compared with none, so its group is its id and text
    chosen = rows.groupBy("root", F.when(alone, F.col("doc")).alias("_doc"), F.when(alone, F.col("text_hash")).alias("_hash"))
    chosen = chosen.agg(F.min(F.struct("doc", "text_hash")).alias("_least"))
    own = {c.lower() for c in df.columns}
    doc, text_hash = (next(n for k in range(len(own) + 1) if (n := f"_{name}{k}") not in own) for name in ("near_doc", "near_hash"))
    chosen = chosen.select(F.col("_least.doc").alias("_a"), F.col("_least.text_hash").alias("_b"))
    keyed = df.withColumns({doc: named(id_col), text_hash: F.xxhash64(named(text_col))})
    kept = keyed.join(chosen, keyed[doc].eqNullSafe(chosen["_a"]) & (keyed[text_hash] == chosen["_b"]), "left_semi")
    return kept.dropDuplicates([doc, text_hash]).drop(doc, text_hash)
