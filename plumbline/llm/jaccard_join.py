"""Join of documents whose five-word shingles have a Jaccard similarity of at least a threshold.

Words are runs without white space, taken as they stand; a document of fewer than five words has one shingle of
all of them, and one without words (null, empty, blank) has none and is linked to nothing.

1. Documents with equal shingle sets form a class with the least id as its representative; only representatives
   go on, with the size of their class, so copies are never compared with each other.
2. MinHash values are banded. Representatives that share a band are joined to the least one of the band, and the
   connected components of these candidate links say which documents may have to do with each other.
3. A component is cut into blocks by the first MinHash value, so that like documents are near each other, and blocks
   that share a band (in a dense component all) are compared, two in a task: all pairs between them are screened by comparing MinHash values a
   few at a time and dropping each pair as soon as the posterior probability (uniform prior) that its similarity
   reaches the threshold is below the tolerance. What is left is verified exactly on the shingles. A task returns
   link counts and a spanning forest of its links, never the pairs, so a group of many near copies costs comparisons
   in many tasks but no rows, and a component that is long rather than dense costs few comparisons.
4. Connected components of the forests are the groups. ``n_links`` counts the other documents (each copy counts)
   that a document is similar enough to.

With the default bands a pair at the threshold shares no band with probability (1 - 0.8^8)^64, about 8e-6.
Repeated rows with one id count as copies; different texts under one id share its group. A row without an id is
a copy of the rows with the same shingles; where none of them has an id, their class_id and copy_of are null, they count
each other as links and nothing else, as nothing could name them. Columns beside doc_id and text are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import body, connected_components, cut, stored

WORDS, THRESHOLD, TOLERANCE = 5, 0.8, 1e-6
BANDS, ROWS = 64, 8
#: MinHash values that the screening compares, and how many at a time.
SCREEN, STEP = 128, 16
#: Documents of a block; a task holds the shingles of two blocks.
BLOCK = 100
#: Parts into which the rows of a large group are dealt to learn its size.
SALTS = 64
#: Rows per document that the join of a component's blocks on their bands may make.
SPOTS = 4
#: Words whose hashes a Python worker remembers during a task.
_CACHE_WORDS = 120_000
_VOCABULARY = 8192

_random = np.random.default_rng(20240501)
_FACTORS = (_random.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1))[:, None]
_SHIFTS = _random.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)[:, None]
_POWERS = _random.integers(0, 1 << 63, ROWS, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)


class _WordHash(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= _CACHE_WORDS:
            self.clear()
        value = int.from_bytes(blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        self[word] = value
        return value


_WORD_HASH = _WordHash()


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return h ^ (h >> np.uint64(29))


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles."""
    tokens = text.split()
    h = np.fromiter(map(_WORD_HASH.__getitem__, tokens), np.uint64, len(tokens))
    if not len(h):
        return h
    n = max(1, len(h) - words + 1)
    out = np.zeros(n, np.uint64)
    for k in range(min(words, len(h))):
        out = out * _BASE + h[k : k + n]
    return np.unique(_mixed(out))


def minhash(found: np.ndarray, count: int = BANDS * ROWS) -> np.ndarray:
    """``count`` MinHash values of a non-empty set of shingles."""
    low = (found >> np.uint64(32)).astype(np.uint32)
    best = np.full(count, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 1024):
        part = (low[None, at : at + 1024] ^ _SHIFTS[:count]) * _FACTORS[:count]
        np.minimum(best, part.min(axis=1), out=best)
    return best


def least_matches(threshold: float, tolerance: float, screen: int = SCREEN, step: int = STEP) -> list[int]:
    """After each ``step`` values: how many must match for the pair to go on.

    With a uniform prior, P(similarity >= t | m of n match) is P(Binomial(n + 1, t) <= m).
    """
    needed = []
    for n in range(step, screen + 1, step):
        tail, m = 0.0, -1
        while tail < tolerance:
            m += 1
            tail += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        needed.append(m)
    return needed


def _digest(found: np.ndarray) -> bytes:
    return blake2b(found.tobytes(), digest_size=16).digest()


def sketches(docs: DataFrame) -> DataFrame:
    """``doc_id, set_key, near, bands``: a digest of the shingle set, its first MinHash value and one hash per band.

    Without words the first two are null and there are no bands.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, near, bands = [], [], []
            for text in batch.column(1).to_pylist():
                found = shingles(text)
                keys.append(_digest(found) if len(found) else None)
                if len(found):
                    values = minhash(found).reshape(BANDS, ROWS).astype(np.uint64)
                    near.append(int(values[0, 0]))
                    bands.append(_mixed((values * _POWERS).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * _BASE).view(np.int64))
                else:
                    near.append(None)
                    bands.append(np.zeros(0, np.int64))
            columns = [batch.column(0), pa.array(keys, pa.binary()), pa.array(near, pa.int64()), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.record_batch(columns, ["doc_id", "set_key", "near", "bands"])
        _WORD_HASH.clear()

    return docs.select(F.col("doc_id").cast("long"), body().alias("text")).mapInArrow(run, "doc_id long, set_key binary, near long, bands array<long>")


def candidate_components(classes: DataFrame) -> DataFrame:
    """``rep, component`` for the representatives that share a band with another one."""
    rows = classes.select("rep", F.explode("bands").alias("band"))
    shared = cut(rows.groupBy("band").agg(F.min("rep").alias("least"), F.max("rep").alias("most")).where("least < most").select("band", "least"))
    links = rows.join(shared, "band").where("rep <> least").select(F.col("rep").alias("a"), F.col("least").alias("b"))
    return connected_components(links).select(F.col("node").alias("rep"), "component")


def _common(sets: list[np.ndarray], rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of every set in ``rows`` with every set in ``cols``."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, word, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times[word] > 1
    owner, word = owner[shared], word[shared]
    _, word = np.unique(word, return_inverse=True)
    out = np.zeros((len(rows), len(cols)), np.float32)
    order = np.argsort(word, kind="stable")
    owner, word = owner[order], word[order]
    size = int(word[-1]) + 1 if len(word) else 0
    for at in range(0, size, _VOCABULARY):
        a, b = np.searchsorted(word, [at, at + _VOCABULARY])
        held = np.zeros((len(sets), min(_VOCABULARY, size - at)), np.float32)
        held[owner[a:b], word[a:b] - at] = 1
        out += held[rows] @ held[cols].T
    return out


def compare(left: list[tuple], right: list[tuple] | None, threshold: float, needed: list[int]) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Links within one block (``right`` None) or between two; members are (rep, size, values, shingles).

    Returns link counts for the members of left then right, weighted by class size, and a spanning forest.
    """
    members = left + (right or [])
    first, second = np.arange(len(left)), np.arange(len(left), len(members)) if right is not None else np.arange(len(left))
    sizes = np.array([len(m[3]) for m in members])
    small = np.minimum.outer(sizes[first], sizes[second])
    alive = small >= threshold * np.maximum.outer(sizes[first], sizes[second])
    if right is None:
        alive &= np.tri(len(left), k=-1, dtype=bool)
    a, b = np.nonzero(alive)
    values = np.stack([m[2] for m in members])
    matches = np.zeros(len(a), np.int64)
    for k, least in enumerate(needed):
        if not len(a):
            break
        part = values[:, k * STEP : (k + 1) * STEP]
        matches += (part[first[a]] == part[second[b]]).sum(axis=1)
        go = matches >= least
        a, b, matches = a[go], b[go], matches[go]
    counts, forest = np.zeros(len(members), np.int64), []
    if len(a):
        rows, cols = np.unique(a), np.unique(b)
        used = np.unique(np.concatenate([first[rows], second[cols]]))
        common = _common([members[i][3] for i in used], np.searchsorted(used, first[rows]), np.searchsorted(used, second[cols]))
        both = common[np.searchsorted(rows, a), np.searchsorted(cols, b)].astype(np.int64)
        i, j = first[a], second[b]
        linked = both >= threshold * (sizes[i] + sizes[j] - both) - 1e-9
        i, j = i[linked], j[linked]
        weight = np.array([m[1] for m in members])
        np.add.at(counts, i, weight[j])
        np.add.at(counts, j, weight[i])
        root = list(range(len(members)))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        for x, y in zip(i.tolist(), j.tolist(), strict=True):
            rx, ry = find(x), find(y)
            if rx != ry:
                root[max(rx, ry)] = min(rx, ry)
                forest.append((members[x][0], members[y][0]))
    return counts, forest


def _with_parts(rows: DataFrame, keys: list[str], most: int) -> tuple[DataFrame, DataFrame]:
    """``rows`` with ``parts``, into how many blocks a group of more than ``most`` rows is to be cut (null: none), and these numbers.

    Only such groups need their size. Each of their rows goes to one of ``SALTS`` copies of it.
    """
    large = rows.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > most)
    large = cut(large.select(*keys, F.ceil(F.col("n") / BLOCK).cast("int").alias("parts"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")))
    return rows.withColumn("salt", F.pmod(F.hash("rep"), F.lit(SALTS))).join(large, [*keys, "salt"], "left").drop("salt"), large


def blocks_of(components: DataFrame, classes: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Every representative's block (0 in a component of one), and which blocks are to be compared, None if there is nothing to choose.

    A large component is dealt into cells by the first MinHash value, which like documents mostly have in common, and
    a crowded cell into further parts by id. ``component, block, i, j`` has two rows for a pair of blocks that share a
    band, one for each of them, and one for a block with itself.
    """
    placed, large = _with_parts(components, ["component"], BLOCK)
    if large.isEmpty():
        return components.withColumn("block", F.lit(0).cast("long")), None
    placed = placed.withColumnRenamed("parts", "cells")
    spread = placed.where("cells IS NOT NULL").join(classes.select("rep", "near", "bands"), "rep")
    spread = spread.withColumn("cell", F.pmod(F.xxhash64("near"), F.col("cells")))
    spread, _ = _with_parts(spread, ["component", "cell"], 2 * BLOCK)
    part = F.pmod(F.xxhash64("rep"), F.coalesce("parts", F.lit(1)))
    spread = stored(spread.select("rep", "component", "bands", (F.shiftleft("cell", 32) + part).alias("block")), "spread")
    spots = stored(spread.select("component", "block", F.explode("bands").alias("band")).distinct(), "spots")
    pairs = _block_pairs(spread, spots)
    ends = F.when(F.col("i") == F.col("j"), F.array("i")).otherwise(F.array("i", "j"))
    partners = stored(pairs.select("component", F.explode(ends).alias("block"), "i", "j"), "partners")
    alone = placed.where("cells IS NULL").select("rep", "component", F.lit(0).cast("long").alias("block"))
    return alone.unionByName(spread.select("rep", "component", "block").distinct()), partners


def _block_pairs(spread: DataFrame, spots: DataFrame) -> DataFrame:
    """``component, i, j`` for the pairs of blocks to be compared, i up to j: at least all that share a band.

    How many rows a join of the blocks on their bands would make is known from counts. Where that is more than ``SPOTS`` a
    document and more than there are pairs of blocks, as in a dense group, whose blocks share most bands many times over, all pairs
    of blocks are listed once instead.
    """
    held = spots.groupBy("component", "band").agg(F.count("*").alias("m"))
    joined = held.groupBy("component").agg(F.sum(F.expr("m * (m + 1) / 2")).alias("joined"))
    sizes = spread.groupBy("component").agg(F.count("*").alias("n"))
    blocks = spots.select("component", "block").distinct()
    counts = blocks.groupBy("component").agg(F.count("*").alias("blocks")).join(joined, "component").join(sizes, "component")
    counts = counts.withColumn("dense", F.expr(f"joined > {SPOTS} * n AND joined > blocks * (blocks + 1) / 2"))
    counts = cut(counts.select("component", "dense"))
    sparse = spots.join(counts.where("NOT dense").select("component"), "component").join(held.where("m > 1").select("component", "band"), ["component", "band"])
    one, other = sparse.withColumnRenamed("block", "i"), sparse.withColumnRenamed("block", "j")
    by_band = one.join(other, ["component", "band"]).where("i < j").select("component", "i", "j").distinct()
    whole = blocks.join(counts.where("dense").select("component"), "component")
    one, other = whole.withColumnRenamed("block", "i"), whole.withColumnRenamed("block", "j")
    listed = one.join(other, "component").where("i < j").select("component", "i", "j")
    alone = blocks.select("component", F.col("block").alias("i"), F.col("block").alias("j"))
    return by_band.unionByName(listed).unionByName(alone)


def _members(docs: DataFrame, placed: DataFrame, classes: DataFrame) -> DataFrame:
    """The representatives in candidate components, with their block, size of the class, values and shingles."""
    placed = placed.join(classes.select("rep", "size", "set_key"), "rep")
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), body().alias("text"))
    rows = placed.join(texts, "rep").select("rep", "size", "component", "block", "set_key", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(t) for t in batch.column("text").to_pylist()]
            # another text under the same id is not the representative
            own = [_digest(s) == k for s, k in zip(found, batch.column("set_key").to_pylist(), strict=True)]
            batch, found = batch.filter(pa.array(own, pa.bool_())), [s for s, k in zip(found, own, strict=True) if k]
            values = [minhash(s, SCREEN).astype("<u2").tobytes() for s in found]
            keep = ["rep", "size", "component", "block"]
            yield pa.record_batch([*(batch.column(c) for c in keep), pa.array(values, pa.binary()), pa.array([s.astype("<u8").tobytes() for s in found], pa.binary())], [*keep, "values", "shingles"])
        _WORD_HASH.clear()

    return rows.mapInArrow(run, "rep long, size long, component long, block long, values binary, shingles binary")


def verified(members: DataFrame, partners: DataFrame | None, threshold: float, tolerance: float) -> DataFrame:
    """Rows of two kinds: (rep, links) with what one task counted, and (rep, other) for an edge of a forest.

    Without ``partners`` every block is compared with itself; Spark broadcasts them where they are few.
    """
    needed = least_matches(threshold, tolerance)
    i, j = F.col("block"), F.col("block")
    if partners is not None:
        members = members.join(partners, ["component", "block"], "left")
        i, j = F.coalesce("i", "block"), F.coalesce("j", "block")
    units = members.select("component", i.alias("i"), j.alias("j"), "block", "rep", "size", "values", "shingles")
    units = units.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, held, seen = None, ([], []), set()
        out: list[tuple] = []

        def done() -> None:
            left, right = held
            if unit is None or (unit[1] != unit[2] and not (left and right)):
                return
            counts, forest = compare(left, right if unit[1] != unit[2] else None, threshold, needed)
            out.extend((m[0], int(n), None) for m, n in zip(left + right, counts, strict=True) if n)
            out.extend((x, None, y) for x, y in forest)

        def flushed() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) if out else [(), (), ()]
            out.clear()
            return pa.record_batch([pa.array(list(c), pa.int64()) for c in columns], ["rep", "links", "other"])

        for batch in batches:
            for component, i, j, block, rep, size, values, found in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if unit != (component, i, j):
                    done()
                    unit, held, seen = (component, i, j), ([], []), set()
                if (rep, values) in seen:  # a repeated row of the representative
                    continue
                seen.add((rep, values))
                held[block != i].append((rep, size, np.frombuffer(values, "<u2"), np.frombuffer(found, "<u8")))
            yield flushed()
        done()
        yield flushed()

    return units.mapInArrow(run, "rep long, links long, other long")


def jaccard_groups(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """``doc_id, class_id, copy_of, n_links`` for every document.

    ``class_id`` is the least id of the group of documents connected by links, ``copy_of`` the least id of those
    with the same shingles, ``n_links`` the number of other documents at least ``threshold`` similar.
    """
    drawn = stored(sketches(docs), "sketches")
    classes = drawn.where("set_key IS NOT NULL").groupBy("set_key").agg(
        F.min("doc_id").alias("rep"), F.count("*").alias("size"), F.first("near").alias("near"), F.first("bands").alias("bands")
    )
    classes = stored(classes, "classes")
    components = cut(candidate_components(classes))
    placed, partners = blocks_of(components, classes)
    found = stored(verified(_members(docs, placed, classes), partners, threshold, tolerance), "links")
    groups = connected_components(found.where("other IS NOT NULL").select(F.col("rep").alias("a"), F.col("other").alias("b")))
    links = found.where("links IS NOT NULL").groupBy("rep").agg(F.sum("links").alias("links"))
    known = classes.select("set_key", "rep", "size").join(links, "rep", "left").join(groups.withColumnRenamed("node", "rep"), "rep", "left")
    known = cut(known.select(
        "set_key",
        F.col("rep").alias("copy_of"),
        F.coalesce("component", "rep").alias("class_id"),
        (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"),
    ))
    out = drawn.select("doc_id", "set_key").join(known, "set_key", "left")
    return out.select(
        "doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("copy_of", "doc_id").alias("copy_of"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")
    )


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that stay, with all their columns: those with the least id of each group, and rows without an id.

    The ids that go are stored first, so Spark knows how large they are: it broadcasts a small table, and the texts
    stay where they are; beyond its threshold both sides are shuffled.
    """
    stays = F.max(F.col("doc_id") == F.col("class_id"))
    groups = jaccard_groups(docs, threshold).groupBy("doc_id").agg(stays.alias("stays"))
    gone = stored(groups.where("NOT stays").select(F.col("doc_id").alias("gone_id")), "gone")
    return docs.join(gone, docs["doc_id"] == gone["gone_id"], "left_anti")
