"""Exact deduplication against immutable snapshots screened by static binary-fuse filters.

A snapshot holds one row per distinct digest of the documents it covers, dealt into shards by digest, and one
binary-fuse filter per shard; it can be saved and loaded. A new batch is first grouped by itself. Its distinct digests are then screened
shard by shard, a shard of a large batch in pieces: a negative is certainly new, a positive (nearly always a true one, about one in 256 is not)
joins the exact bucket of its digest, where the bytes of the two texts are compared.

Texts are equal when they are identical after deleting every space, tab, line feed, vertical tab, form feed
and carriage return. Null counts as the empty text, so null, empty and blank texts form one group. Of equal
texts the row with the most code points in its original text stays, then the one with the smallest id;
repeated rows (same id, same text) are each reported and share one ``keep_id``; ``kept`` marks all rows of
that id and text. An empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import body, cut, stored

BLANK = " \t\n\x0b\f\r"
#: Distinct digests per shard, on average: the unit in which a filter is built and probed.
SHARD_KEYS = 100_000
_BUILD_TRIES = 50


@dataclass(frozen=True)
class Snapshot:
    """Digests of documents seen before: ``buckets`` (digest, size, best) and ``filters`` (shard, filter)."""

    buckets: DataFrame
    filters: DataFrame
    shards: int

    def save(self, path: str) -> None:
        """Write the snapshot to a folder that must not exist yet: it never changes afterwards."""
        self.buckets.write.parquet(f"{path}/buckets")
        self.filters.withColumn("shards", F.lit(self.shards)).write.parquet(f"{path}/filters")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Snapshot:
        filters = spark.read.parquet(f"{path}/filters")
        some = filters.select("shards").first()
        return Snapshot(spark.read.parquet(f"{path}/buckets"), filters.drop("shards"), some["shards"] if some else 1)


def normalised(text: Column) -> Column:
    return F.translate(text, BLANK, "")


def with_digest(docs: DataFrame) -> DataFrame:
    """``doc_id``, length of the original text in code points, binary SHA-256 of the normalised text."""
    return docs.select(
        "doc_id",
        F.length(body()).cast("long").alias("n_chars"),
        F.unhex(F.sha2(normalised(body()), 256)).alias("digest"),
    )


def grouped(digests: DataFrame) -> DataFrame:
    """One row per digest: how many rows have it, and the row that stays as (-n_chars, doc_id)."""
    return digests.groupBy("digest").agg(
        F.count("*").alias("size"), F.min(F.struct((-F.col("n_chars")).alias("rank"), "doc_id")).alias("best")
    )


def _shard(digest: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(digest), F.lit(shards)).cast("int")


# --- binary-fuse filters (Graf and Lemire, "Binary Fuse Filters", 2022): three slots in adjacent segments ---


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    h = keys ^ np.uint64(seed)
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        h = (h ^ (h >> np.uint64(33))) * np.uint64(factor)
    return h ^ (h >> np.uint64(33))


def _slots(keys: np.ndarray, seed: int, segment: int, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Three slots and the 8-bit fingerprint of every key."""
    h = _mix(keys, seed)
    first = ((h >> np.uint64(32)) * np.uint64(segments)) >> np.uint64(32)
    base = first.astype(np.int64) * segment
    at = [(_mix(h, k) & np.uint64(segment - 1)).astype(np.int64) + base + (k - 1) * segment for k in (1, 2, 3)]
    return np.stack(at), (_mix(h, 4) & np.uint64(255)).astype(np.uint8)


def build_filter(keys: np.ndarray) -> bytes:
    """The filter of distinct 64-bit keys: a header (seed, segment length, segments) and one byte per slot."""
    n = len(keys)
    segment = 1 << max(2, min(18, int(np.floor(np.log(max(n, 2)) / np.log(3.33) + 2.25))))
    spread = max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 3)))
    segments = max(1, int(np.ceil(n * spread / segment)))
    size = (segments + 2) * segment
    for seed in range(1, _BUILD_TRIES):
        at, prints = _slots(keys, seed, segment, segments)
        count = np.bincount(at.ravel(), minlength=size)
        held = np.zeros(size, np.int64)
        for row in at:
            np.bitwise_xor.at(held, row, np.arange(n))
        rounds, left = [], n
        while left:
            lone = np.flatnonzero(count == 1)
            if not len(lone):
                break
            who, where = np.unique(held[lone], return_index=True)
            rounds.append((who, lone[where]))
            for row in at[:, who]:
                np.subtract.at(count, row, 1)
                np.bitwise_xor.at(held, row, who)
            left -= len(who)
        if not left:
            table = np.zeros(size, np.uint8)
            for who, slot in reversed(rounds):  # a lone slot belongs to one key of its round, so none clash
                table[slot] = 0
                table[slot] = prints[who] ^ table[at[0, who]] ^ table[at[1, who]] ^ table[at[2, who]]
            return np.array([seed, segment, segments], "<i8").tobytes() + table.tobytes()
    raise ValueError("binary-fuse construction failed; are the keys distinct?")


def in_filter(blob: bytes, keys: np.ndarray) -> np.ndarray:
    seed, segment, segments = (int(x) for x in np.frombuffer(blob[:24], "<i8"))
    table = np.frombuffer(blob, np.uint8, offset=24)
    at, prints = _slots(keys, seed, segment, segments)
    return table[at[0]] ^ table[at[1]] ^ table[at[2]] == prints


def _keys(digests: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(bytes(x)[:8] for x in digests), "<u8")


def snapshot(docs_or_groups: DataFrame) -> Snapshot:
    """Freeze documents (or groups from :func:`grouped`) into exact buckets and one filter per shard."""
    groups = docs_or_groups if "best" in docs_or_groups.columns else grouped(with_digest(docs_or_groups))
    buckets = cut(groups)
    shards = max(1, -(-buckets.count() // SHARD_KEYS))

    def build(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"shard": part["shard"].iloc[:1], "filter": [build_filter(np.unique(_keys(part["digest"])))]})

    filters = buckets.select(_shard(F.col("digest"), shards).alias("shard"), "digest")
    filters = cut(filters.groupBy("shard").applyInPandas(build, "shard int, filter binary"))
    return Snapshot(buckets, filters, shards)


def pieces(groups: DataFrame, known: Snapshot) -> tuple[DataFrame, int]:
    """The distinct digests of a batch as ``shard, piece, digest``, and how many pieces a shard has.

    A piece has about ``SHARD_KEYS`` digests at most, however large the batch is beside the snapshot.
    """
    n = max(1, -(-groups.count() // (SHARD_KEYS * known.shards)))
    piece = F.pmod(F.xxhash64("digest", F.lit("piece")), F.lit(n)).cast("int")
    return groups.select(_shard(F.col("digest"), known.shards).alias("shard"), piece.alias("piece"), "digest"), n


def screen(groups: DataFrame, known: Snapshot) -> DataFrame:
    """The distinct digests of a batch with ``maybe``: false means that the snapshot surely lacks it."""
    left, n = pieces(groups, known)
    filters = known.filters.select("shard", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("piece"), "filter")

    def probe(part: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
        hit = in_filter(filters["filter"].iloc[0], _keys(part["digest"])) if len(filters) and len(part) else False
        return part[["digest"]].assign(maybe=hit)

    keys = ["shard", "piece"]
    return left.groupBy(*keys).cogroup(filters.groupBy(*keys)).applyInPandas(probe, "digest binary, maybe boolean")


def _same_bytes(pairs: DataFrame, docs: DataFrame, known_docs: DataFrame) -> DataFrame:
    """Of pairs (digest, new_id, known_id) those whose normalised texts have the same bytes."""
    side = lambda column, rows: pairs.join(rows.select("doc_id", "text"), F.col(column).eqNullSafe(F.col("doc_id"))).select("digest", "text")
    texts = side("new_id", docs).unionByName(side("known_id", known_docs))
    texts = texts.select("digest", normalised(body()).alias("norm"))
    # ids that occur more than once may bring other texts along: only texts of this digest count
    texts = texts.where(F.unhex(F.sha2("norm", 256)) == F.col("digest"))
    same = texts.groupBy("digest").agg(F.min("norm").alias("low"), F.max("norm").alias("high"))
    return same.where("low = high").select("digest")


def _grouped_rows(docs: DataFrame, known_docs: DataFrame | None, known: Snapshot | None = None) -> DataFrame:
    """What :func:`exact_dedup` returns, and ``n_chars``."""
    digests = stored(with_digest(docs), "digests")
    new = cut(grouped(digests))
    if known_docs is None:
        merged, keys = new, ["digest"]
    else:
        known_digests = stored(with_digest(known_docs), "digests")
        known = known or snapshot(grouped(known_digests))
        positive = screen(new, known).where("maybe").select("digest")
        pairs = cut(
            positive.join(new.withColumnRenamed("best", "new_best").withColumnRenamed("size", "new_size"), "digest")
            .join(known.buckets.withColumnRenamed("best", "known_best").withColumnRenamed("size", "known_size"), "digest")
        )
        same = _same_bytes(pairs.select("digest", F.col("new_best.doc_id").alias("new_id"), F.col("known_best.doc_id").alias("known_id")), docs, known_docs)
        # only digests that both sides have need merging; one without equal bytes would be a collision of SHA-256: its sides stay apart
        common = cut(pairs.join(same, "digest").select("digest", (F.col("new_size") + F.col("known_size")).alias("all"), F.least("new_best", "known_best").alias("first")))
        sides = new.withColumn("known", F.lit(False)).unionByName(known.buckets.withColumn("known", F.lit(True)))
        merged = sides.join(common, "digest", "left").select("digest", "known", F.coalesce("all", "size").alias("size"), F.coalesce("first", "best").alias("best"))
        digests = digests.withColumn("known", F.lit(False)).unionByName(known_digests.withColumn("known", F.lit(True)))
        keys = ["digest", "known"]
    best = F.col("best")
    return digests.join(merged, keys).select(
        "doc_id",
        best["doc_id"].alias("keep_id"),
        F.col("size").alias("group_size"),
        (F.col("doc_id").eqNullSafe(best["doc_id"]) & (F.col("n_chars") == -best["rank"])).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        "n_chars",
    )


def exact_dedup(docs: DataFrame, known_docs: DataFrame | None = None, known: Snapshot | None = None) -> DataFrame:
    """Group a batch by equal text, within itself and with the documents of an earlier snapshot.

    ``known`` is the snapshot of ``known_docs`` where there is one already. Returns a row for every row of both:
    ``doc_id, keep_id, group_size, kept, text_sha256``.
    """
    return _grouped_rows(docs, known_docs, known).drop("n_chars")


def _halves(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """The newer half of a table by ``doc_id``, to which rows without an id belong, and the older half if there is one."""
    ends = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    if ends[0] is None:
        return docs, None
    older = F.coalesce(F.col("doc_id") <= F.lit((ends[0] + ends[1]) // 2), F.lit(False))
    return docs.where(~older), docs.where(older)


def dedup_arrivals(docs: DataFrame) -> DataFrame:
    """:func:`exact_dedup` of one table that arrived in two halves by ``doc_id``: the older half is the snapshot.

    Every row of both halves is read, compared and reported; a null id belongs to the newer half.
    """
    return exact_dedup(*_halves(docs))


def keep_first(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns: one row of every group of equal texts.

    Of rows of one group with the same id and length, any one stays.
    """
    kept = _grouped_rows(*_halves(docs)).where("kept").groupBy("doc_id", "text_sha256", "n_chars").count()
    kept = stored(kept.select(*(F.col(c).alias(f"__{c}") for c in kept.columns)), "kept")
    marked = docs.withColumn("__sha", F.sha2(normalised(body()), 256)).withColumn("__chars", F.length(body()))
    same = F.col("doc_id").eqNullSafe(F.col("__doc_id")) & (F.col("__sha") == F.col("__text_sha256")) & (F.col("__chars") == F.col("__n_chars"))
    once = marked.join(kept.where("__count = 1"), same, "left_semi")
    more = kept.where("__count > 1")
    if not more.isEmpty():
        once = once.unionByName(marked.join(more, same, "left_semi").dropDuplicates(["doc_id", "__sha"]))
    return once.drop("__sha", "__chars")
