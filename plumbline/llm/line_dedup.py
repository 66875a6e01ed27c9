"""Removal of line passages that repeat anywhere in the corpus.

A window is three consecutive lines of one document. Lines count without the white space at their ends, and
lines that are blank then are layout, so they belong to no window. Windows are hashed, equal hashes are found
over the whole corpus, and the first window (least doc_id, then least hash of the text, then least position) stays. The lines that any
later occurrence covers are merged and removed: overlapping windows make one removed stretch. The earliest
copy of every line is never removed, because whatever removes a line has an earlier copy of it.

A document with fewer than three lines has no window and stays as it is; so do null texts (null stays null)
and empty ones. Of repeated rows with one id and text, all windows have the same place, and the rows stay or go
together; rows with one id and other texts are documents of their own. Rows without an id come after all others.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import body, cut, stored

#: White space at the ends of a line, which does not count.
ENDS = " \t\r\x0b\f"


def _trimmed(line: Column) -> Column:
    return F.trim(line, F.lit(ENDS))


def _key() -> Column:
    """What tells documents apart and orders them; a struct equals another one also where both hold null."""
    return F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(body()).alias("mark"))


def windows(docs: DataFrame, width: int = 3) -> DataFrame:
    """``key, pos, window``: the MD5 of every run of ``width`` lines, from the ``pos``-th line that isn't blank."""
    lines = F.filter(F.transform(F.split(body(), "\n"), _trimmed), lambda x: x != "")
    # explode() of a one-element array makes Spark compute the lines once instead of once per use
    rows = docs.select(_key().alias("key"), F.explode(F.array(lines)).alias("lines")).where(F.size("lines") >= width)
    starts = F.sequence(F.lit(0), F.size("lines") - width)
    hashes = F.transform(starts, lambda i: F.md5(F.array_join(F.slice("lines", i + 1, width), "\n").cast("binary")))
    return rows.select("key", F.posexplode(hashes).alias("pos", "window")).withColumn("window", F.unhex("window"))


def later_windows(found: DataFrame) -> DataFrame:
    """The windows that repeat an earlier one: ``key, pos``."""
    first = found.groupBy("window").agg(F.count("*").alias("n"), F.min(F.struct("key", "pos")).alias("first"))
    repeated = cut(first.where("n > 1").select("window", "first"))
    later = found.join(repeated, "window").where(F.struct("key", "pos") != F.col("first"))
    return later.select("key", "pos").distinct()


def dedup_lines(docs: DataFrame, width: int = 3) -> DataFrame:
    """``doc_id, text`` without repeated passages, with ``n_lines`` (not blank), ``n_removed`` and ``removed``.

    ``removed`` lists the stretches taken out as (first, last) among the lines that aren't blank.
    """
    later = later_windows(stored(windows(docs, width), "windows"))
    starts = later.groupBy("key").agg(F.sort_array(F.collect_list("pos")).alias("starts"))

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, text, begins in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                spans: list[list[int]] = []
                for at in begins or ():
                    if spans and at <= spans[-1][1] + 1:
                        spans[-1][1] = at + width - 1
                    else:
                        spans.append([at, at + width - 1])
                lines, counted, gone, kept = (text or "").split("\n"), 0, 0, []
                for line in lines:
                    if not line.strip(ENDS):
                        kept.append(line)
                        continue
                    while gone < len(spans) and spans[gone][1] < counted:
                        gone += 1
                    if gone == len(spans) or counted < spans[gone][0]:
                        kept.append(line)
                    counted += 1
                removed = sum(b - a + 1 for a, b in spans)
                out.append((doc_id, "\n".join(kept) if spans else text, counted, removed, [{"first": a, "last": b} for a, b in spans]))
            yield pa.Table.from_pylist(
                [dict(zip(kind.names, row, strict=True)) for row in out], schema=kind
            ).combine_chunks().to_batches()[0] if out else pa.record_batch([pa.array([], t) for t in kind.types], kind.names)

    span = pa.struct([("first", pa.int32()), ("last", pa.int32())])
    kind = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("n_lines", pa.int32()), ("n_removed", pa.int32()), ("removed", pa.list_(span))])
    rows = docs.select(_key().alias("key"), F.col("doc_id").cast("long"), "text").join(starts, "key", "left").select("doc_id", "text", "starts")
    return rows.mapInArrow(rebuild, "doc_id long, text string, n_lines int, n_removed int, removed array<struct<first:int,last:int>>")
