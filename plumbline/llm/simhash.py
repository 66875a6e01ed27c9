"""SimHash fingerprints and Hamming search by permuted block tables, in DataFrame operations only.

Terms are pairs of neighbouring words (runs without white space; the first word also pairs with the start of the
text), weighted by how often they occur. Each occurrence votes with the bits of a 128-bit hash of its term, and
the fingerprint has a one where more than half of the votes are ones: 32 hexadecimal digits. Pairs are used
because single function words make all texts of a language alike. A text without words, like null, has no votes
and the fingerprint zero. Equal texts have equal fingerprints. Rows repeated with one id, rows without an id and texts of
any length are handled like others, further columns are ignored; an empty table gives an empty result.

Votes are counted two bits to a long, 32 bits each, which no text can overflow. All votes of a text are cast in
the task that holds it, so a shuffle carries one row per text.

The search cuts a fingerprint into 8 blocks of 16 bits. Fingerprints at most 6 bits apart agree in at least two
blocks, so one of the 28 tables keyed by a pair of blocks brings them together; each pair is made in the first
table that does. Copies share a fingerprint and count as one entry with a number of documents.
"""

from __future__ import annotations

import json
import math
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import body, cut, stored

BITS = 128
_LANES = 32
_MASK = (1 << 32) | 1
_SEEDS = (1, 2)
_SPACE = r"[\s]+"
BLOCKS, RADIUS = 8, 6
#: Ranges of ids in which neighbours are looked for; their bounds travel in the plan.
MAX_RANGES = 1 << 14


def _votes(term: Column) -> list[Column]:
    """Per half of the hash and bit below 32: a long that adds to both of its lanes."""
    halves = [F.xxhash64(term, F.lit(s)) for s in _SEEDS]
    return [F.sum(F.shiftrightunsigned(h, i).bitwiseAND(F.lit(_MASK))).alias(f"v{k}_{i}") for k, h in enumerate(halves) for i in range(_LANES)]


def fingerprints(texts: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, fingerprint`` for every text of ``texts`` (keys, text); the keys must tell rows apart."""
    words = F.split(F.translate(body(), "\n\t\r\x0b\f", "     "), " ")
    words = F.concat(F.array(F.lit("")), F.filter(words, lambda w: w != ""))
    rows = texts.select(*keys, F.explode(F.array(words)).alias("words"))
    terms = F.zip_with(F.slice("words", 1, F.size("words") - 1), F.slice("words", 2, F.size("words")), lambda a, b: F.xxhash64(a, b))
    # a text without words keeps its row with a null term
    terms = rows.select(*keys, F.explode_outer(terms).alias("term"))
    counts = terms.groupBy(*keys).agg(F.count("term").alias("n"), *(v for v in _votes(F.col("term"))))

    def half(k: int) -> Column:
        out = F.lit(0).cast("long")
        for i in range(_LANES):
            lanes = F.col(f"v{k}_{i}")
            for bit, ones in ((i, lanes.bitwiseAND(F.lit(0xFFFFFFFF))), (i + 32, F.shiftrightunsigned(lanes, 32))):
                out = out.bitwiseOR(F.when(ones * 2 > F.col("n"), F.lit((1 << bit) - ((1 << 64) if bit == 63 else 0))).otherwise(F.lit(0).cast("long")))
        return F.lpad(F.lower(F.hex(out)), 16, "0")

    voted = F.concat(half(0), half(1))
    return counts.select(*keys, F.when(F.col("n") > 0, voted).otherwise("0" * (BITS // 4)).alias("fingerprint"))


def _part(fingerprint: Column, k: int) -> Column:
    return F.conv(F.substring(fingerprint, 16 * k + 1, 16), 16, -10).cast("long")


def distance(a: Column, b: Column) -> Column:
    """Hamming distance of two fingerprints."""
    return reduce(lambda x, y: x + y, (F.bit_count(_part(a, k).bitwiseXOR(_part(b, k))) for k in range(2)))


def likeness(a: Column, b: Column) -> Column:
    return 1 - distance(a, b) / BITS


def near_counts(queries: DataFrame, prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """For every fingerprint of ``queries`` how many documents of ``prints`` lie within ``radius``.

    ``prints`` has ``fingerprint``, a row per document; every one is searched. Returns ``fingerprint, n_near``.
    """
    if radius > BLOCKS - 2:
        raise ValueError(f"two of {BLOCKS} blocks agree for certain only up to radius {BLOCKS - 2}")
    tables = list(combinations(range(BLOCKS), 2))
    digits = BITS // 4 // BLOCKS
    block = lambda f, k: F.substring(f, digits * k + 1, digits)
    entries = prints.groupBy("fingerprint").agg(F.count("*").alias("documents"))

    def dealt(rows: DataFrame, *more: str) -> DataFrame:
        f = F.col("fingerprint")
        keys = F.array(*(F.concat(F.lit(f"{t:02d}"), block(f, a), block(f, b)) for t, (a, b) in enumerate(tables)))
        return rows.select("fingerprint", *more, F.explode(keys).alias("key"))

    left = cut(dealt(queries.select("fingerprint").distinct()))
    right = cut(entries)
    right = dealt(right, "documents").withColumnRenamed("fingerprint", "other")
    same = [block(F.col("fingerprint"), k) == block(F.col("other"), k) for k in range(BLOCKS)]
    table = F.substring("key", 1, 2)
    first = reduce(lambda e, tab: F.when(same[tab[1][0]] & same[tab[1][1]], F.lit(f"{tab[0]:02d}")).otherwise(e), reversed(list(enumerate(tables))), F.lit(""))
    close = left.join(right, (left["key"] == right["key"]) & (distance(F.col("fingerprint"), F.col("other")) <= radius) & (F.substring(left["key"], 1, 2) == first))
    return close.groupBy("fingerprint").agg(F.sum("documents").alias("n_near"))


def _range_of(at: Column, cuts: list[int]) -> Column:
    """How many of the sorted ``cuts`` lie below ``at``: found in two steps, each over about a square root of them."""
    fan = max(1, math.isqrt(len(cuts)))
    groups = [cuts[k : k + fan] for k in range(0, len(cuts), fan)]
    count = lambda found: F.size(F.filter(found, lambda c: c < at))
    ends = F.from_json(F.lit(json.dumps([g[-1] for g in groups])), "array<bigint>")
    inner = F.from_json(F.lit(json.dumps([*groups, []])), "array<array<bigint>>")
    return F.element_at(F.transform(F.array(count(ends)), lambda g: g * fan + count(F.element_at(inner, g + 1))), 1)


def with_next(docs: DataFrame, rows_per_range: int = 2_000) -> DataFrame:
    """Add ``next_text``: that of the document that follows in descending order of id, after the last the first.

    Ids are cut at their quantiles into ranges of about ``rows_per_range`` rows (at most ``MAX_RANGES`` ranges), however
    they are spread, and a window finds the next row within a range; only the last row of a range looks up the first row of
    the next one. ``range, pos`` tell rows apart, ``next_range, next_pos`` point to the next one. Rows with one id share a
    range and follow each other by text; rows without an id come last, in ranges of their own by a hash of the text.
    """
    rows = docs.select(F.col("doc_id").cast("long"), body().alias("text")).withColumn("at", F.coalesce(F.bitwise_not("doc_id"), F.xxhash64("text")))
    size = rows.count()
    ranges = min(MAX_RANGES, max(1, -(-size // rows_per_range)))
    shares = [k / ranges for k in range(1, ranges)]
    cuts = rows.where("doc_id IS NOT NULL").agg(F.percentile_approx("at", shares, 10 * ranges)).first()[0] if shares else None
    cuts = sorted(set(cuts or []))
    own = F.when(F.col("doc_id").isNotNull(), _range_of(F.col("at"), cuts)).otherwise(F.lit(len(cuts) + 1) + F.pmod("at", F.lit(ranges)).cast("int"))
    rows = rows.withColumn("range", own)
    order = "PARTITION BY range ORDER BY at, text"
    inner = rows.select(
        "*",
        F.expr(f"lead(text) OVER ({order})").alias("in_text"),
        F.expr(f"row_number() OVER ({order})").alias("pos"),
        F.expr("count(*) OVER (PARTITION BY range)").alias("rows"),
    ).withColumn("is_last", F.col("pos") == F.col("rows"))
    # at most 2 * MAX_RANGES rows in all that follows
    least = F.broadcast(cut(rows.groupBy("range").agg(F.min("at").alias("at"))))
    heads = cut(rows.join(least, ["range", "at"]).groupBy("range").agg(F.min("text").alias("head")))
    after = heads.select("range", F.expr("lead(range) OVER (ORDER BY range)").alias("next"), F.expr("first(range) OVER (ORDER BY range)").alias("top"))
    after = after.select(F.col("range").alias("of"), F.coalesce("next", "top").alias("range"))
    heads = after.join(heads, "range").select(F.col("of").alias("range"), F.col("range").alias("out_range"), F.col("head").alias("out_text"))
    joined = inner.join(heads.withColumn("is_last", F.lit(True)), ["range", "is_last"], "left")
    last = F.col("is_last")
    return joined.select(
        "doc_id", "text", "range", "pos",
        F.when(last, F.col("out_range")).otherwise(F.col("range")).alias("next_range"),
        F.when(last, F.lit(1)).otherwise(F.col("pos") + 1).alias("next_pos"),
        F.when(last, F.col("out_text")).otherwise(F.col("in_text")).alias("next_text"),
    )


def edited_text(text: Column, other: Column) -> Column:
    """``text`` with its last floor(n/2) code points replaced by as many first ones of ``other`` (or all)."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substr(text, F.lit(1), F.length(text) - half), F.substr(other, F.lit(1), half))
