"""Best-fit packing of tokenised documents into sequences of bounded length.

Pieces of more than a third of the capacity fit a sequence at most twice, so they are matched first: the
longest with the longest that still fits beside it, which is optimal for pieces of that size. Shorter pieces
follow from long to short, each into the smallest gap that holds it. Only the number of pieces of each length
matters for that, so the plan is made from a histogram with at most ``capacity`` rows and lists runs of equal
placements; every piece then finds its place by its rank among the pieces of its length.

Null counts as the empty text. A document is the ids of its text and the closing id, so an empty one has
length 1. Only documents over the capacity are cut. Which of several pieces of one length goes where is not fixed; rows
repeated with one id, or without an id, are packed like any other. Columns beside doc_id and text are ignored. An
empty table gives an empty result.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.bpe import byte_letters
from plumbline.llm.common import stored

#: Groups in which ranks are counted: the pieces of one length are dealt into as many as it takes.
_RANK_GROUPS = 1 << 16
_RANK_ROWS = 128
_ROW = "__row"
#: The normaliser and splitter that :class:`WordIds` carries out itself, as tokenizers files state them.
_NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPLITTER = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: The same for texts without :data:`_OTHER` characters: of those that ``\w`` has, only these are neither letters nor 0-9.
_WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_²³¹¼½¾]+|[\d²³¹¼½¾]|(?:[^\s\w]|_)+")
#: Characters that Python and the library may class differently, and the zero byte, which marks the end of a word.
_OTHER = re.compile(r"[^\x01-\x1b\x20-\u0557\u2010-\u2027\u4e00-\u9fa5]")
#: Words over this go to the library, whose merging takes no quadratic time.
_WORD_CHARS = 400
#: Characters of texts whose distinct chunks are worked out together.
_SLICE_CHARS = 1 << 22


@lru_cache
def merges_alone(path: str) -> bool:
    """Whether the ids of a word depend on nothing but which strings the vocabulary has, in which order.

    That is so if every token is what its own letters are merged into: a pair of neighbours whose letters make up a token
    is then always the pair that this token is merged from.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, split = spec["model"], (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    if (
        (spec.get("normalizer") or {}).get("normalizers") != _NORMALIZER
        or split[0].get("pattern") != {"Regex": _SPLITTER}
        or [x.get("type") for x in split] != ["Split", "ByteLevel"]
        or model["type"] != "BPE"
        or model.get("end_of_word_suffix") != "</w>"
        or model.get("ignore_merges")
    ):
        return False
    pairs = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
    rank = {pair: k for k, pair in enumerate(pairs)}
    for a, b in pairs:
        ends = b.endswith("</w>")
        parts = list(a + (b[:-4] if ends else b))
        parts[-1] += "</w>" * ends
        while len(parts) > 1:
            best, at = min((rank.get(pair, len(rank)), k) for k, pair in enumerate(zip(parts, parts[1:])))
            if best == len(rank):
                return False
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return True


class WordIds:
    """Ids of whole texts, as the tokenizers library gives them.

    The vocabulary lower-cases, drops white space and merges within words only. Where ``direct`` says that its merges
    need no more than an order of strings (see :func:`merges_alone`), tiktoken merges the words, each with a zero byte for its end; a
    text with a special token's string, with characters of less common scripts, not in normal form or with a
    very long word goes to the library whole. No word crosses white space, so what stands between is split into words
    and merged once for all texts of a slice.
    """

    def __init__(self, path: str, direct: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.merger = self._merger(path) if direct else None

    def _merger(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        letters, vocabulary = byte_letters(), model["vocab"]
        raw = lambda token: bytes(letters[c] for c in token.removesuffix("</w>")) + b"\0" * token.endswith("</w>")
        pairs = ("".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"])
        # a zero byte ends a word and joins the byte before it first of all
        singles = [(bytes([b]), vocabulary.get(c, 0)) for c, b in letters.items()]
        closing = [(bytes([b, 0]), vocabulary.get(f"{c}</w>", 0)) for c, b in letters.items() if b]
        known = dict([*singles, *closing, *((raw(t), vocabulary[t]) for t in pairs)])
        self.ids = np.array(list(known.values()), "<u4")
        self.closes = np.array([b.endswith(b"\0") for b in known])
        return tiktoken.Encoding("words", pat_str=r"[^\x00]+\x00", mergeable_ranks={b: k for k, b in enumerate(known)}, special_tokens={})

    def _lowered(self, text: str) -> str | None:
        """The text that the words are found in, or nothing if the library has to do it all."""
        if not self.merger or any(s in text for s in self.special) or _OTHER.search(text) or not is_normalized("NFC", text):
            return None
        # the library lower-cases letter by letter, without a final sigma
        return text.replace("Σ", "σ").lower()

    def _merged(self, words: list[str]) -> np.ndarray:
        """Positions in ``self.ids`` of the tokens of one word after the other."""
        return self.merger.encode_to_numpy("\0".join([*words, ""]), disallowed_special=())

    def _whole(self, text: str, lowered: str | None) -> bytes:
        words = [] if lowered is None else _WORD.findall(lowered)
        if lowered is None or len(max(words, key=len, default="")) > _WORD_CHARS:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return self.ids[self._merged(words)].tobytes()

    def _slice(self, texts: list[str]) -> Iterator[bytes]:
        lowered = [self._lowered(t) for t in texts]
        chunks = pc.ascii_split_whitespace(pa.array(lowered, pa.string()))
        long = pc.greater(pc.binary_length(chunks.flatten()), _WORD_CHARS)
        apart = {k for k, t in enumerate(lowered) if t is None} | set(pc.list_parent_indices(chunks).filter(long).to_pylist())
        if len(apart) == len(texts):
            yield from map(self._whole, texts, lowered)
            return
        if apart:
            chunks = pc.ascii_split_whitespace(pa.array([None if k in apart else t for k, t in enumerate(lowered)], pa.string()))
        coded = chunks.flatten().dictionary_encode()
        words: list[str] = []
        ends = [0]  # of the chunks, in words
        for chunk in coded.dictionary.to_numpy(zero_copy_only=False).tolist():
            if chunk.isalpha():
                words.append(chunk)
            else:
                words += _WORD.findall(chunk)
            ends.append(len(words))
        found = self._merged(words)
        closed = np.concatenate([[0], np.flatnonzero(self.closes[found]) + 1])  # ends of the words, in tokens
        tokens = pa.ListArray.from_arrays(pa.array(closed[ends], pa.int32()), pa.array(self.ids[found])).take(coded.indices)
        ids, at = tokens.flatten().to_numpy(), tokens.offsets.to_numpy()[chunks.offsets.to_numpy()]
        for k, text in enumerate(texts):
            yield self._whole(text, lowered[k]) if k in apart else ids[at[k] : at[k + 1]].tobytes()

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of every text as little-endian unsigned 32-bit integers."""
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end]) <= _SLICE_CHARS):
                size += len(texts[end])
                end += 1
            yield from self._slice(texts[at:end])
            at = end

    def __call__(self, text: str) -> bytes:
        return next(self.encode([text]))


_TOKENIZERS: dict[str, WordIds] = {}


def _word_ids(path: str, direct: bool) -> WordIds:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordIds(path, direct)
    return _TOKENIZERS[path]


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """Tokenise ``docs`` (doc_id, text) and cut what is over ``capacity``: a row per piece.

    ``tokenizer`` is the path of a tokenizers file that every executor has. ``with_ids`` adds the ids.
    """
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    closing = np.array([end_id], "<u4").tobytes()
    step, direct = capacity * 4, merges_alone(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _word_ids(tokenizer, direct).encode
        for batch in batches:
            out: list[tuple] = []
            doc_ids, texts = (c.to_pylist() for c in batch.columns)
            for doc_id, found in zip(doc_ids, encode([t or "" for t in texts]), strict=True):
                raw = found + closing
                for k, at in enumerate(range(0, len(raw), step)):
                    part = raw[at : at + step]
                    row = (doc_id, k, at // 4, len(part) // 4, zlib.crc32(part))
                    out.append((*row, np.frombuffer(part, "<u4").astype(np.int32)) if with_ids else row)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            columns = list(zip(*out, strict=True)) if out else [()] * (5 + with_ids)
            yield pa.record_batch([pa.array(list(c), t) for c, t in zip(columns, kinds)], names[: len(columns)])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def plan(histogram: dict[int, int], capacity: int) -> np.ndarray:
    """Runs of placements: rows (length, first rank, pieces per sequence, first sequence, offset), sorted.

    Of the pieces of one length those from ``first rank`` up to the next run go into consecutive sequences, so
    many to each, from that offset.
    """
    runs: list[tuple[int, int, int, int, int]] = []
    ranks = dict.fromkeys(histogram, 0)
    gaps: list[int] = []  # sizes of gaps that some sequence has, sorted
    holders: dict[int, list[tuple[int, int]]] = {}  # by gap: (first sequence, number of sequences)
    sequences = 0

    def place(length: int, per: int, first: int, count: int, offset: int) -> None:
        runs.append((length, ranks[length], per, first, offset))
        ranks[length] += per * count

    def leave(gap: int, first: int, count: int) -> None:
        if gap and count:
            if gap not in holders:
                insort(gaps, gap)
                holders[gap] = []
            holders[gap].append((first, count))

    left = {n: c for n, c in histogram.items() if c and 3 * n > capacity}
    sizes = sorted(left)
    while sizes:
        long = sizes[-1]
        at = bisect_left(sizes, capacity - long + 1) - 1
        partner = sizes[at] if at >= 0 else 0
        if partner == long and left[long] == 1:
            partner = sizes[at - 1] if at > 0 else 0
        count = min(left[long], left[partner]) if partner not in (0, long) else left[long] // (2 if partner else 1)
        if partner == long:
            place(long, 2, sequences, count, 0)
        else:
            place(long, 1, sequences, count, 0)
            if partner:
                place(partner, 1, sequences, count, long)
        leave(capacity - long - partner, sequences, count)
        sequences += count
        left[long] -= count
        if partner:
            left[partner] -= count
        sizes = [n for n in sizes if left[n]] if not left[long] or (partner and not left[partner]) else sizes

    for length in sorted((n for n, c in histogram.items() if c and 3 * n <= capacity), reverse=True):
        need = histogram[length]
        while need:
            at = bisect_left(gaps, length)
            if at == len(gaps):
                per = capacity // length
                gap, first, count = capacity, sequences, -(-need // per)
                sequences += count
            else:
                gap = gaps[at]
                first, count = holders[gap].pop()
                if not holders[gap]:
                    del holders[gap]
                    gaps.pop(at)
            per = gap // length
            full = min(count, need // per)
            if full:
                place(length, per, first, full, capacity - gap)
                leave(gap - per * length, first, full)
                need -= full * per
            if full < count and need:  # fewer than fill a sequence are left
                place(length, need, first + full, 1, capacity - gap)
                leave(gap - need * length, first + full, 1)
                need, full = 0, full + 1
            leave(gap, first + full, count - full) if gap < capacity else None
    return np.array(sorted(runs), np.int64).reshape(-1, 5)


def ranked(pieces: DataFrame, histogram: dict[int, int]) -> DataFrame:
    """Add ``rank``, the place of a piece among those of its length, without gathering a length in one task.

    ``pieces`` is a stored table with the number of every row, so equal rows are dealt out like others.
    """
    spark = pieces.sparkSession
    rows = max(_RANK_ROWS, sum(histogram.values()) // _RANK_GROUPS)
    dealt = spark.createDataFrame([(n, -(-c // rows)) for n, c in histogram.items()], "length long, groups long")
    # at most `capacity` rows
    salted = pieces.join(F.broadcast(dealt), "length").withColumn(
        "salt", F.pmod(F.xxhash64(_ROW), F.col("groups"))
    )
    sizes = salted.groupBy("length", "salt").agg(F.count("*").alias("rows"))
    before = sizes.select(
        "length", "salt", F.expr("sum(rows) OVER (PARTITION BY length ORDER BY salt) - rows AS before")
    )  # at most _RANK_GROUPS + capacity rows, whatever the input
    within = salted.withColumn(
        "within", F.expr(f"row_number() OVER (PARTITION BY length, salt ORDER BY {_ROW})")
    )
    out = within.join(F.broadcast(before), ["length", "salt"])
    return out.withColumn("rank", F.col("before") + F.col("within") - 1).select(*pieces.columns, "rank")


def pack(pieces: DataFrame, capacity: int = 4096) -> DataFrame:
    """Give every piece a sequence and an offset: adds ``sequence_id long, offset long``.

    ``pieces`` (from :func:`token_pieces`) must be the same rows each time it is read, so it is stored first.
    """
    pieces = stored(pieces.withColumn(_ROW, F.monotonically_increasing_id()), "pieces")
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # <= capacity rows
    runs = plan(histogram, capacity)
    starts = runs[:, 0] << 44 | runs[:, 1]
    names = [n for n in pieces.columns if n != _ROW]

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            run = runs[np.searchsorted(starts, length << 44 | rank, "right") - 1]
            within = rank - run[:, 1]
            sequence = run[:, 3] + within // run[:, 2]
            offset = run[:, 4] + within % run[:, 2] * length
            yield pa.record_batch([*(batch.column(n) for n in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema if f.name != _ROW)
    return ranked(pieces, histogram).mapInArrow(locate, f"{fields}, sequence_id long, offset long")
