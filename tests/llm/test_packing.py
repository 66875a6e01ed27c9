import json
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from plumbline.llm import packing
from tokenizers import Tokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")


def _sequences(histogram, capacity):
    runs, out = packing.plan(histogram, capacity), defaultdict(list)
    for length, n in histogram.items():
        own = [r for r in runs.tolist() if r[0] == length]
        for rank in range(n):
            _, first, per, base, offset = [r for r in own if r[1] <= rank][-1]
            k = rank - first
            out[base + k // per].append((offset + k % per * length, length))
    return out


@settings(max_examples=60, deadline=None)
@given(st.integers(4, 90).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(1, c), max_size=120))))
def test_plan_fills_sequences_without_gaps(case):
    capacity, lengths = case
    histogram = dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True)), strict=True)) if lengths else {}
    sequences = _sequences(histogram, capacity)
    for placed in sequences.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= capacity
    assert sum(map(len, sequences.values())) == len(lengths)
    # large pieces alone need this many; first fit would guarantee less than twice the sum
    assert len(sequences) <= max(-(-2 * sum(lengths) // capacity), sum(3 * n > capacity for n in lengths), 1)


def test_pairs_of_large_pieces_are_optimal():
    assert len(_sequences({60: 2, 40: 2, 50: 2, 35: 1}, 100)) == 4


def test_pieces_equal_whole_text_encoding(spark, docs):
    tokenizer = Tokenizer.from_file(PATH)
    rows = packing.pack(packing.token_pieces(docs, PATH, capacity=64), capacity=64).collect()
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
    for doc_id, text in docs.distinct().collect():
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        found = {r.piece: r for r in by_doc[doc_id]}
        assert len(found) == -(-len(ids) // 64)
        for k, r in found.items():
            part = np.array(ids[k * 64 : (k + 1) * 64], "<u4")
            assert (r.start, r.length, r.ids_crc32) == (k * 64, len(part), zlib.crc32(part.tobytes()))
    filled = defaultdict(list)
    for r in rows:
        filled[r.sequence_id].append((r.offset, r.length))
    for placed in filled.values():
        placed.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(placed, placed[1:], strict=False)) and placed[0][0] == 0 and sum(n for _, n in placed) <= 64


def test_ids_and_edges(spark, odd_docs, no_docs):
    assert packing.pack(packing.token_pieces(no_docs, PATH)).count() == 0
    rows = packing.token_pieces(odd_docs, PATH, with_ids=True).collect()
    assert all(r.length == len(r.ids) for r in rows)
    assert sorted(r.length for r in rows if r.doc_id in (1, 2, 3)) == [1, 1, 1]
    assert sum(r.doc_id == 4 for r in rows) == 2


@settings(max_examples=80, deadline=None)
@given(st.integers(4, 60).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(1, c), max_size=80))))
def test_plan_fills_like_best_fit_piece_by_piece(case):
    capacity, lengths = case
    large, small = sorted(n for n in lengths if 3 * n > capacity), sorted((n for n in lengths if 3 * n <= capacity), reverse=True)
    gaps = []
    while large:
        gap = capacity - large.pop()
        partner = max((k for k, n in enumerate(large) if n <= gap), default=None)
        gaps.append(gap - (0 if partner is None else large.pop(partner)))
    for n in small:
        fits = [g for g in gaps if g >= n]
        best = min(fits, default=capacity)
        if fits:
            gaps.remove(best)
        gaps.append(best - n)
    histogram = dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True)), strict=True)) if lengths else {}
    assert sorted(capacity - sum(n for _, n in placed) for placed in _sequences(histogram, capacity).values()) == sorted(gaps)


def test_every_direct_character_like_the_library():
    assert packing.merges_alone(PATH)
    words, tokenizer = packing.WordIds(PATH, True), Tokenizer.from_file(PATH)
    texts = [f"a{c}b {c}1{c} '{c}s {c}." for c in map(chr, [*range(1, 0x600), *range(0x2000, 0x2040), *range(0x3000, 0x3010), 0x4E00, 0x9FA5, 0x1F642])]
    for text, found in zip(texts, tokenizer.encode_batch(texts, add_special_tokens=False), strict=True):
        assert words(text) == np.array(found.ids, "<u4").tobytes(), ascii(text)


_BITS = st.sampled_from(["the ", "ing", "'s", "'LL ", "don't", "Straße", "ſ", "Σ", "ΟΔΟΣ", "İ", "é", "é", " ", "\x85", "\x1c", "\x00", "²", "¾", "_", "__", "3.14", "…", "“x”", "日本", "я", "\n\t", "<|endoftext|>", "🙂", "x" * 500])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(_BITS, st.text(max_size=6)), max_size=12).map("".join))
def test_ids_of_hostile_texts_like_the_library(text):
    assert _WORDS(text) == np.array(_TOKENIZER.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


_WORDS, _TOKENIZER = packing.WordIds(PATH, True), Tokenizer.from_file(PATH)


def test_another_vocabulary_goes_to_the_library(tmp_path):
    spec = json.loads(open(PATH, encoding="utf-8").read())
    spec["normalizer"] = None
    (tmp_path / "other.json").write_text(json.dumps(spec))
    assert not packing.merges_alone(str(tmp_path / "other.json"))
    words = packing.WordIds(str(tmp_path / "other.json"), False)
    text = "Some Words, in CASE"
    assert words(text) == np.array(Tokenizer.from_file(str(tmp_path / "other.json")).encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_equal_rows_are_dealt_out(spark):
    from pyspark.sql import functions as F

    docs = spark.range(3000).select(F.lit(7).alias("doc_id"), F.lit("one two three").alias("text"))
    rows = packing.pack(packing.token_pieces(docs, PATH)).collect()
    assert len({(r.sequence_id, r.offset) for r in rows}) == 3000


def test_what_repeats_is_merged_once():
    words, merged = packing.WordIds(PATH, True), []

    class Counted:
        def encode_to_numpy(self, text, merger=words.merger, **options):
            merged.append(text.count("\0"))
            return merger.encode_to_numpy(text, **options)

    words.merger = Counted()
    text = "One, two and\tfoxglovery; " * 1000
    assert words(text) == np.array(_TOKENIZER.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert sum(merged) == 6


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.one_of(_BITS, st.text(max_size=4), st.just("a.b/" * 120)), max_size=8).map("".join), max_size=8), st.integers(1, 60))
def test_texts_of_a_slice_keep_their_ids(texts, size):
    before, packing._SLICE_CHARS = packing._SLICE_CHARS, size
    try:
        found = list(_WORDS.encode(texts))
    finally:
        packing._SLICE_CHARS = before
    assert found == [np.array(e.ids, "<u4").tobytes() for e in _TOKENIZER.encode_batch(texts, add_special_tokens=False)]
