import random

import numpy as np
import public_tokenizers
import pytest
from plumbline.llm import bpe
from tokenizers import Tokenizer

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    "", " ", "a  b", "<|endoftext|>", "x <|endoftext|> y", "don't  stop\n\n\nnow \t tab\r\nend ", "日本語 テスト ½ ⅷ ᾳ", "՘a ࢏", "a b c\x1cd \x00", "🙂🙂 🇫🇷",
    "'s'S'll  's", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa " * 3, "\n a \n b", "12345 1a2b ٣٤٥", "!!! ??? ... ,,,;;;", "trail   ", "word " * 3000,
]


@pytest.fixture(scope="module")
def pair():
    return bpe.TrieBpe(PATH), Tokenizer.from_file(PATH)


def test_like_the_library(pair):
    own, library = pair
    rng = random.Random(3)
    letters = "abcdeéßñ日🙂 \n'.,!1 " + "etaoin" * 3
    texts = TEXTS + ["".join(rng.choices(letters, k=rng.randrange(1, 80))) for _ in range(1500)]
    for text, raw in zip(texts, own.encode(texts), strict=True):
        ids = np.frombuffer(raw, "<u4").tolist()
        expected = library.encode(text, add_special_tokens=False).ids
        assert ids == expected, repr(text)
        assert own.decode(np.array(ids, int)) == library.decode(expected, skip_special_tokens=False) == text


def test_trie_starts_afresh_at_its_bound(pair, monkeypatch):
    monkeypatch.setattr(bpe, "_NODES", 50)
    monkeypatch.setattr(bpe, "_CACHE", 20)
    own, library = bpe.TrieBpe(PATH), pair[1]
    for _ in range(3):
        for text, raw in zip(TEXTS, own.encode(TEXTS), strict=True):
            assert np.frombuffer(raw, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_tables(spark, odd_docs, no_docs):
    encoded = bpe.encode(odd_docs, PATH)
    texts = {(r.doc_id, r.text) for r in bpe.decode(encoded, PATH).collect()}
    assert texts == {(r.doc_id, r.text or "") for r in odd_docs.collect()}
    rows = bpe.round_trip(odd_docs, PATH).collect()
    assert len(rows) == odd_docs.count() and sum(r.n_tokens == 0 for r in rows) == 2
    assert bpe.round_trip(no_docs, PATH).count() == 0
