"""Byte-level BPE over a trie of distinct words.

The encoding of a word is fixed by the last tokens of the encodings of its prefixes: the last token of a prefix is
the only vocabulary entry that ends there and may follow the last token of what stands before it, where a token
may follow another if BPE leaves the two side by side. Distinct words are therefore put into a trie and walked
depth first; each node gets its last token once, whatever number of words share it, and a word's tokens are read
back from its end. A Python worker keeps its trie from task to task, up to a bounded number of nodes, and inserts
the new words of some texts at a time.

Null counts as the empty text and has no tokens. A special token's string in a text becomes that token, as the
tokenizers library has it. Texts of any length are handled whole; repeated rows are each encoded.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import body

#: The published pre-tokenisation pattern of this kind of vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Chunks and words whose ids a Python worker remembers; at the limit it forgets them all and goes on.
_CACHE = 300_000
#: Nodes of a worker's trie; beyond it starts afresh.
_NODES = 1_000_000
_SLICE_CHARS = 1 << 20


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in vocabulary files: printable Latin-1 as is, others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class TrieBpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        raw = lambda token: bytes(letters[c] for c in token)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.ids = {raw(t): n for t, n in spec["model"]["vocab"].items() if t not in self.special}
        size = max(*self.ids.values(), *self.special.values()) + 1
        self.bytes_of = [b""] * size
        for token, n in self.ids.items():
            self.bytes_of[n] = token
        for text, n in self.special.items():
            self.bytes_of[n] = text.encode()
        pairs = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
        self.rank = {(self.ids[raw(a)], self.ids[raw(b)]): k for k, (a, b) in enumerate(pairs)}
        self.merged = {(a, b): self.ids[self.bytes_of[a] + self.bytes_of[b]] for a, b in self.rank}
        self.longest = max(map(len, self.ids))
        self.pattern = regex.compile(PATTERN)
        # white space but spaces and line feeds; a zero byte marks the places to cut
        self.other_space = re.compile(r"[^\S \n]|\x00")
        # where Unicode versions may class letters differently, the library splits the text itself
        self.exotic = re.compile(r"[^\x00-՗‐-‧一-龥]")
        self.splits = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.pre = Tokenizer.from_file(path).pre_tokenizer
        self.made_by: dict[int, tuple[int, tuple[int, int]]] = {}
        for parts, k in self.rank.items():
            self.made_by.setdefault(self.merged[parts], (k, parts))
        self.edges: tuple[dict, dict] = ({}, {})
        self.follows: dict[int, bool] = {}
        self.words: dict[str, bytes] = {}
        self.child: dict[int, int] = {}
        self.last = [-1]  # of the empty prefix: none
        self.chunks: dict[str, bytes] = {}

    def merge(self, tokens: list[int]) -> list[int]:
        """Plain BPE on a few tokens: apply the earliest merge until none applies."""
        while len(tokens) > 1:
            best = min(range(len(tokens) - 1), key=lambda k: self.rank.get((tokens[k], tokens[k + 1]), 1 << 60))
            pair = (tokens[best], tokens[best + 1])
            if pair not in self.rank:
                break
            tokens[best : best + 2] = [self.merged[pair]]
        return tokens

    def _edges(self, token: int, side: int) -> list[tuple[int, int]]:
        """The tokens at one edge (0 left, 1 right) while a token is built, with the rank of the merge that ends each."""
        known = self.edges[side].get(token)
        if known is None:
            known, part, until = [], token, 1 << 60
            while part is not None:
                known.append((part, until))
                until, parts = self.made_by.get(part, (0, None))
                part = parts[side] if parts else None
            self.edges[side][token] = known
        return known

    def may_follow(self, before: int, token: int) -> bool:
        """Whether BPE encodes the bytes of both as these two tokens; ``before`` -1: as ``token`` alone.

        It does unless some merge joins what stands at the common border at its time. Merges of one rank go from
        left to right, so a merge across the border comes after one of its rank before it, and before one behind it.
        """
        key = (before + 1) << 20 | token
        known = self.follows.get(key)
        if known is None:
            if len(self.follows) > 4 * _CACHE:
                self.follows.clear()
            if before < 0:
                known = self.merge([self.ids[bytes([b])] for b in self.bytes_of[token]]) == [token]
            else:
                rank = self.rank
                known = self.may_follow(-1, token) and not any(
                    rank.get((a, b), 1 << 60) < until and rank[a, b] <= until_b
                    for a, until in self._edges(before, 1)
                    for b, until_b in self._edges(token, 0)
                )
            self.follows[key] = known
        return known

    def learn(self, words: Iterable[str]) -> None:
        """Insert distinct words into the trie, in depth-first order, and remember their ids.

        A node's key is its parent and its byte; it holds the last token of its prefix and where the node before
        that token is. Only nodes that no earlier word has made are worked out.
        """
        ids, longest, follow, bytes_of = self.ids, self.longest, self.may_follow, self.bytes_of
        child, last, known = self.child, self.last, self.follows
        for word, text in sorted([(w.encode(), w) for w in words]):
            path, node = [0], 0
            for end, byte in enumerate(word, 1):
                key = node << 8 | byte
                node = child.get(key, 0)
                if not node:
                    # only one start is right; it is seldom before that of the last token so far
                    likely = end - 1 - len(bytes_of[last[path[-1]]]) if end > 1 else 0
                    for start in (*range(likely, end), *range(likely - 1, max(-1, end - longest - 1), -1)):
                        token = ids.get(word[start:end])
                        if token is not None:
                            before = last[path[start]]
                            fits = known.get((before + 1) << 20 | token)
                            if follow(before, token) if fits is None else fits:
                                break
                    else:
                        raise ValueError("the vocabulary lacks a byte")
                    node = child[key] = len(last)
                    last.append(token)
                path.append(node)
            end, out = len(word), []
            while end:
                token = last[path[end]]
                out.append(token)
                end -= len(bytes_of[token])
            out.reverse()
            self.words[text] = array("I", out).tobytes()

    def _split(self, text: str, exotic: bool) -> list[str]:
        if exotic:
            return [text[a:b] for _, (a, b) in self.pre.pre_tokenize_str(text)]
        return self.pattern.findall(text)

    def _chunked(self, text: str) -> list[str]:
        """Chunks that no word crosses: between two characters that aren't white space, a space begins a word."""
        even = not (text[:1] == " " or text[-1:] == " " or "  " in text or " \n" in text or "\n " in text)
        if even and not self.other_space.search(text):
            return text.replace(" ", "\x00 ").split("\x00")
        return [text]

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Little-endian 32-bit ids of every text, a bounded slice of texts at a time."""
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end]) <= _SLICE_CHARS):
                size += len(texts[end])
                end += 1
            parts = [self.splits.split(t) if self.splits and any(s in t for s in self.special) else [t] for t in texts[at:end]]
            chunked = [[p if k % 2 else self._chunked(p) for k, p in enumerate(row)] for row in parts]
            if len(self.chunks) > _CACHE:
                self.chunks = {}
            if len(self.words) > _CACHE:
                self.words = {}
            if len(self.last) > _NODES:
                self.child, self.last = {}, [-1]
            new = set().union(*(c for row in chunked for c in row[::2])).difference(self.chunks)
            exotic = any(map(self.exotic.search, texts[at:end]))
            split = [(c, [c] if c[1:].isalpha() and c[0] == " " and not exotic else self._split(c, exotic)) for c in new]
            self.learn({w for _, words in split for w in words}.difference(self.words))
            word = self.words.__getitem__
            for chunk, words in split:
                self.chunks[chunk] = word(words[0]) if len(words) == 1 else b"".join(map(word, words))
            find = self.chunks.__getitem__
            for row in chunked:
                if len(row) == 1:
                    yield b"".join(map(find, row[0]))
                else:
                    yield b"".join(np.array([self.special[p]], "<u4").tobytes() if k % 2 else b"".join(map(find, p)) for k, p in enumerate(row))
            for chunk in [c for c in new if len(c) > 100]:  # whole texts that had no simple chunks
                del self.chunks[chunk]
            at = end

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist())).decode("utf-8", "replace")


_LOADED: dict[str, TrieBpe] = {}


def _bpe(path: str) -> TrieBpe:
    if path not in _LOADED:
        _LOADED[path] = TrieBpe(path)
    return _LOADED[path]


def encode(docs: DataFrame, tokenizer: str) -> DataFrame:
    """``doc_id, ids array<int>`` of every text; ``tokenizer`` is a path that every executor has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(tokenizer)
        for batch in batches:
            raw = list(bpe.encode(batch.column(1).to_pylist()))
            offsets = np.cumsum([0, *(len(r) // 4 for r in raw)])
            ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(b"".join(raw), "<i4")))
            yield pa.record_batch([batch.column(0), ids], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), body().alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """``doc_id, text`` of every row of ``doc_id, ids``; null ids give the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(tokenizer)
        for batch in batches:
            texts = [bpe.decode(np.array(ids or [], np.int64)) for ids in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Encode and decode every text in one pass: ``doc_id, n_tokens, ids_sha256, decoded_sha256``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(tokenizer)
        for batch in batches:
            counts, ids, texts = [], [], []
            for raw in bpe.encode(batch.column(1).to_pylist()):
                counts.append(len(raw) // 4)
                ids.append(sha256(raw).hexdigest())
                texts.append(sha256(bpe.decode(np.frombuffer(raw, "<u4")).encode()).hexdigest())
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())]
            yield pa.record_batch(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), body().alias("text")).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
