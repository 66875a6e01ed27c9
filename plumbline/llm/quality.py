"""Quality classifier from weak labels: expectation-maximisation over heuristic labellers, then a hashed linear scorer.

Heuristics look at a whole text and vote clean (1), junk (-1) or nothing (0); they overlap and
some only ever vote junk. Given the true class, votes are taken as independent, so the corpus is summed up by how
often each combination of votes occurs: a small table, whatever the input. Expectation-maximisation on it
estimates the share of clean documents and each labeller's accuracy on either class. The posterior of every combination labels a bounded sample of documents, on
which a logistic scorer with hashed features (shape, ending and spelling of words, document-level bins) is
trained; it then scores all documents.

A text without words (null, empty, blank) gets no votes and no word features: it is scored by the intercept alone
and kept, as nothing speaks against it. Equal texts have equal scores, whatever their ids, which may be missing or
repeated; repeated rows are each scored. Long words, as in texts without spaces, are read whole, in pieces. An empty
table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from plumbline.llm.common import body

#: Documents that the scorer is trained on, at most twice this: chosen by a hash of id and text.
SAMPLE_ROWS = 4000
BUCKETS = 1 << 14
#: A document with a lower score is rejected.
THRESHOLD = 0.5
#: Expected P(vote | class) for votes junk, none, clean: of junk documents, then of clean ones.
BELIEFS = np.array([[0.4, 0.4, 0.2], [0.005, 0.5, 0.495]])
#: Weight of these expectations, as a share of the documents: it pulls the rates of a class with few documents most, for
#: the sake of clean ones. On the labels of sf0.1, a share of 0.1 keeps 13 % of junk and drops 0.2 % of clean documents, 0.2
#: keeps 13 % and drops 0.03 %, 0.5 keeps 14 % and drops none.
PRIOR_SHARE = 0.5
#: Value of a feature of the whole text, where the words' features sum to 3.
TEXT_VALUE = 2.0
#: Characters of a word that are hashed together.
PIECE = 20
_CACHE_WORDS = 120_000
#: Rows that are scored and handed on at a time, so that a Python worker holds few texts beside its batch.
_ROWS = 1000
_MARKS = "#$%&*|<>{}[]\\^~_=+@"
_RUN = re.compile(r"(.)\1+")
#: Frequent function words of the languages that the corpus holds.
FUNCTION_WORDS = frozenset(
    "the of and to in a is that for it as with was on be by at this are or "
    "de la le et les des en un une du que pour dans par sur "
    "der die und das von zu den mit ist im für "
    "el los y las del se por con su para".split()
)
LABELLERS = ("marks", "capitals", "repetition", "function words", "word length", "sentences", "shouting")


def votes(text: str, words: list[str]) -> tuple[int, ...]:
    """The votes of :data:`LABELLERS` on one text."""
    n = len(words)
    if not n:
        return (0,) * len(LABELLERS)
    marks = sum(map(text.count, _MARKS)) / n
    capitals = sum(map(str.isupper, words)) / n
    fresh = math.log(len(set(words))) / math.log(n) if n > 1 else 1.0
    common = sum(map(FUNCTION_WORDS.__contains__, words)) / n
    sentences = (text.count(". ") + text.count(".\n") + text.endswith(".")) / n
    shouting = (text.count("!") + text.count("?")) / n
    enough = n >= 8
    return (
        -(marks > 0.2),
        -(capitals > 0.3 and enough),
        -(fresh < 0.7 and enough),
        enough * ((common > 0.08) - (common < 0.02)),
        -(len(text) / n > 16),
        enough * ((0.01 < sentences < 0.5) - (not sentences)),
        -(shouting > 0.3 and enough),
    )


def fit_labellers(patterns: dict[tuple[int, ...], int], rounds: int = 100) -> tuple[float, np.ndarray]:
    """Expectation-maximisation: the share of clean documents and P(vote | class) as [labeller, class, vote + 1].

    The rates start at :data:`BELIEFS` (heuristics seldom call clean text junk), which also enter as prior votes,
    a fixed share of the corpus; without them the two classes could be any split that votes agree on.
    """
    seen = np.array(list(patterns), int).reshape(len(patterns), -1)
    weight = np.array([patterns[p] for p in patterns], float)
    rates = np.tile(BELIEFS, (seen.shape[1], 1, 1))
    clean = 0.8
    for _ in range(rounds):
        belief = posterior(seen, clean, rates)
        mass = np.stack([(1 - belief) * weight, belief * weight])
        clean = min(0.98, max(0.02, float(mass[1].sum() / weight.sum())))
        for vote in range(3):
            rates[:, :, vote] = (mass @ (seen == vote - 1)).T + PRIOR_SHARE * weight.sum() * BELIEFS[:, vote]
        rates /= rates.sum(axis=2, keepdims=True)
    return clean, rates


def posterior(patterns: np.ndarray, clean: float, rates: np.ndarray) -> np.ndarray:
    """P(clean | votes) of every row of votes."""
    each = np.log(rates)[np.arange(patterns.shape[1]), :, patterns + 1].sum(axis=1)
    margin = np.log(clean / (1 - clean)) + each[:, 1] - each[:, 0]
    return 1 / (1 + np.exp(-np.clip(margin, -500, 500)))


def pieces(words: list[str]) -> list[str]:
    """The words, long ones in pieces of ``PIECE`` characters, so that texts without spaces are read whole like others."""
    if len(max(words, key=len, default="")) <= PIECE:
        return words
    return [w[k : k + PIECE] for w in words for k in range(0, len(w), PIECE)]


def _shape(word: str) -> str:
    kinds = "".join("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in word)
    return _RUN.sub(r"\1", kinds)


def word_features(word: str) -> tuple[int, ...]:
    names = (f"s:{_shape(word)}", f"e:{word[-2:]}", f"w:{word.lower()}")
    return tuple(crc32(n.encode("utf-8", "surrogatepass")) % BUCKETS for n in names)


def text_features(words: list[str]) -> tuple[int, ...]:
    n = len(words)
    fresh = math.log(len(set(words))) / math.log(n) if n > 1 else 1.0
    names = (f"fresh:{int(10 * fresh)}", f"size:{n.bit_length()}")
    return tuple(crc32(name.encode()) % BUCKETS for name in names)


def _votes_of(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cast = [votes(t, t.split()) for t in batch.column(0).to_pylist()]
            yield pa.record_batch([pa.array(cast, pa.list_(pa.int32()))], ["votes"])

    return docs.select(body().alias("text")).mapInArrow(run, "votes array<int>")


def _sampled(docs: DataFrame, share: float, most: int) -> DataFrame:
    """Votes and hashed features of the documents whose id and text hash into ``share`` of the hash range; equal rows count once."""
    drawn = docs.select("doc_id", body().alias("text")).withColumn("draw", F.pmod(F.xxhash64("doc_id", "text", F.lit("sample")), F.lit(1 << 30)))
    chosen = drawn.where(F.col("draw") < int(share * (1 << 30))).distinct().orderBy("draw", "doc_id", "text").limit(most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cast, where, much = [], [], []
            for text in batch.column(0).to_pylist():
                words = text.split()
                cast.append(votes(text, words))
                words = pieces(words)
                at, count = np.unique([f for w in words for f in word_features(w)] or [0], return_counts=True)
                bins = text_features(words) if words else ()
                where.append([*at.tolist(), *bins])
                much.append([*(count / max(1, len(words))).tolist(), *(TEXT_VALUE for _ in bins)] if words else [0.0])
            kinds = (pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.float32()))
            yield pa.record_batch([pa.array(c, t) for c, t in zip((cast, where, much), kinds, strict=True)], ["votes", "at", "much"])

    return chosen.select("text").mapInArrow(run, "votes array<int>, at array<int>, much array<float>")


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, rounds: int = 400, rate: float = 0.5, decay: float = 1e-5) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by AdaGrad over the whole sample: weights by bucket and the intercept."""
    size = np.array([len(at) for at, _ in rows])
    at, much, row = np.concatenate([a for a, _ in rows]), np.concatenate([m for _, m in rows]), np.repeat(np.arange(len(rows)), size)
    weights, grown, bias, bias_grown = np.zeros(BUCKETS), np.full(BUCKETS, 1e-8), 0.0, 1e-8
    # either class counts the same in sum
    ratio = labels.mean() if len(labels) else 0.5
    balance = labels / max(ratio, 1e-3) + (1 - labels) / max(1 - ratio, 1e-3)
    balance /= balance.sum()
    for _ in range(rounds):
        margin = np.bincount(row, much * weights[at], minlength=len(rows)) + bias
        error = (1 / (1 + np.exp(-np.clip(margin, -50, 50))) - labels) * balance
        gradient = np.bincount(at, much * error[row], minlength=BUCKETS) + decay * weights
        grown += gradient**2
        weights -= rate * gradient / np.sqrt(grown)
        bias_grown += error.sum() ** 2
        bias -= rate * error.sum() / np.sqrt(bias_grown)
    return weights, float(bias)


class _Weights(dict):
    """The summed weight of a word's features, remembered for a bounded number of words."""

    def __init__(self, weights: np.ndarray):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: str) -> float:
        if len(self) >= _CACHE_WORDS:
            self.clear()
        value = self[word] = float(sum(self.weights[f] for f in word_features(word)))
        return value


def score_quality(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """Add ``quality`` (0 to 1) and ``keep`` to ``docs``, which needs ``doc_id`` and ``text``.

    Columns of these names that ``docs`` has already are replaced.
    """
    counted = _votes_of(docs).groupBy("votes").count().collect()  # at most 3 ** len(LABELLERS) rows
    patterns = {tuple(r["votes"]): r["count"] for r in counted}
    total = sum(patterns.values())
    clean, rates = fit_labellers(patterns) if total else (0.5, np.tile(BELIEFS, (len(LABELLERS), 1, 1)))
    share, sample = min(1.0, sample_rows / max(1, total)), []
    while total and not sample:  # where few rows differ, a small share may hold none of them
        sample = _sampled(docs, share, 2 * sample_rows).collect()
        share = min(1.0, 64 * share)
    rows = [(np.array(r["at"], int), np.array(r["much"], float)) for r in sample]
    labels = posterior(np.array([r["votes"] for r in sample], int).reshape(len(sample), len(LABELLERS)), clean, rates)
    weights, bias = train(rows, labels) if rows else (np.zeros(BUCKETS), 0.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Weights(weights)
        find = known.__getitem__
        for whole in batches:
            for first in range(0, whole.num_rows, _ROWS):
                batch = whole.slice(first, _ROWS)
                scores, kept = [], []
                for text in batch.column(at).to_pylist():
                    words = pieces((text or "").split())
                    margin = bias
                    if words:
                        margin += sum(map(find, words)) / len(words) + TEXT_VALUE * sum(weights[f] for f in text_features(words))
                    scores.append(1 / (1 + np.exp(-np.clip(margin, -50, 50))))
                    kept.append(bool(scores[-1] >= threshold or not words))
                yield pa.record_batch([*batch.columns, pa.array(scores, pa.float64()), pa.array(kept, pa.bool_())], [*batch.schema.names, "quality", "keep"])

    docs = docs.drop("quality", "keep")
    at = [n.lower() for n in docs.columns].index("text")
    fields = StructType([*docs.schema.fields]).add("quality", "double").add("keep", "boolean")
    return docs.mapInArrow(run, fields)
