import random
from collections import Counter

import numpy as np
from plumbline.llm import quality

CLEAN = "the of and to in a is that for it river house green walks under tree slowly while morning light falls over old town people bread window".split()


def _text(rng, junk):
    words = [rng.choice(CLEAN) for _ in range(rng.randrange(20, 120))]
    if junk == 1:
        return " ".join(w + rng.choice(["***", "$$$", "###"]) for w in words)
    if junk == 2:
        return " ".join(w.upper() + "!!" for w in words)
    if junk == 3:
        return " ".join([words[0]] * len(words))
    return " ".join(w + ("." if k % 9 == 8 else "") for k, w in enumerate(words)) + "."


def test_held_out_accuracy(spark):
    rng = random.Random(2)
    kinds = [rng.choice([0, 0, 0, 0, 1, 2, 3]) for _ in range(900)]
    rows = [(i, _text(rng, k)) for i, k in enumerate(kinds)]
    got = {r.doc_id: r.keep for r in quality.score_quality(spark.createDataFrame(rows, "doc_id long, text string"), sample_rows=300).collect()}
    right = Counter((k == 0, got[i]) for i, k in enumerate(kinds))
    assert right[True, False] <= 0.01 * right[True, True] and right[False, True] <= 0.1 * right[False, False]


def test_em_recovers_accuracies():
    rng = np.random.default_rng(0)
    truth = rng.random(20_000) < 0.85
    hit = [0.7, 0.5, 0.6, 0.4, 0.5]
    votes = np.stack([np.where(truth, np.where(rng.random(20_000) < 0.01, -1, 0), np.where(rng.random(20_000) < h, -1, 0)) for h in hit], axis=1)
    clean, rates = quality.fit_labellers(Counter(map(tuple, votes.tolist())))
    assert abs(clean - 0.85) < 0.05
    assert (np.argsort(-rates[:, 0, 0]) == np.argsort(-np.array(hit), kind="stable"))[0]
    belief = quality.posterior(votes, clean, rates)
    assert ((belief > 0.5) == truth)[~truth].mean() > 0.9 and ((belief > 0.5) == truth)[truth].mean() > 0.95


def test_edges(spark, odd_docs, no_docs):
    out = quality.score_quality(odd_docs)
    assert out.columns == [*odd_docs.columns, "quality", "keep"]
    rows = out.collect()
    assert all(r.keep for r in rows if not (r.text or "").strip())
    assert len({r.quality for r in rows if r.doc_id == 4}) == 1
    assert quality.score_quality(no_docs).count() == 0


def test_against_the_labels(spark):
    """Held-out labels of sf0.01, which training never sees."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").withColumnRenamed("quality", "label")
    rows = quality.score_quality(docs).join(labels, "doc_id").collect()
    clean, junk = [r for r in rows if r.label == 1], [r for r in rows if r.label == 0]
    assert len(clean) > 300 and len(junk) > 20
    above = np.mean([c.quality > j.quality for c in clean for j in junk])
    assert above > 0.99
    assert np.mean([r.keep for r in clean]) > 0.99 and np.mean([r.keep for r in junk]) < 0.15


def test_sample_survives_missing_constant_and_repeated_ids(spark):
    rng = random.Random(3)
    kinds = [rng.choice([0, 0, 0, 1, 2]) for _ in range(600)]
    texts = [_text(rng, k) for k in kinds]
    for ids in ([None] * 600, [7] * 600):
        rows = [*zip(ids, texts, strict=True), *[(ids[0], texts[0])] * 600]
        got = {r.text: r.keep for r in quality.score_quality(spark.createDataFrame(rows, "doc_id long, text string"), sample_rows=300).collect()}
        assert np.mean([got[t] == (k == 0) for t, k in zip(texts, kinds, strict=True)]) > 0.95
    one = spark.createDataFrame([(1, CLEAN[0])] * 500, "doc_id long, text string")
    assert len({r.quality for r in quality.score_quality(one, sample_rows=2).collect()}) == 1


def test_long_words_are_read_whole(spark):
    assert quality.pieces(["ab", "x" * 45]) == ["ab", "x" * 20, "x" * 20, "x" * 5] and quality.pieces([]) == []
    weights = np.random.default_rng(1).normal(size=quality.BUCKETS)
    score = lambda text: sum(weights[f] for w in quality.pieces([text]) for f in quality.word_features(w))
    assert score("a" * 200 + "###" * 50) != score("a" * 200 + "bcd" * 50)


def test_a_worker_gets_every_text_once(spark):
    """The texts go to Python in their own column only, and come back in small batches."""
    docs = spark.createDataFrame([(i, None if i % 7 == 0 else f"word {i} the of and to. " * 3) for i in range(2 * quality._ROWS + 5)], "doc_id long, text string").coalesce(1)
    scored = quality.score_quality(docs)
    assert "__body" not in scored._jdf.queryExecution().optimizedPlan().toString()
    assert scored.count() == docs.count() and scored.where("text IS NULL AND NOT keep").count() == 0
