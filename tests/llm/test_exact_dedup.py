import re
from collections import defaultdict

import numpy as np
from plumbline.llm import exact_dedup


def _expected(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((-len(text or ""), doc_id))
    return {norm: (min(g, key=lambda x: (x[0], x[1] is not None, x[1] or 0))[1], len(g)) for norm, g in groups.items()}


def test_groups_like_brute_force(spark, odd_docs, docs):
    rows = exact_dedup.dedup_arrivals(odd_docs).collect()
    expected = _expected([tuple(r) for r in docs.collect()])
    assert len(rows) == docs.count()
    by_doc = defaultdict(set)
    for r in rows:
        by_doc[r.doc_id].add((r.keep_id, r.group_size))
    for doc_id, text in docs.collect():
        assert expected[re.sub(r"[\x20\x09-\x0D]", "", text or "")] in by_doc[doc_id]


def test_known_and_new_batches_share_groups(spark):
    known = spark.createDataFrame([(i, f"text {i % 50}") for i in range(100)], "doc_id long, text string")
    new = spark.createDataFrame([(1000 + i, f"text  {i % 80}") for i in range(80)], "doc_id long, text string")
    rows = exact_dedup.exact_dedup(new, known).collect()
    sizes = {r.doc_id: r.group_size for r in rows}
    assert sizes[1000] == 3 and sizes[1079] == 1 and sizes[0] == 3
    assert {r.keep_id for r in rows if r.doc_id in (0, 50, 1000)} == {1000}  # two spaces: the longest original text


def test_a_large_batch_against_a_small_snapshot_comes_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "SHARD_KEYS", 100)
    docs = spark.createDataFrame([(0, "text 7")] + [(10**12 + i, f"text {i}") for i in range(3000)], "doc_id long, text string")
    known = exact_dedup.snapshot(docs.where("doc_id = 0"))
    new = exact_dedup.grouped(exact_dedup.with_digest(docs.where("doc_id > 0")))
    dealt, n = exact_dedup.pieces(new, known)
    assert known.shards == 1 and n == 30
    assert max(r["count"] for r in dealt.groupBy("shard", "piece").count().collect()) < 200
    rows = exact_dedup.screen(new, known).collect()
    assert len(rows) == len({bytes(r.digest) for r in rows}) == 3000 and 1 <= sum(r.maybe for r in rows) < 60
    sizes = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.dedup_arrivals(docs).collect()}
    assert len(sizes) == 3001 and sizes[0] == sizes[10**12 + 7] == (0, 2) and {s for _, s in sizes.values()} == {1, 2}


def test_keep_first_keeps_one_of_each(spark, odd_docs, no_docs):
    kept = exact_dedup.keep_first(odd_docs)
    assert kept.columns == odd_docs.columns
    texts = [re.sub(r"\s", "", r.text or "") for r in kept.collect()]
    assert len(texts) == len(set(texts)) == 8
    assert exact_dedup.dedup_arrivals(no_docs).count() == 0


def test_keep_first_like_brute_force_on_clashing_ids(spark):
    rows = [(1, "a"), (1, "a "), (1, " a"), (2, "a"), (3, None), (3, ""), (None, "b"), (None, "b"), (4, "b"), (5, "c d"), (5, "cd"), (6, "cd  "), (7, "x"), (7, "y")]
    kept = exact_dedup.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    left = defaultdict(list)
    for r in kept:
        left[re.sub(r"\s", "", r.text or "")].append((r.doc_id, len(r.text or "")))
    assert left == {"a": [(1, 2)], "": [(3, 0)], "b": [(None, 1)], "cd": [(6, 4)], "x": [(7, 1)], "y": [(7, 1)]}


def test_a_saved_snapshot_screens_like_a_fresh_one(spark, tmp_path):
    known = spark.createDataFrame([(i, f"text {i}") for i in range(300)], "doc_id long, text string")
    new = spark.createDataFrame([(1000 + i, f"text {i}") for i in range(200, 400)], "doc_id long, text string")
    exact_dedup.snapshot(known).save(f"{tmp_path}/one")
    loaded = exact_dedup.Snapshot.load(spark, f"{tmp_path}/one")
    assert sorted(exact_dedup.exact_dedup(new, known, loaded).collect()) == sorted(exact_dedup.exact_dedup(new, known).collect())


def test_filter_has_no_false_negatives():
    for n in (0, 1, 2, 3, 10, 1000, 50_000):
        keys = np.unique(np.random.default_rng(n).integers(0, 1 << 63, n, dtype=np.uint64))
        blob = exact_dedup.build_filter(keys)
        assert exact_dedup.in_filter(blob, keys).all()
        other = np.random.default_rng(n + 1).integers(0, 1 << 63, 20_000, dtype=np.uint64)
        if n > 100:
            assert exact_dedup.in_filter(blob, other).mean() < 0.01
            assert len(blob) < 1.6 * len(keys) + 100
