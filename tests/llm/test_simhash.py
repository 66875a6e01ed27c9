import random
from collections import Counter
from hashlib import sha256

from plumbline.llm import queries, simhash
from pyspark.sql import functions as F


def _bits(a, b):
    return bin(int(a, 16) ^ int(b, 16)).count("1")


def test_fingerprints_of_equal_and_near_texts(spark, odd_docs):
    prints = {r.doc_id: r.fingerprint for r in simhash.fingerprints(odd_docs.where("doc_id IS NOT NULL").distinct(), ["doc_id"]).collect()}
    assert prints[1] == prints[2] == prints[3] == "0" * 32
    assert prints[5] == prints[6] and len(set(prints.values())) == 7


def test_search_finds_all_within_the_radius(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(128) for _ in range(40)]
    near = [b ^ sum(1 << k for k in rng.sample(range(128), rng.randrange(0, 10))) for b in base for _ in range(6)]
    prints = [f"{x:032x}" for x in base + near + base[:3]]
    df = spark.createDataFrame([(p,) for p in prints], "fingerprint string")
    asked = prints[:40]
    got = {r.fingerprint: r.n_near for r in simhash.near_counts(df.where(F.col("fingerprint").isin(asked)), df).collect()}
    assert got == {p: sum(_bits(p, q) <= simhash.RADIUS for q in prints) for p in asked}


def test_next_document_across_ranges(spark):
    rng = random.Random(8)
    for ids in ([3, 5, 6, 1023, 1024, 5000, 5001, 9999], [rng.randrange(-(1 << 63), 1 << 63) for _ in range(300)], [*range(100), *(1 << k for k in range(7, 63))]):
        df = spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, text string")
        rows = simhash.with_next(df, rows_per_range=3).collect()
        at = {(r.range, r.pos): r.doc_id for r in rows}
        got = {r.doc_id: (at[r.next_range, r.next_pos], r.next_text) for r in rows}
        order = sorted(ids, reverse=True)
        assert got == {i: (n, f"t{n}") for i, n in zip(order, [*order[1:], order[0]], strict=True)}
        assert len(at) == len(ids) and max(Counter(r.range for r in rows).values()) < 12


def test_next_document_of_rows_without_and_with_one_id(spark):
    rows = [(None, f"n{k}") for k in range(30)] + [(4, f"same{k}") for k in range(10)] + [(4, "same0"), (9, "top"), (1, "low")]
    got = simhash.with_next(spark.createDataFrame(rows, "doc_id long, text string"), rows_per_range=5).collect()
    next_of = {(r.range, r.pos): (r.next_range, r.next_pos) for r in got}
    text = {(r.range, r.pos): (r.doc_id, r.text) for r in got}
    at, seen = next(k for k, v in text.items() if v == (9, "top")), []
    for _ in rows:
        seen.append(text[at])
        at = next_of[at]
    assert text[at] == (9, "top") and sorted(seen, key=repr) == sorted(rows, key=repr)
    assert seen[:13] == [(9, "top"), (4, "same0"), (4, "same0"), *((4, f"same{k}") for k in range(1, 10)), (1, "low")]


def test_query_like_brute_force(spark, tmp_path):
    rows = [(i, None if i % 11 == 0 else " ".join(f"w{(i * j) % 97}" for j in range(i % 40))) for i in range(60)] + [(7000, "é" * 9)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op2_fingerprints(spark, str(tmp_path)).collect()}
    order = sorted(rows, reverse=True)
    for (i, text), (n, other) in zip(order, [*order[1:], order[0]], strict=True):
        text, other = text or "", other or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + other[:half]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), sha256(edited.encode()).hexdigest())
        assert r.near_edited == 1 - _bits(r.fingerprint, r.edited_fingerprint) / 128
        assert r.near_next == 1 - _bits(r.fingerprint, got[n].fingerprint) / 128
        assert r.n_near == (sum(_bits(r.fingerprint, x.fingerprint) <= simhash.RADIUS for x in got.values()) if i % 100 == 0 else None)


def test_edges(spark, odd_docs, no_docs, tmp_path):
    odd_docs.unionByName(odd_docs).write.parquet(f"{tmp_path}/documents.parquet")
    rows = queries.op2_fingerprints(spark, str(tmp_path)).collect()
    assert len(rows) == 2 * odd_docs.count() and all(r.near_next is not None and r.near_edited is not None for r in rows)
    assert simhash.with_next(odd_docs).count() == odd_docs.count()
    assert simhash.with_next(no_docs).count() == 0
