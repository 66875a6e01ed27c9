import random
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
from plumbline.llm import jaccard_join as jj
from plumbline.llm.common import connected_components
from pyspark.sql import functions as F


def _corpus(seed=1, groups=25):
    rng, rows = random.Random(seed), []
    for g in range(groups):
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.randrange(6, 150))]
        for _ in range(rng.randrange(1, 9)):
            words = list(base)
            for _ in range(rng.randrange(0, 4)):
                words[rng.randrange(len(words))] = f"e{rng.randrange(9999)}"
            rows.append((len(rows), " ".join(words)))
    return rows


def _brute(rows, threshold=0.8):
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := (t or "").split()) else set() for i, t in rows}
    links, root = dict.fromkeys(sets, 0), {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        if sets[a] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-9:
            links[a] += 1
            links[b] += 1
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (find(i), links[i]) for i in sets}


def test_links_and_groups_like_brute_force(spark):
    rows = _corpus()
    got = {r.doc_id: (r.class_id, r.n_links) for r in jj.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == _brute(rows)


def test_large_group_is_compared_in_blocks(spark):
    base = [f"w{k}" for k in range(60)]
    rows = [(i, " ".join([*base[: 7 * i % 58], f"x{i}", *base[7 * i % 58 :]])) for i in range(2 * jj.BLOCK + 20)]
    got = {r.doc_id: (r.class_id, r.n_links) for r in jj.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == _brute(rows)


def test_long_chain_compares_few_blocks(spark):
    """A component that is long, not dense: every document is like its neighbours only."""
    rng = random.Random(3)
    words = [f"w{rng.randrange(10**6)}" for _ in range(7 * 420 + 80)]
    rows = [(i, " ".join(words[7 * i : 7 * i + 80])) for i in range(420)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.class_id, r.n_links) for r in jj.jaccard_groups(docs).collect()}
    assert got == _brute(rows)
    drawn = jj.sketches(docs).withColumnRenamed("doc_id", "rep")
    chain = spark.createDataFrame([(i, 0) for i in range(420)], "rep long, component long")
    # the least bands that tell: neighbours share the i-th band of their own
    bands = F.array(F.col("rep"), F.col("rep") + 1)
    placed, partners = jj.blocks_of(chain, drawn.withColumn("near", F.floor(F.col("rep") / 42)).withColumn("bands", bands))
    blocks = placed.select("block").distinct().count()
    pairs = partners.select("i", "j").distinct().count()
    assert placed.count() == 420 and blocks >= 4
    assert pairs < blocks + 20 and partners.where("i = j").count() == blocks


def test_edges(spark, odd_docs, no_docs):
    rows = {r.doc_id: r for r in jj.jaccard_groups(odd_docs).collect()}
    assert rows[1].n_links == rows[2].n_links == 0 and rows[1].class_id == 1
    assert rows[4].n_links == 1 and rows[6].class_id == rows[5].class_id == 5
    assert jj.jaccard_groups(no_docs).count() == 0
    nameless = spark.createDataFrame([(None, "p q r s t"), (None, "p q r s t"), (None, "u v w x y"), (3, "u v w x  y")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.class_id or 0, r.n_links) for r in jj.jaccard_groups(nameless).collect()) == [(0, 0, 1), (0, 0, 1), (0, 3, 1), (3, 3, 1)]
    kept = jj.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    # 6 is a copy of 5; both rows of 4 stay, and so does the row without an id
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 4, 5, 7, 8, 9, 10]


def test_recall_on_the_documents(spark):
    """Every pair at 0.8 or more among the documents of sf0.01 is linked, against exact counts of common shingles."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := (t or "").split()) else set() for i, t in rows}
    at, links = defaultdict(list), Counter()
    for i, found in sets.items():
        for x in found:
            at[x].append(i)
    common = Counter(p for ids in at.values() if len(ids) > 1 for p in combinations(sorted(ids), 2))
    for (a, b), n in common.items():
        if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n) - 1e-9:
            links.update((a, b))
    got = {r.doc_id: r.n_links for r in jj.jaccard_groups(docs).collect()}
    assert sum(links.values()) > 100
    assert {i: n for i, n in got.items() if n} == dict(links)


def test_least_matches_is_the_posterior():
    # P(J >= t | m of n match) by integrating the likelihood under a uniform prior
    x = np.linspace(0, 1, 200_001)
    for n, m in zip(range(16, 129, 16), jj.least_matches(0.8, 1e-6), strict=True):
        tail = lambda k: (lambda y: y[x >= 0.8].sum() / y.sum())(x**k * (1 - x) ** (n - k))  # noqa: B023, E731
        assert tail(m) >= 0.99e-6 and (m == 0 or tail(m - 1) < 1.01e-6)


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 101), (101, 102), (102, 100), (200, 200)] + [(300, x) for x in range(301, 400)]
    df = spark.createDataFrame([*edges, (None, 5), *edges[:10]], "a long, b long")
    got = {r.node: r.component for r in connected_components(df).collect()}
    assert got == {**dict.fromkeys(range(1, 61), 1), **dict.fromkeys((100, 101, 102), 100), **dict.fromkeys(range(300, 400), 300)}
    assert connected_components(df.limit(0)).count() == 0


def _joined_rows(spark, since):
    """The most rows that a join made in the executions from the given one on."""
    store, most = spark._jsparkSession.sharedState().statusStore(), 0
    for at in range(since, store.executionsCount()):
        execution = store.executionsList().apply(at)
        values, nodes = store.executionMetrics(execution.executionId()), store.planGraph(execution.executionId()).allNodes()
        for node in (nodes.apply(k) for k in range(nodes.size())):
            metrics = node.metrics()
            for metric in (metrics.apply(k) for k in range(metrics.size())) if "Join" in node.name() else ():
                if metric.name() == "number of output rows" and values.contains(metric.accumulatorId()):
                    most = max(most, int(values.apply(metric.accumulatorId()).replace(",", "")))
    return most


def test_dense_group_lists_its_blocks_once(spark):
    """All documents share many bands: a join of blocks on bands would list every pair of blocks as often."""
    n, shared = 12 * jj.BLOCK, [*range(64)]
    dense = spark.createDataFrame([(i, 0) for i in range(n)], "rep long, component long")
    classes = spark.createDataFrame([(i, i % 40, [*shared, 1000 + i // 2]) for i in range(n)], "rep long, near long, bands array<long>")
    since = spark._jsparkSession.sharedState().statusStore().executionsCount()
    placed, partners = jj.blocks_of(dense, classes)
    blocks = placed.select("block").distinct().count()
    pairs = {(r.i, r.j) for r in partners.select("i", "j").collect()}
    assert placed.count() == n and len(pairs) == blocks * (blocks + 1) // 2
    assert n <= _joined_rows(spark, since) <= 2 * n
