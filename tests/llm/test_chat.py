from hypothesis import given, settings
from hypothesis import strategies as st
from plumbline.llm import chat
from pyspark.sql import functions as F

_PARTS = st.lists(st.sampled_from([*chat.CONTROL, "\\", "<", "|", "im_end|>\n", "<|im_end|>\n", "s>", "[", "INST]", "a", "\n", "é", "🙂"]), max_size=8).map("".join)


@settings(max_examples=4, deadline=None)
@given(st.lists(_PARTS, min_size=40, max_size=80))
def test_escape_is_reversible(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("e", chat.escape(F.col("t")))
    for r in df.withColumn("u", chat.unescape(F.col("e"))).collect():
        assert r.u == r.t and not any(c in r.e for c in chat.CONTROL)


@settings(max_examples=3, deadline=None)
@given(st.lists(st.tuples(_PARTS, _PARTS), min_size=1, max_size=30))
def test_round_trip(spark, turns):
    rows = [(7, k, role, text) for k, (role, text) in enumerate(turns)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.format_trees(chat.chain(df), branches=1)
    r = out.withColumn("turns", chat.read_back(F.col("formatted"))).first()
    assert [(t.role, t.text) for t in r.turns] == turns


def test_tree_paths_and_ranking(spark):
    messages = [
        (1, 1, None, "user", "q", 1.0), (1, 2, 1, "assistant", "a", 0.2), (1, 3, 1, "assistant", "b", 0.9), (1, 4, 3, "user", "more", 0.9),
        (1, 5, 4, "assistant", "c", 1.0), (2, 1, 99, "user", None, 0.0), (3, 1, 2, "user", "loop", 1.0), (3, 2, 1, "user", "loop", 1.0),
    ]
    df = spark.createDataFrame(messages, "conv_id long, message_id long, parent_id long, role string, text string, score double")
    got = {(r.conv_id, r.leaf_id): r for r in chat.format_trees(df).collect()}
    assert set(got) == {(1, 2), (1, 5), (2, 1)}
    best = chat.format_trees(df, branches=1).where("conv_id = 1").first()
    assert best.leaf_id == 5 and best["rank"] == 1
    assert "".join(best.formatted[s.start : s.start + s.length] for s in best.loss_spans) == "bc"
    assert chat.format_trees(df.limit(0)).count() == 0


def test_flat_table_with_nulls_and_ties(spark):
    rows = [(1, 0, "user", None), (1, 0, "user", None), (1, 1, None, "x"), (1, 1, "assistant", "y"), (1, None, "user", "first")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("leaf_id", F.lit(1)).withColumn("up", F.lit(2))
    r = chat.format_trees(chat.chain(df), branches=1).withColumn("turns", chat.read_back(F.col("formatted"))).collect()
    assert len(r) == 1 and [(t.role, t.text) for t in r[0].turns] == [("user", "first"), ("user", ""), ("user", ""), ("", "x"), ("assistant", "y")]


def test_messages_without_ids(spark):
    flat = spark.createDataFrame([(None, 0, "user", "q"), (None, 1, "assistant", "a"), (1, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    got = chat.format_trees(chat.chain(flat), branches=1).withColumn("turns", chat.read_back(F.col("formatted"))).collect()
    assert {r.conv_id: [t.text for t in r.turns] for r in got} == {None: ["q", "a"], 1: ["x"]}
    messages = [
        (None, 1, None, "user", "q", 1.0), (None, 2, 1, "assistant", "a", 1.0), (None, None, 1, "assistant", "b", 0.5),
        (None, None, 2, "user", "c", 0.5), (5, None, None, "user", "alone", 1.0), (5, 1, None, "user", "one", 0.0),
    ]
    tree = spark.createDataFrame(messages, "conv_id long, message_id long, parent_id long, role string, text string, score double")
    got = chat.format_trees(tree).withColumn("turns", chat.read_back(F.col("formatted"))).collect()
    said = sorted((r.conv_id or 0, r.leaf_id or 0, "".join(t.text for t in r.turns)) for r in got)
    assert said == [(0, 0, "qac"), (0, 0, "qb"), (5, 0, "alone"), (5, 1, "one")]


def _brute(messages):
    """Every path as (conv_id, leaf_id, texts), climbing one message at a time."""
    key = lambda m: tuple((x is not None, x) for x in (m[2], m[5]))
    first = {}
    for i, m in sorted(enumerate(messages), key=lambda x: key(x[1])):
        if m[1] is not None:
            first.setdefault((m[0], m[1]), i)
    parent = [first.get((m[0], m[2])) if m[2] is not None else None for m in messages]
    out = []
    for leaf in set(range(len(messages))) - set(parent):
        path, at = [], leaf
        while at is not None and len(path) <= len(messages):
            path.append(at)
            at = parent[at]
        if at is None:
            out.append((messages[leaf][0], messages[leaf][1], "|".join(messages[i][4] or "" for i in reversed(path))))
    return sorted(out, key=repr)


def test_trees_with_repeated_ids_and_cycles_like_brute_force(spark):
    import random

    rng = random.Random(5)
    for _ in range(2):
        messages = [(rng.choice([1, 2, None]), rng.choice([None, *range(14)]), rng.choice([None, *range(14)]), "user", f"t{rng.randrange(9)}", rng.random()) for _ in range(60)]
        messages += [(9, 1, None, "user", "q", 1.0), (9, 2, 1, "assistant", "a", 1.0), (9, 2, 1, "assistant", "a", 1.0)]
        df = spark.createDataFrame(messages, "conv_id long, message_id long, parent_id long, role string, text string, score double")
        got = chat.format_trees(df).withColumn("turns", chat.read_back(F.col("formatted"))).collect()
        assert sorted(((r.conv_id, r.leaf_id, "|".join(t.text for t in r.turns)) for r in got), key=repr) == _brute(messages)


def test_long_conversation(spark):
    flat = spark.range(1000).select(F.lit(3).alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.col("id").cast("string").alias("text"))
    rows = chat.format_trees(chat.chain(flat), branches=1).withColumn("turns", chat.read_back(F.col("formatted"))).collect()
    assert len(rows) == 1 and [t.text for t in rows[0].turns] == [str(k) for k in range(1000)]
