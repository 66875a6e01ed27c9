"""Chat formatting of reply trees, in DataFrame operations only.

Messages form trees by ``parent_id``. Self-joins enumerate every root-to-leaf path by doubling: a round joins the
links to ancestors 1, 2, 4, ... levels up with themselves, then each leaf's known part of the path with one of them, so
a path of n messages takes about log2(n) rounds of both kinds. Branches are ranked by the mean score of their messages
(to nine digits), then by length, then by leaf id; the texts join only the chosen paths, each of which becomes one conversation.

The template marks a turn as ``<|im_start|>role``, line feed, text, ``<|im_end|>``, line feed. Backslashes in
roles and texts are doubled, and a control string in them gets one backslash after its first character, so
that none is left; both are undone exactly. A line feed inside a role is written as ``<|nl|>``.

Null text and null role count as empty; a missing score counts for nothing in the mean, and branches without any
come last. Messages without a conv_id are one conversation, whose conv_id is null. A message without a message_id answers
like any other, but nothing can answer it: it is a leaf, whose leaf_id is null. A message whose parent is missing is a
root. Messages on a cycle, and those whose ancestors lead into one, give no path. Rows repeated with one id are separate
messages: replies belong to the first of them by parent_id and score (then by a hash of role and text), so the others are leaves. A flat table
orders ties of ``turn`` by role and text. Further columns are ignored. An empty table gives an empty result. A
conversation becomes one row, so it must fit into one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.llm.common import body, cut, stored

START, END, NEWLINE = "<|im_start|>", "<|im_end|>", "<|nl|>"
#: Strings that some chat template gives a meaning. "<|" begins all of this template's own.
CONTROL = ("<|", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<s>", "</s>")


def escape(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return reduce(lambda t, c: F.replace(t, F.lit(c), F.lit(f"{c[0]}\\{c[1:]}")), CONTROL, text)


def unescape(text: Column) -> Column:
    """Undo :func:`escape`: a single backslash inside a control string can only have come from there."""
    text = reduce(lambda t, c: F.replace(t, F.lit(f"{c[0]}\\{c[1:]}"), F.lit(c)), reversed(CONTROL), text)
    return F.replace(text, F.lit("\\\\"), F.lit("\\"))


def chain(conversations: DataFrame) -> DataFrame:
    """A flat table (conv_id, turn, role, text) as messages of one branch: each row replies to the one before."""
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = conversations.select("conv_id", "turn", body("role").alias("role"), body("text").alias("text"))
    rows = rows.withColumn("message_id", F.row_number().over(order).cast("long"))
    parent = F.when(F.col("message_id") > 1, F.col("message_id") - 1)
    return rows.select("conv_id", "message_id", parent.alias("parent_id"), "role", "text", F.lit(1.0).alias("score"))


def _numbered(messages: DataFrame) -> DataFrame:
    """The messages as a stored table in which ``row`` tells them apart."""
    rows = messages.select("conv_id", "message_id", "parent_id", body("role").alias("role"), body("text").alias("text"), F.col("score").cast("double").alias("score"))
    return stored(rows.withColumn("row", F.monotonically_increasing_id()), "messages")


def _links(numbered: DataFrame) -> DataFrame:
    """``conv_id, message_id, row, parent, score`` with ``parent``, the row of the message answered, or null; no texts."""
    order = F.struct("parent_id", "score", F.xxhash64("role", "text").alias("mark"), "row")
    rows = numbered.select("conv_id", "message_id", "parent_id", "row", "score")
    known = numbered.where("message_id IS NOT NULL").groupBy(F.col("conv_id").alias("of"), F.col("message_id").alias("answered")).agg(F.min(order)["row"].alias("parent"))
    found = rows.join(known, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("parent_id") == F.col("answered")), "left")
    return found.select("conv_id", "message_id", "row", "parent", "score")


def paths(numbered: DataFrame) -> DataFrame:
    """Root-to-leaf paths: ``leaf, conv_id, leaf_id, up, row, score``, a row per message, ``up`` steps from the leaf."""
    links = stored(_links(numbered), "links")
    size, jumps = links.count(), []
    above = links.select(F.col("row").alias("to"), F.col("score").alias("to_score"))
    jump = stored(links.where("parent IS NOT NULL").select("row", F.col("parent").alias("to")).join(above, "to").select("row", "to", "to_score"), "jump")
    while not jump.isEmpty() and 1 << len(jumps) <= size:
        jumps.append(jump)
        further = jump.select(F.col("row").alias("to"), F.col("to").alias("next"), F.col("to_score").alias("next_score"))
        jump = stored(jump.select("row", "to").join(further, "to").select("row", F.col("next").alias("to"), F.col("next_score").alias("to_score")), "jump")
    leaves = links.join(links.select(F.col("parent").alias("row")).distinct(), "row", "left_anti")
    # who still has an ancestor so many levels up has a cycle above
    leaves = leaves.join(jump.select("row"), "row", "left_anti")
    found = stored(leaves.select(F.col("row").alias("leaf"), "conv_id", F.col("message_id").alias("leaf_id"), F.lit(0).cast("long").alias("up"), "row", "score"), "paths")
    for k, jump in enumerate(jumps):
        more = found.drop("score").join(jump, "row").select("leaf", "conv_id", "leaf_id", (F.col("up") + (1 << k)).alias("up"), F.col("to").alias("row"), F.col("to_score").alias("score"))
        found = stored(found.unionByName(more), "paths")
    return found


def format_trees(messages: DataFrame, branches: int | None = None) -> DataFrame:
    """One row per chosen path: ``conv_id, leaf_id, rank, score, formatted, loss_spans``.

    ``messages`` has conv_id, message_id, parent_id, role, text, score; ``branches`` is how many of the best
    branches of a conversation to keep (all if None). ``loss_spans`` are the (start, length) in code points, from
    0, of the assistant's texts in ``formatted``.
    """
    numbered = _numbered(messages)
    found = paths(numbered)
    chosen = found.groupBy("leaf").agg(F.first("conv_id").alias("conv_id"), F.first("leaf_id").alias("leaf_id"), F.round(F.avg("score"), 9).alias("score"), F.count("*").alias("n_turns"))
    if branches is not None:
        best = W.partitionBy("conv_id").orderBy(F.desc("score"), F.desc("n_turns"), "leaf_id", "leaf")
        chosen = cut(chosen.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= branches))
        found = found.join(chosen.select("leaf"), "leaf", "left_semi")
    else:
        chosen = chosen.withColumn("rank", F.lit(None).cast("int"))
    on_path = found.select("leaf", "up", "row").join(numbered.select("row", "role", "text"), "row")
    head = F.concat(F.lit(START), F.replace(escape(F.col("role")), F.lit("\n"), F.lit(NEWLINE)), F.lit("\n"))
    turn = F.struct(
        (-F.col("up")).alias("at"), head.alias("head"), escape(F.col("text")).alias("text"), (F.col("role") == "assistant").alias("loss")
    )
    whole = on_path.groupBy("leaf").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    size = lambda t: F.length(t["head"]) + F.length(t["text"]) + len(END) + 1
    none = F.array().cast("array<struct<start:int,length:int>>")
    span = lambda at, t: F.struct(at.alias("start"), F.length(t["text"]).alias("length"))
    step = lambda s, t: F.struct(
        (s["at"] + size(t)).alias("at"),
        F.when(t["loss"], F.array_append(s["spans"], span(s["at"] + F.length(t["head"]), t))).otherwise(s["spans"]).alias("spans"),
    )
    spans = F.aggregate("turns", F.struct(F.lit(0).alias("at"), none.alias("spans")), step, lambda s: s["spans"])
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["text"], F.lit(f"{END}\n"))), "")
    whole = whole.select("leaf", text.alias("formatted"), spans.alias("loss_spans"))
    return whole.join(chosen, "leaf").select("conv_id", "leaf_id", "rank", "score", "formatted", "loss_spans")


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text)."""
    parts = F.filter(F.split(formatted, r"<\|im_end\|>\n"), lambda p: p != "")
    inner = lambda p: F.substr(p, F.lit(len(START) + 1))
    role = lambda p: F.regexp_extract(inner(p), r"(?s)^([^\n]*)\n", 1)
    return F.transform(
        parts,
        lambda p: F.struct(
            unescape(F.replace(role(p), F.lit(NEWLINE), F.lit("\n"))).alias("role"),
            unescape(F.substr(inner(p), F.length(role(p)) + 2)).alias("text"),
        ),
    )
