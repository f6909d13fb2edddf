"""Chat formatting: reply trees to one formatted conversation per chosen branch.

Every message points at the message it answers. Rounds of self-joins double the pointers:
after round k a message knows its ancestor 2**k steps up, the length and the score of the way
there. So a tree of depth d takes log2(d) rounds, and only messages whose root is not reached
yet take part. Leaves are ranked per tree by the mean score of their path; the chosen paths are
then spelled out from the kept pointer tables, again in log2(d) joins, and formatted.

Formatted text: ``<|im_start|>role\\ntext<|im_end|>\\n`` per turn. A control string inside a text
or a role gets one more backslash after its ``<``, which undoes without loss.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from laurel.llm.words import filled
from laurel.session import cut_lineage

START, END = "<|im_start|>", "<|im_end|>\n"


def escape(text: Column) -> Column:
    """``<|`` becomes ``<\\|``, ``<\\|`` becomes ``<\\\\|`` and so on."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    """A role stands on one line: backslash and line end are written as ``\\\\`` and ``\\n``."""
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    halves = F.split(unescape(role), r"\\\\")
    return F.array_join(
        F.transform(halves, lambda x: F.replace(x, F.lit("\\n"), F.lit("\n"))), "\\"
    )


def best_branches(messages: DataFrame, branches: int | None = 1) -> DataFrame:
    """Root-to-leaf paths as rows (tree, leaf, message_id, from_leaf).

    ``messages`` has message_id (unique), parent_id and score. The root's id names the tree.
    A parent that is not in the table counts as none. Messages on a reply cycle have no root
    and are in no path. ``branches`` paths per tree by mean score, then leaf id; None: all.
    """
    nodes = messages.select(
        "message_id", "parent_id", F.coalesce("score", F.lit(0.0)).cast("double").alias("score")
    )
    ids = nodes.select(F.col("message_id").alias("_up"))
    known = nodes.join(ids, F.col("parent_id") == F.col("_up"), "left")
    at = cut_lineage(known.select(
        "message_id", F.col("_up").alias("up"), F.coalesce("_up", "message_id").alias("root"),
        F.lit(1).cast("bigint").alias("length"), "score",
    ))
    first = at.select("message_id", "up")
    rounds = math.ceil(math.log2(max(2, at.count()))) + 1
    jumps = []
    for _ in range(rounds):
        open_ = at.filter("up IS NOT NULL")
        if open_.isEmpty():
            break
        jumps.append(open_.select(F.col("message_id").alias("_id"), "up"))
        above = at.select(
            F.col("message_id").alias("_m"), F.col("up").alias("_up"), F.col("root").alias("_root"),
            F.col("length").alias("_length"), F.col("score").alias("_score"),
        )
        moved = open_.join(above, F.col("up") == F.col("_m")).select(
            "message_id", F.col("_up").alias("up"), F.col("_root").alias("root"),
            (F.col("length") + F.col("_length")).alias("length"),
            (F.col("score") + F.col("_score")).alias("score"),
        )
        at = cut_lineage(at.filter("up IS NULL").unionByName(moved))
    answered = first.select(F.col("up").alias("_a")).filter("_a IS NOT NULL")
    leaves = at.filter("up IS NULL").join(
        answered, F.col("message_id") == F.col("_a"), "left_anti"
    ).withColumn("mean", F.col("score") / F.col("length"))
    if branches is not None:
        # each task keeps its own best leaves per tree before the shuffle
        order = Window.partitionBy("root").orderBy(F.desc("mean"), "message_id")
        leaves = leaves.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= branches)
    paths = leaves.select(
        F.col("root").alias("tree"), F.col("message_id").alias("leaf"), "message_id",
        F.lit(0).cast("bigint").alias("from_leaf"),
    )
    for k, jump in enumerate(jumps):
        # paths holds 0 .. 2**k - 1 steps; the same rows moved 2**k up give the next ones
        paths = cut_lineage(paths)
        further = paths.join(jump, F.col("message_id") == F.col("_id")).select(
            "tree", "leaf", F.col("up").alias("message_id"),
            (F.col("from_leaf") + 2**k).alias("from_leaf"),
        )
        paths = paths.unionByName(further)
    return paths


def format_trees(messages: DataFrame, branches: int | None = 1) -> DataFrame:
    """(message_id, parent_id, role, text, score) to one row per chosen path:

    tree, leaf, n_turns, formatted, loss_spans (start, end in code points of ``formatted``:
    the text of each assistant turn). Null role or text is empty; a row without an id is a
    message nobody answers; repeated ids keep one row; other columns are ignored.
    """
    unnamed = F.concat(F.lit("unnamed:"), F.monotonically_increasing_id().cast("string"))
    named = messages.select(
        F.coalesce(F.col("message_id").cast("string"), unnamed).alias("message_id"),
        F.col("parent_id").cast("string").alias("parent_id"), "role", "text", "score",
    )
    fields = ["parent_id", "role", "text", "score"]
    kept = cut_lineage(named.groupBy("message_id").agg(F.min(F.struct(*fields)).alias("m")).select(
        "message_id", "m.*"
    ))
    paths = best_branches(kept, branches)
    texts = kept.select(F.col("message_id").alias("_id"), "role", "text")
    head = F.concat(F.lit(START), escape_role(filled(F.col("role"))), F.lit("\n"))
    turns = paths.join(texts, F.col("message_id") == F.col("_id")).select(
        "tree", "leaf", (-F.col("from_leaf")).alias("at"), head.alias("head"),
        escape(filled(F.col("text"))).alias("body"), (F.col("role") == "assistant").alias("loss"),
    ).withColumn("piece", F.concat("head", "body", F.lit(END)))
    before = Window.partitionBy("tree", "leaf").orderBy("at").rowsBetween(
        Window.unboundedPreceding, -1
    )
    start = F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0)) + F.length("head")
    placed = turns.withColumn("start", start).select("tree", "leaf", F.struct(
        "at", "piece", "start", (F.col("start") + F.length("body")).alias("end"), "loss"
    ).alias("turn"))
    gathered = placed.groupBy("tree", "leaf").agg(F.array_sort(F.collect_list("turn")).alias("t"))
    return gathered.select(
        "tree", "leaf", F.size("t").cast("bigint").alias("n_turns"),
        F.array_join(F.transform("t", lambda x: x["piece"]), "").alias("formatted"),
        F.transform(
            F.filter("t", lambda x: F.coalesce(x["loss"], F.lit(False))),
            lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")),
        ).alias("loss_spans"),
    )


def parse(formatted: Column) -> Column:
    """Formatted text back to an array of (role, text)."""
    parts = F.split(formatted, r"<\|im_start\|>")

    def turn(part: Column) -> Column:
        role = F.substring_index(part, "\n", 1)
        body = F.substring(
            part, F.length(role) + 2, F.length(part) - F.length(role) - 1 - len(END)
        )
        return F.struct(unescape_role(role).alias("role"), unescape(body).alias("text"))

    return F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), turn)


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(
        spans, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["end"] - s["start"]))
    ), "")


def chains(conversations: DataFrame) -> DataFrame:
    """Flat conversations (conv_id, turn, role, text) as reply trees of one branch.

    Turns follow ``turn`` (nulls first), ties ``role`` and ``text``; every row is a turn.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    numbered = conversations.select("conv_id", "turn", "role", "text").withColumn(
        "_n", F.row_number().over(order)
    )
    name = F.coalesce(F.col("conv_id").cast("string"), F.lit("none"))
    return numbered.select(
        F.concat(name, F.lit(":"), F.col("_n")).alias("message_id"),
        F.when(F.col("_n") > 1, F.concat(name, F.lit(":"), F.col("_n") - 1)).alias("parent_id"),
        "role", "text", F.lit(1.0).alias("score"),
    )
