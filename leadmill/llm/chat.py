"""Chat formatting of reply trees, in DataFrame functions only.

Messages form trees by their parents.  Iterative self-joins double the step of
every message towards its root, which gives depth and path score in as many
rounds as the depth has binary digits.  Leaves are ranked by the mean score of
their path; the messages of each chosen path are then marked by the same steps
in reverse, so a path costs as many rows as it has messages, and each path is
formatted as one conversation.

The template is ``<|im_start|>role\\ntext<|im_end|>\\n``.  Inside a text every
``<|`` (also with backslashes between) gets one more backslash, so a control
string never comes from a text; a role is percent-escaped.  Both are reversible.

Rounds are stored in the shared folder, so a lost executor re-reads them.  A
conversation becomes one string, which bounds it by the size of a Spark row.

Defined results: a null text is empty; a null role is empty; messages with equal
turns are ordered by role and text, repeated rows stay repeated; null
``conv_id`` is a conversation of its own; a message whose parent is missing is a
root; messages on or below a cycle have no root and belong to no path; an empty
table gives no conversations.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leadmill import storage

START, END = "<|im_start|>", "<|im_end|>"
LOSS_ROLE = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    for raw, coded in (("%", "%25"), ("\n", "%0A"), ("<", "%3C")):
        role = F.replace(role, F.lit(raw), F.lit(coded))
    return role


def unescape_role(role: Column) -> Column:
    for raw, coded in (("<", "%3C"), ("\n", "%0A"), ("%", "%25")):
        role = F.replace(role, F.lit(coded), F.lit(raw))
    return role


def linear_replies(turns: DataFrame) -> DataFrame:
    """Conversations as reply chains: each row replies to the one before it."""
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    node = F.row_number().over(order).cast("long")
    return turns.select("conv_id", "turn", "role", "text", node.alias("node")).select(
        "conv_id", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"),
        "role", "text", F.lit(0.0).alias("score"),
    )


def _same(left: DataFrame, right: DataFrame, left_node: str, right_node: str) -> Column:
    return left["conv_id"].eqNullSafe(right["conv_id"]) & (left[left_node] == right[right_node])


def _steps_to_root(messages: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Depth and path score of every message with a root, and the steps of each round."""
    nodes = messages.select("conv_id", "node", "parent", "score")
    known = messages.select(F.col("conv_id").alias("p_conv"), F.col("node").alias("p_node"))
    found = nodes["conv_id"].eqNullSafe(known["p_conv"]) & (nodes["parent"] == known["p_node"])
    state = nodes.join(known, found, "left").select(
        "conv_id", "node", F.col("p_node").alias("jump"),
        F.when(F.col("p_node").isNotNull(), 1).otherwise(0).cast("long").alias("depth"),
        F.coalesce("score", F.lit(0.0)).alias("total"),
    )
    state = storage.materialize(state, "replies")
    finished = [state.filter("jump IS NULL")]
    moving, rounds = state.filter("jump IS NOT NULL"), []
    longest = state.groupBy("conv_id").count().agg(F.max("count")).first()[0] or 0
    # Twice the step each round; only messages that are not at a root yet take part.
    for _ in range(max(0, longest - 1).bit_length()):
        if moving.isEmpty():
            break
        rounds.append(moving.select("conv_id", "node", "jump"))
        ahead = reduce(DataFrame.union, finished, moving).select(
            F.col("conv_id").alias("a_conv"), F.col("node").alias("a_node"), F.col("jump").alias("a_jump"),
            F.col("depth").alias("a_depth"), F.col("total").alias("a_total"),
        )
        met = moving["conv_id"].eqNullSafe(ahead["a_conv"]) & (moving["jump"] == ahead["a_node"])
        state = storage.materialize(
            moving.join(ahead, met).select(
                "conv_id", "node", F.col("a_jump").alias("jump"),
                (F.col("depth") + F.col("a_depth")).alias("depth"), (F.col("total") + F.col("a_total")).alias("total"),
            ),
            "replies",
        )
        finished.append(state.filter("jump IS NULL"))
        moving = state.filter("jump IS NOT NULL")
    return reduce(DataFrame.union, finished), rounds


def best_paths(messages: DataFrame, top: int = 1) -> DataFrame:
    """Messages of the *top* best root-to-leaf paths of each conversation.

    *messages*: ``conv_id, node, parent, score``.  Best: largest mean score,
    then the longer path, then the smaller leaf.  Returns ``conv_id, path`` (from
    1), ``node, depth, path_score``.
    """
    rooted, rounds = _steps_to_root(messages)
    replied = messages.select(F.col("conv_id").alias("p_conv"), F.col("parent").alias("p_node"))
    is_reply = rooted["conv_id"].eqNullSafe(replied["p_conv"]) & (rooted["node"] == replied["p_node"])
    mean = F.col("total") / (F.col("depth") + 1)
    rank = F.row_number().over(
        W.partitionBy("conv_id").orderBy(mean.desc(), F.col("depth").desc(), F.col("node"))
    )
    marked = (
        rooted.join(replied, is_reply, "left_anti")
        .select("conv_id", rank.alias("path"), "node", mean.alias("path_score"))
        .filter(F.col("path") <= top)
    )
    marked = storage.materialize(marked, "paths")
    for steps in reversed(rounds):
        up = steps.select(
            F.col("conv_id").alias("s_conv"), F.col("node").alias("s_node"), F.col("jump").alias("s_jump")
        )
        met = marked["conv_id"].eqNullSafe(up["s_conv"]) & (marked["node"] == up["s_node"])
        above = marked.join(up, met).select("conv_id", "path", F.col("s_jump").alias("node"), "path_score")
        marked = storage.materialize(marked.union(above), "paths")
    deep = rooted.select(F.col("conv_id").alias("d_conv"), F.col("node").alias("d_node"), "depth")
    met = marked["conv_id"].eqNullSafe(deep["d_conv"]) & (marked["node"] == deep["d_node"])
    return marked.join(deep, met).select("conv_id", "path", "node", "depth", "path_score")


def format_paths(messages: DataFrame, top: int = 1) -> DataFrame:
    """One formatted conversation per chosen path.

    *messages*: ``conv_id, node, parent, role, text, score``; nodes are unique in
    a conversation.  Returns ``conv_id, path, path_score, formatted`` and
    ``turns``: for each turn its ``start`` in *formatted* and the ``loss_start``
    and ``loss_length`` of its part of the loss mask, in code points.
    """
    messages = messages.select("conv_id", "node", "parent", "role", "text", "score")
    chosen = best_paths(messages, top)
    said = messages.select(
        F.col("conv_id").alias("m_conv"), F.col("node").alias("m_node"),
        escape_role(F.coalesce("role", F.lit(""))).alias("m_role"),
        escape(F.coalesce("text", F.lit(""))).alias("m_text"),
        (F.coalesce("role", F.lit("")) == LOSS_ROLE).alias("m_loss"),
    )
    met = chosen["conv_id"].eqNullSafe(said["m_conv"]) & (chosen["node"] == said["m_node"])
    head = F.concat(F.lit(START), F.col("m_role"), F.lit("\n"))
    turns = chosen.join(said, met).select(
        "conv_id", "path", "path_score", "depth", "m_loss",
        F.length(head).alias("head_chars"), F.length("m_text").alias("text_chars"),
        F.concat(head, F.col("m_text"), F.lit(END + "\n")).alias("piece"),
    )
    before = W.partitionBy("conv_id", "path").orderBy("depth").rowsBetween(W.unboundedPreceding, -1)
    placed = turns.withColumn(
        "start", F.coalesce(F.sum(F.length("piece").cast("long")).over(before), F.lit(0).cast("long"))
    )
    mask = F.struct(
        "depth", "piece", "start", (F.col("start") + F.col("head_chars")).alias("loss_start"),
        F.when(F.col("m_loss"), F.col("text_chars")).otherwise(0).alias("loss_length"),
    )
    gathered = placed.groupBy("conv_id", "path").agg(
        F.max("path_score").alias("path_score"), F.sort_array(F.collect_list(mask)).alias("all")
    )
    return gathered.select(
        "conv_id", "path", "path_score",
        F.array_join(F.transform("all", lambda t: t["piece"]), "").alias("formatted"),
        F.transform(
            "all", lambda t: F.struct(t["start"].alias("start"), t["loss_start"].alias("loss_start"),
                                      t["loss_length"].alias("loss_length"))
        ).alias("turns"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """``conv_id, path, messages`` (role, text) and ``loss_text``, read from the output alone."""
    pieces = F.slice(F.split("formatted", r"<\|im_start\|>", -1), 2, 1 << 30)
    both = F.arrays_zip(pieces.alias("piece"), F.col("turns").alias("turn"))

    def message(z):
        body = z["piece"]
        role = F.substring_index(body, "\n", 1)
        text = F.substr(
            body, F.length(role) + 2, F.length(body) - F.length(role) - F.lit(2 + len(END))
        )
        return F.struct(unescape_role(role).alias("role"), unescape(text).alias("text"))

    def loss(z):
        at = z["turn"]["loss_start"] - z["turn"]["start"] - F.lit(len(START)) + 1
        return unescape(F.substr(z["piece"], at.cast("int"), z["turn"]["loss_length"]))

    return formatted.select("conv_id", "path", "formatted", both.alias("_both")).select(
        "conv_id", "path", "formatted",
        F.transform("_both", message).alias("messages"),
        F.array_join(F.transform("_both", loss), "").alias("loss_text"),
    )
