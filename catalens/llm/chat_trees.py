"""Reply trees to chat-formatted conversations, in DataFrame operations alone.

Every message names the message it replies to. Self-joins double the distance that each message sees towards its root,
so a tree of depth d takes about log2(d) joins. They give the length and score of every root-to-leaf path before any
path is written out. Branches of a tree are ranked by score, and only the chosen ones are enumerated, by the same
doubling tables read from the largest distance to the smallest. The template marks turns; control strings inside texts
are escaped and can be read back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalens.session import materialize

# The turn marks of the chat template.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
LOSS_ROLE = "assistant"
#: Rounds of joins between two written tables when paths are enumerated.
ROUNDS = 5


def escape(text: Column, one_line: bool = False) -> Column:
    r"""Reversible: a backslash becomes \b, "<|" becomes \l and, where a line must not end, a line feed becomes \n."""
    out = F.replace(text, F.lit("\\"), F.lit("\\b"))
    out = F.replace(out, F.lit("\n"), F.lit("\\n")) if one_line else out
    return F.replace(out, F.lit("<|"), F.lit("\\l"))


def unescape(text: Column) -> Column:
    out = F.replace(F.replace(text, F.lit("\\l"), F.lit("<|")), F.lit("\\n"), F.lit("\n"))
    return F.replace(out, F.lit("\\b"), F.lit("\\"))


def doubling(nodes: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(node_id, score, n) summed up to the root for every node that has one, and the tables of jumps.

    Jump table k has (node_id, up): the node 2^k replies above, where there is one.
    """
    ids = nodes.select(F.col("node_id").alias("up"))
    state = materialize(
        nodes.select("node_id", F.col("parent_id").alias("up"), "score").join(ids.withColumn("is", F.lit(True)), "up", "left")
        .select("node_id", F.when(F.col("is"), F.col("up")).alias("up"), "score", F.lit(1).cast("long").alias("n")), "chat-up")
    jumps, n = [], state.count()
    while 1 << len(jumps) <= n:
        open_ = state.filter(F.col("up").isNotNull())
        if open_.isEmpty():
            break
        jumps.append(open_.select("node_id", "up"))
        above = state.select(F.col("node_id").alias("up"), F.col("up").alias("far"), F.col("score").alias("more"),
                             F.col("n").alias("n_more"))
        further = open_.join(above, "up").select(
            "node_id", F.col("far").alias("up"), (F.col("score") + F.col("more")).alias("score"),
            (F.col("n") + F.col("n_more")).alias("n"))
        state = materialize(further.unionByName(state.filter(F.col("up").isNull())), "chat-up")
    return state.filter(F.col("up").isNull()).drop("up"), jumps  # what is still open now runs in a circle


def choose(nodes: DataFrame, totals: DataFrame, branches: int | None) -> DataFrame:
    """(tree_id, path_id, branch, path_score): leaves by falling path score, then length, then id; the best few, or all."""
    parents = nodes.select(F.col("parent_id").alias("node_id")).filter(F.col("node_id").isNotNull()).distinct()
    leaves = nodes.select("tree_id", "node_id").join(parents, "node_id", "left_anti").join(totals, "node_id")
    best = Window.partitionBy("tree_id").orderBy(F.desc("score"), F.desc("n"), "node_id")
    ranked = leaves.withColumn("branch", F.row_number().over(best))
    ranked = ranked if branches is None else ranked.filter(F.col("branch") <= branches)
    return ranked.select("tree_id", F.col("node_id").alias("path_id"), "branch", F.col("score").alias("path_score"))


def enumerate_paths(chosen: DataFrame, jumps: list[DataFrame]) -> DataFrame:
    """(path_id, node_id, back): every node of each chosen path; ``back`` counts replies from the leaf."""
    paths = chosen.select("path_id", F.col("path_id").alias("node_id"), F.lit(0).cast("long").alias("back"))
    for done, k in enumerate(reversed(range(len(jumps))), 1):
        here = F.struct("node_id", "back")
        there = F.struct(F.col("up").alias("node_id"), (F.col("back") + (1 << k)).alias("back"))
        both = F.when(F.col("up").isNull(), F.array(here)).otherwise(F.array(here, there))
        paths = paths.join(jumps[k], "node_id", "left").select("path_id", F.explode(both).alias("x")).select("path_id", "x.*")
        if done % ROUNDS == 0:
            paths = materialize(paths, "chat-paths")
    return paths


def format_trees(nodes: DataFrame, branches: int | None = None) -> DataFrame:
    """One conversation per chosen root-to-leaf path: tree_id, path_id, branch, path_score, formatted, turns.

    ``nodes`` has tree_id, node_id, parent_id, role, text, score; node ids are unique over all trees and of any type that
    joins. ``turns`` has for each turn where it begins in ``formatted`` and the span of its text under the loss mask (empty
    for other roles), in characters. Null role or text: empty; null score: 0; null node id: left out. A parent that is
    null or not there makes a root. Repeated node ids: the least (parent, role, text, score) counts. A node in a circle
    of replies, or below one, has no root and is on no path. Null tree ids are one tree. Other columns are not read.
    """
    row = F.struct("tree_id", "parent_id", F.coalesce("role", F.lit("")).alias("role"),
                   F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    nodes = materialize(
        nodes.filter(F.col("node_id").isNotNull()).groupBy("node_id").agg(F.min(row).alias("x")).select("node_id", "x.*"),
        "chat-nodes")
    totals, jumps = doubling(nodes.select("node_id", "parent_id", "score"))
    chosen = materialize(choose(nodes, totals, branches), "chat-chosen")
    paths = enumerate_paths(chosen, jumps)
    role, text = escape(F.col("role"), one_line=True), escape(F.col("text"))
    head = F.concat(F.lit(OPEN), role, F.lit("\n"))
    turns = paths.join(nodes.select("node_id", "role", "text"), "node_id").select(
        "path_id", "back", F.concat(head, text, F.lit(f"{CLOSE}\n")).alias("turn"), F.length(head).alias("head"),
        F.when(F.col("role") == LOSS_ROLE, F.length(text)).otherwise(0).alias("loss"))
    in_order = Window.partitionBy("path_id").orderBy(F.desc("back"))
    at = F.sum(F.length("turn")).over(in_order) - F.length("turn")
    span = F.struct(F.col("at"), (F.col("at") + F.col("head")).alias("start"), (F.col("at") + F.col("head") + F.col("loss")).alias("end"))
    whole = turns.withColumn("at", at).groupBy("path_id").agg(
        F.array_sort(F.collect_list(F.struct(span.alias("span"), "turn"))).alias("all"))
    return whole.join(chosen, "path_id").select(
        "tree_id", "path_id", "branch", "path_score", F.array_join("all.turn", "").alias("formatted"),
        F.col("all.span").alias("turns"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Add ``messages`` (role, text, loss: the unescaped text under the mask), taken from formatted and turns alone."""
    cut = F.split("formatted", r"<\|im_start\|>")
    parts = F.arrays_zip(F.slice(cut, 2, F.size("turns")).alias("part"), F.col("turns").alias("span"))

    def message(x: Column) -> Column:
        role = F.substring_index(x["part"], "\n", 1)
        text = F.substring(x["part"], F.length(role) + 2, F.length(x["part"]) - F.length(role) - 1 - len(CLOSE) - 1)
        begin, size = x["span"]["start"] - x["span"]["at"] - len(OPEN), x["span"]["end"] - x["span"]["start"]
        loss = F.substring(x["part"], (begin + 1).cast("int"), size.cast("int"))
        return F.struct(unescape(role).alias("role"), unescape(text).alias("text"), unescape(loss).alias("loss"))

    return formatted.withColumn("messages", F.transform(parts, message))


def threads(rows: DataFrame) -> DataFrame:
    """Conversations as reply trees: each row replies to the one before it, by turn, then role and text.

    A null conversation id is a conversation of its own. Longer texts score higher; a conversation has one branch anyway.
    """
    rows = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    number = rows.withColumn("n", F.row_number().over(order))
    return number.select(
        F.col("conv_id").alias("tree_id"), F.struct("conv_id", "n").alias("node_id"),
        F.when(F.col("n") > 1, F.struct("conv_id", (F.col("n") - 1).alias("n"))).alias("parent_id"),
        "role", "text", F.length("text").cast("double").alias("score"))


def digests(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from the formatted text."""
    lines = F.transform("messages", lambda m: F.concat(m["role"], F.lit("\n"), m["text"], F.lit("\n")))
    loss = F.array_join("messages.loss", "")
    return read_back(formatted).select(
        F.col("tree_id").alias("conv_id"), F.size("messages").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))
