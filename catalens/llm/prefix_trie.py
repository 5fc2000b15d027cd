"""The trie of conversation prefixes, its subtree totals found by parallel tree contraction.

A node stands for all conversations whose first d turns agree; it is named by its smallest conversation and its depth. Prefixes
are compared by running sums of position-dependent 95-bit hashes of the turns, which can be added up in any order: a
conversation of any length is cut into chunks of turns.

Contraction works on the live nodes, (id, parent, what has been gathered), in join rounds. Rake: the totals of live leaves are
added to their parents by one grouped sum, however many siblings they are. Compress: of chains of nodes with one live child,
those with the least random number among their neighbours in the chain are taken out, and their child takes over their parent
with what they had gathered. Each round takes out all leaves and about a third of every chain, so rounds grow with the logarithm
of the tree. At the end the rounds are gone through backwards: a node that was taken out of a chain has the total of the child
that replaced it plus what it had itself. No join meets a key twice on both sides, and those of children with a parent of many
children treat it as a hot group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalens.llm.groups import join_groups
from catalens.operators.positions import positions
from catalens.session import materialize

#: Turns whose hashes one task adds up in order.
CHUNK = 1_024
#: Characters of joined conversation ids in one row.
PIECE = 32_768
WORD = r"[^\x20\x09-\x0D]+"
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, n_own, digest, words), stored: the turns of every conversation, numbered from 0.

    Nulls in turn come first; equal turns are ordered by role, then by the digest of role and text, so that texts need not be
    moved. A null role or text is an empty one. Rows without conv_id take no part.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    said = F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")
    rows = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"),
        F.substring(F.unhex(F.sha2(said, 256)), 1, 16).alias("digest"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))
    found = positions(rows, "conv_id", ["turn", "role", "digest"])
    return materialize(found.select("conv_id", "pos", F.col("total").alias("n_own"), "digest", "words"), "turns")


def own_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations as they are: (conv_id, n_turns) and (conv_id, depth, n_turns, digest, words), depths from 1."""
    convs = turns.groupBy("conv_id").agg(F.max("n_own").alias("n_turns"))
    return convs, turns.select("conv_id", (F.col("pos") + 1).alias("depth"), F.col("n_own").alias("n_turns"), "digest", "words")


def shared_heads(turns: DataFrame, every: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt so that they share beginnings; the columns of ``own_turns``.

    Conversation c gets the first h turns of conversation c - c % every (all if it has fewer, none if it is absent), then its own
    turns after its first h; h is crc32 of c's decimal digits modulo ``most``.
    """
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    convs = turns.groupBy("conv_id").agg(F.max("n_own").alias("n_own")).withColumns(
        {"h": head, "base": F.col("conv_id") - F.col("conv_id") % every})
    bases = convs.select(F.col("conv_id").alias("base"), F.col("n_own").alias("n_base"))
    convs = convs.join(bases, "base", "left").withColumn("taken", F.least("h", F.coalesce("n_base", F.lit(0))))
    convs = materialize(
        convs.withColumn("n_turns", F.col("taken") + F.greatest(F.col("n_own") - F.col("h"), F.lit(0))), "conversations")
    heads = turns.filter(F.col("pos") < most - 1).select(F.col("conv_id").alias("base"), "pos", "digest", "words")
    taken = convs.filter("taken > 0").join(heads, "base").filter("pos < h").select(
        "conv_id", (F.col("pos") + 1).alias("depth"), "n_turns", "digest", "words")
    sizes = convs.select("conv_id", "h", "taken", "n_turns", F.col("n_own").alias("size"))
    own = join_groups(turns, sizes, ["conv_id"], "size", turns.count()).filter("pos >= h").select(
        "conv_id", (F.col("taken") + F.col("pos") - F.col("h") + 1).alias("depth"), "n_turns", "digest", "words")
    return convs.select("conv_id", "n_turns"), taken.unionByName(own)


def _prefixes(turns: DataFrame, chunk: int) -> DataFrame:
    """(conv_id, depth, last, words, before, prefix): sums of hashes before and with every turn."""
    a, b = F.xxhash64("depth", "digest"), F.xxhash64("digest", "depth")
    wide = a.bitwiseAND(F.lit((1 << 63) - 1)).cast("decimal(19,0)") * F.lit(1 << 32).cast("decimal(10,0)")
    own = (wide + b.bitwiseAND(F.lit((1 << 32) - 1)).cast("decimal(10,0)")).cast("decimal(31,0)")
    rows = turns.select(
        "conv_id", "depth", (F.col("depth") == F.col("n_turns")).alias("last"), "words", own.alias("own"),
        F.expr(f"depth div {chunk}").alias("chunk"))
    earlier = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("conv_id", "chunk").agg(F.sum("own").alias("sum")).withColumn("start", F.sum("sum").over(earlier)).drop("sum")
    inside = Window.partitionBy("conv_id", "chunk").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    zero = F.lit(0).cast("decimal(38,0)")
    prefix = (F.coalesce("start", zero) + F.sum("own").over(inside)).cast("decimal(38,0)")
    return rows.join(sums, ["conv_id", "chunk"]).withColumn("prefix", prefix).select(
        "conv_id", "depth", "last", "words", (F.col("prefix") - F.col("own")).cast("decimal(38,0)").alias("before"), "prefix")


def _ends(ends: DataFrame) -> DataFrame:
    """(depth, prefix, ends_sha256): the ids of all conversations that end at a node, ascending and joined by commas.

    Ids are sorted and joined piece by piece in as many tasks as it takes; only pieces are put in order per node and hashed.
    """

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list]]:
        """(key, rows) for every stretch of equal keys within a batch."""
        for batch in batches:
            if not batch.num_rows:
                continue
            depth, prefix = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            edge = [0, *(i for i in range(1, len(depth)) if depth[i] != depth[i - 1] or prefix[i] != prefix[i - 1]), len(depth)]
            rest = batch.column(2).to_pylist()
            for a, b in zip(edge[:-1], edge[1:], strict=True):
                yield (depth[a], prefix[a]), rest[a:b]

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for (depth, prefix), ids in runs(batches):
            for at in range(0, len(ids), PIECE // 16):
                part = ids[at : at + PIECE // 16]
                out.append((depth, prefix, part[0], ",".join(map(str, part))))
            if len(out) > 2_000:
                yield table(out, [pa.int64(), pa.string(), pa.int64(), pa.string()], ["depth", "prefix", "first", "piece"])
                out = []
        yield table(out, [pa.int64(), pa.string(), pa.int64(), pa.string()], ["depth", "prefix", "first", "piece"])

    def table(rows: list[tuple], kinds: list, names: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, open_key, sha = [], None, None
        kinds, names = [pa.int64(), pa.string(), pa.string()], ["depth", "prefix", "ends_sha256"]
        for key, pieces in runs(batches):
            if key != open_key:
                if open_key:
                    out.append((*open_key, sha.hexdigest()))
                open_key, sha = key, hashlib.sha256()
            else:
                sha.update(b",")
            sha.update(",".join(pieces).encode())
            if len(out) > 10_000:
                yield table(out, kinds, names)
                out = []
        if open_key:
            out.append((*open_key, sha.hexdigest()))
        yield table(out, kinds, names)

    text = ends.select("depth", F.col("prefix").cast("string").alias("prefix"), "conv_id")
    key = ["depth", "prefix", "conv_id"]
    pieces = text.repartitionByRange(*key).sortWithinPartitions(*key).mapInArrow(
        join, "depth long, prefix string, first long, piece string")
    pieces = pieces.repartition("depth", "prefix").sortWithinPartitions("depth", "prefix", "first").select("depth", "prefix", "piece")
    found = pieces.mapInArrow(digest, "depth long, prefix string, ends_sha256 string")
    return found.withColumn("prefix", F.col("prefix").cast("decimal(38,0)"))


def _id(conv: str, depth: Column) -> Column:
    return F.struct(F.col(conv).alias("conv_id"), depth.cast("long").alias("depth"))


def subtree_sums(nodes: DataFrame, values: list[str]) -> DataFrame:
    """(id, one column per value): the sum over the subtree of every node, by contraction.

    ``nodes`` has id, parent (null at the root, or at the roots of several trees), n_children and the values, whole numbers;
    ids are of any type that can be hashed and ordered.
    """
    live = materialize(nodes.select(
        "id", "parent", F.col("n_children").cast("long").alias("n"), *[F.col(v).cast("long").alias(v) for v in values],
        *[F.lit(0).cast("long").alias(f"{v}_up") for v in values]), "live")
    known, taken = [], []  # what each round found: totals of leaves, and nodes taken out of chains
    while True:
        leaf = F.col("n") == 0
        known.append(live.filter(leaf).select("id", *values))
        if live.filter(~leaf).isEmpty():
            break
        gathered = live.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("id")).agg(
            F.count_if(~leaf).alias("n_left"), F.min(F.when(~leaf, F.col("id"))).alias("child"),
            *[F.coalesce(F.sum(F.when(leaf, F.col(v) + F.col(f"{v}_up"))), F.lit(0)).alias(f"{v}_in") for v in values])
        inner = materialize(live.filter(~leaf).join(gathered, "id").select(
            "id", "parent", F.col("n_left").alias("n"), F.when(F.col("n_left") == 1, F.col("child")).alias("child"),
            *[(F.col(v) + F.col(f"{v}_in")).alias(v) for v in values], *[f"{v}_up" for v in values]), "inner")
        chance = F.xxhash64("id", F.lit(len(taken)))
        chain = inner.filter("n = 1 AND parent IS NOT NULL").withColumn("chance", chance)
        above = chain.select(F.col("id").alias("parent"), F.col("chance").alias("above"))
        below = chain.select(F.col("id").alias("child"), F.col("chance").alias("below"))
        least = F.col("chance") < F.least(F.coalesce("above", F.lit((1 << 63) - 1)), F.coalesce("below", F.lit((1 << 63) - 1)))
        out = chain.join(above, "parent", "left").join(below, "child", "left").filter(least)
        out = materialize(out.select(
            F.col("child").alias("id"), F.col("id").alias("out"), F.col("parent").alias("new_parent"),
            *[F.col(v).alias(f"{v}_out") for v in values], *[(F.col(v) + F.col(f"{v}_up")).alias(f"{v}_more") for v in values]), "out")
        moved = inner.join(out, "id", "left").join(out.select(F.col("out").alias("id")), "id", "left_anti")
        # A node that was taken out has the total of its child, plus the child's way up as it was, plus its own.
        taken.append(out.join(inner.select("id", *[f"{v}_up" for v in values]), "id").select(
            "id", "out", *[(F.col(f"{v}_out") + F.col(f"{v}_up")).alias(f"{v}_plus") for v in values]))
        live = materialize(moved.select(
            "id", F.coalesce("new_parent", "parent").alias("parent"), "n", *values,
            *[(F.col(f"{v}_up") + F.coalesce(f"{v}_more", F.lit(0))).alias(f"{v}_up") for v in values]), "live")
    totals = known.pop()
    for leaves, out in zip(reversed(known), reversed(taken), strict=True):
        found = out.join(totals, "id").select(F.col("out").alias("id"), *[(F.col(v) + F.col(f"{v}_plus")).alias(v) for v in values])
        totals = totals.unionByName(materialize(found, "totals")).unionByName(leaves)
    return totals


def trie(convs: DataFrame, turns: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """One row per distinct prefix of the given conversations, from the textless root on.

    Gives conv_id (smallest member), depth, parent_conv_id (null at the root), n_convs (members), n_children, n_leaves (childless
    nodes of its subtree), saved_tokens (over its subtree: members but one times the words of the last text) and ends_sha256
    (of the comma-joined ascending ids of the members that end here). ``convs`` and ``turns`` are as ``own_turns`` gives them;
    conversations without turns are members of the root alone. Without conversations there is no node.
    """
    rows = materialize(_prefixes(turns, chunk), "prefixes")
    zero = F.lit(0).cast("decimal(38,0)")
    inner = rows.groupBy("depth", "prefix").agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("words").alias("words"),
        F.min("before").alias("before"))
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).filter("n_convs > 0").select(
        F.lit(0).cast("long").alias("depth"), zero.alias("prefix"), "conv_id", "n_convs", F.lit(0).cast("long").alias("words"),
        F.lit(None).cast("decimal(38,0)").alias("before"))
    nodes = materialize(inner.select(*root.columns).unionByName(root), "nodes")
    kids = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("before").alias("prefix")).agg(
        F.count(F.lit(1)).alias("n_children"))
    nodes = materialize(nodes.join(kids, ["depth", "prefix"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "nodes")
    parents = nodes.filter("n_children > 0").select(
        (F.col("depth") + 1).alias("depth"), F.col("prefix").alias("before"), F.col("conv_id").alias("parent_conv_id"),
        F.col("n_children").alias("size"))
    hung = join_groups(nodes.filter("depth > 0"), parents, ["depth", "before"], "size", nodes.count()).drop("size").unionByName(
        nodes.filter("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long")))
    ends = rows.filter("last").select("depth", "prefix", "conv_id").unionByName(
        convs.filter("n_turns = 0").select(F.lit(0).cast("long").alias("depth"), zero.alias("prefix"), "conv_id"))
    hung = materialize(hung.join(_ends(ends), ["depth", "prefix"], "left").withColumns({
        "id": _id("conv_id", F.col("depth")),
        "parent": F.when(F.col("depth") > 0, _id("parent_conv_id", F.col("depth") - 1)),
        "n_leaves": (F.col("n_children") == 0).cast("long"), "saved_tokens": (F.col("n_convs") - 1) * F.col("words"),
    }), "trie")
    sums = subtree_sums(hung, ["n_leaves", "saved_tokens"])
    return hung.drop("n_leaves", "saved_tokens").join(sums, "id").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(EMPTY_SHA256)).alias("ends_sha256"))


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of conversations as they are; see ``numbered_turns`` for order and nulls, ``trie`` for the columns.

    Other columns are not read. Repeated rows are further turns. No rows in, no rows out.
    """
    return trie(*own_turns(numbered_turns(conversations)))
