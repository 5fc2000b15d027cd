"""Exact duplicates by a tree merge of sorted digest runs, in DataFrame operations alone.

Every row becomes (digest, check, bytes, id). Rows start in as many runs as the tree has leaves. In each round a run
meets ``fan_in - 1`` partners, and the digests they hold are dealt among them by their next leading bits, sorted and
merged, so that of each digest one entry is left per run: the id that stays and the number of rows. A run is sorted by digest, and
merging walks the sorted entries (a sort aggregate), which leaves the next run sorted. After the last round a run holds a whole
range of digests. A digest that half of all rows share thus reaches no task with more than ``fan_in`` entries
per round. The merge is verified at every level: entries only meet when SHA-256, an independent 64-bit hash and the
length all agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from catalens.session import materialize

KEY = ["digest", "check", "n_bytes"]
#: A group with at least this share of all rows is hot; so at most 10,000 groups are, about 1 MB to broadcast.
HOT_SHARE = 1e-4


def _digests(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"),
        F.xxhash64(text).alias("check"),
        F.octet_length(text).cast("long").alias("n_bytes"),
    )


def merge_runs(rows: DataFrame, keep: str = "max", fan_in: int = 8, rounds: int | None = None) -> DataFrame:
    """One row per distinct digest: the id that stays (largest or smallest; null only if all are) and the row count."""
    bits = fan_in.bit_length() - 1
    if 1 << bits != fan_in or fan_in < 2:
        raise ValueError("fan_in is a power of two")
    if rounds is None:
        tasks, rounds = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1
        while fan_in**rounds < tasks:
            rounds += 1
    pick = {"max": F.max, "min": F.min}[keep]
    known = F.col("doc_id").isNotNull() if keep == "max" else F.col("doc_id").isNull()  # a null id loses either way
    leaves = bits * rounds
    # The leading bits of the digest say which range it ends in; the id says in which leaf it starts.
    target = F.shiftright(F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long"), 32 - leaves)
    origin = F.pmod(F.xxhash64("doc_id"), F.lit(1 << leaves))
    order = ["run", "target", *KEY]

    def merged(runs: DataFrame) -> DataFrame:
        """Sorted runs in, one sorted run out: what is kept is a struct, which Spark combines by walking equal neighbours."""
        return runs.sortWithinPartitions(*order).groupBy(*order).agg(
            pick("kept").alias("kept"), F.sum("group_size").alias("group_size"))

    runs = merged(rows.select(
        origin.alias("run"), target.alias("target"), *KEY, F.struct(known.alias("known"), "doc_id").alias("kept"),
        F.lit(1).cast("long").alias("group_size")).repartition("run"))
    for level in range(1, rounds + 1):
        free = leaves - bits * level
        mask = (1 << free) - 1
        run = F.shiftleft(F.shiftright("target", free), free).bitwiseOR(F.col("run").bitwiseAND(F.lit(mask)))
        runs = merged(runs.withColumn("run", run).repartition("run"))
    return runs.select(*KEY, F.col("kept.doc_id").alias("keep_id"), "group_size")


def exact_dedup(docs: DataFrame, keep: str = "max", fan_in: int = 8, rounds: int | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Null texts equal empty ones. Of equal texts the row with the largest (or smallest) id stays; a null id loses to any
    other, and keep_id is null if a group has no id at all. Of repeated rows with one id and text, one is kept. Other
    columns of ``docs`` are not read. No rows in, no rows out.
    """
    again = Window.partitionBy("doc_id", *KEY).orderBy(F.lit(0))
    rows = materialize(_digests(docs).withColumn("nth", F.row_number().over(again)), "digests")
    groups = materialize(merge_runs(rows, keep, fan_in, rounds), "digest-groups")
    hot = F.col("group_size") >= F.lit(max(rows.count() * HOT_SHARE, 100.0))
    hot_groups = F.broadcast(groups.filter(hot))
    found = rows.join(hot_groups, KEY).unionByName(
        rows.join(F.broadcast(groups.filter(hot).select(*KEY)), KEY, "left_anti").join(groups.filter(~hot), KEY))
    return found.select(
        "doc_id", "keep_id", "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 1)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
