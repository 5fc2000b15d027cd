"""Connected components of links, and joins that a large group of rows does not slow down."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalens.session import materialize

#: A group with at least this share of all rows is hot; so at most 10,000 groups are, about 1 MB to broadcast.
HOT_SHARE = 1e-4
HOT_LEAST = 100


def join_groups(rows: DataFrame, groups: DataFrame, key: list[str], size: str, n_rows: int) -> DataFrame:
    """Inner join with ``groups``, unique on ``key``, whose column ``size`` says how many rows each will meet.

    Hot groups are broadcast, since their number is bounded by their share; all others meet by a shuffle.
    """
    hot = F.col(size) >= F.lit(max(n_rows * HOT_SHARE, HOT_LEAST))
    return rows.join(F.broadcast(groups.filter(hot)), key).unionByName(
        rows.join(F.broadcast(groups.filter(hot).select(*key)), key, "left_anti").join(groups.filter(~hot), key))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for all ends of edges (a, b), long ids; the component is its smallest node.

    Alternating large and small stars: every node hands its larger, then its smaller-or-equal neighbours to the least of its
    neighbourhood. Rows are as many as edges, and each round is written to the shared folder. Loops are allowed.
    """
    now = materialize(edges.select("a", "b").filter("a <> b").distinct(), "stars")
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = materialize(large, "stars")
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("x"))
        now = materialize(small.select(F.col("x.b").alias("a"), F.col("x.m").alias("b")).filter("a <> b").distinct(), "stars")
        new = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if new == mark:
            break
        mark = new
    top = now.select(F.col("b").alias("node"), F.col("b").alias("component"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(top).distinct()
