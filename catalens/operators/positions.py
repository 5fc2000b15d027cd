"""Row numbers without a single-task sort."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from catalens.session import materialize


def positions(df: DataFrame, group: str | None, order: list[str]) -> DataFrame:
    """Add ``pos`` (0, 1, ... in ``order``, within ``group`` if given) and ``total`` (rows of the group).

    A range partitioning on (group, order) splits a large group over many tasks. Only (partition, group) counts meet
    in a window, at most one row per partition and group, and the rows get their offset by a join on both. The sorted
    rows are stored first, so that partition numbers are fixed even if a task is run again.
    """
    by = [group] if group else []
    spread = df.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order)
    stored = materialize(
        spread.withColumn("pid", F.spark_partition_id()).withColumn(
            "at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
        ),
        "positions",
    )
    whole = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    before = whole.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    parts = (
        stored.groupBy("pid", *by)
        .agg(F.min("at").alias("low"), F.count("*").alias("n"))
        .withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .withColumn("total", F.sum("n").over(whole))
    )
    return (
        stored.join(parts, ["pid", *by])
        .withColumn("pos", F.col("start") + F.col("at") - F.col("low"))
        .drop("pid", "at", "low", "n", "start")
    )
