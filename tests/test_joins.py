from pyspark.sql import functions as F

from catalens.operators.joins import look_up


def test_repeated_rows_are_not_broadcast(spark):
    """The estimate of the repeated table leaves out the repeats, so a table just below the threshold would go to the driver 16 times."""
    rows = spark.range(1000).select((F.col("id") % 7).alias("k"), "id")
    table = spark.range(7).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    found = look_up(rows, table, ["k"])
    assert sorted(map(tuple, found.collect())) == sorted((i % 7, i, i % 7 * 2) for i in range(1000))
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
