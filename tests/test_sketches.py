"""Distinct counts from stored sketches."""

from pyspark.sql import functions as F

from catalens.operators import profile


def test_united_sketches_are_within_their_error(spark, tmp_path):
    rows = spark.range(60_000).select((F.col("id") % 7).alias("day"), (F.col("id") % 3).alias("shop"),
                                      F.when(F.col("id") % 11 > 0, F.col("id") % 20_011).alias("a"), (F.col("id") % 5).alias("b"))
    for lg_k in (8, 12):
        stored = profile.distinct_sketches(rows, ["a", "b"], ["day", "shop"], lg_k)
        stored.write.mode("overwrite").parquet(str(tmp_path / "s"))
        again = spark.read.parquet(str(tmp_path / "s"))
        assert again.count() == 21
        for by in (["day"], ["shop"], []):
            exact = {tuple(r)[: len(by)]: r for r in rows.groupBy(*by).agg(F.count_distinct("a").alias("a"), F.count_distinct("b").alias("b")).collect()}
            for r in profile.distinct_estimates(again, ["a", "b"], by).collect():
                true = exact[tuple(r)[: len(by)]][r["column_name"]]
                assert abs(r["estimate"] - true) <= profile.sketch_error(lg_k) * true + 0.5
    none = profile.distinct_sketches(rows.limit(0), ["a"], ["day"])
    assert profile.distinct_estimates(none, ["a"], ["day"]).collect() == []
