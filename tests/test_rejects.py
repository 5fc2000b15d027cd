"""Rejected values as rows, written while they are counted."""

from pyspark.sql import functions as F

from catalens.operators import profile

def checks():
    return {
        "whole": (F.col("a"), F.col("a").try_cast("int"), "not whole"),
        "number": (F.col("b"), F.col("b").try_cast("double"), "no number"),
    }


def frame(spark):
    rows = [(1, "5", "x"), (2, "5.5", "1e3"), (3, None, None), (4, "", "y"), (None, "z", "2"), (1, "q", "x")]
    return spark.createDataFrame(rows, "k long, a string, b string").repartition(3)


WANT = [(1, "number", "x", "no number"), (1, "number", "x", "no number"), (1, "whole", "q", "not whole"), (2, "whole", "5.5", "not whole"),
        (4, "number", "y", "no number"), (4, "whole", "", "not whole"), (None, "whole", "z", "not whole")]


def test_rows(spark):
    found = profile.reject_rows(frame(spark), "k", checks())
    assert found.columns == ["k", "check_name", "raw_text", "reason"]
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(WANT, key=repr)
    assert profile.reject_rows(frame(spark).limit(0), "k", checks()).collect() == []


def test_written_and_counted_in_one_scan(spark, tmp_path):
    frame(spark).write.parquet(str(tmp_path / "in"))
    source = spark.read.parquet(str(tmp_path / "in"))
    plan = profile.reject_rows(source, "k", checks())._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Exchange" not in plan and "Join" not in plan
    counts = profile.write_rejects(source, "k", checks(), str(tmp_path / "out"))
    assert counts == {"n_rows": 6, "whole": 4, "number": 3}
    again = spark.read.parquet(str(tmp_path / "out")).select("k", "check_name", "raw_text", "reason")
    assert sorted(map(tuple, again.collect()), key=repr) == sorted(WANT, key=repr)
    none = profile.write_rejects(source.limit(0), "k", checks(), str(tmp_path / "none"))
    assert none == {"n_rows": 0, "whole": 0, "number": 0}
