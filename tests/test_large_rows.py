"""Tables with rows of some MB are stored in small pages and row groups, so that no reader holds hundreds of them at once."""

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from catalens.operators import vectors
from catalens.session import materialize


def test_row_groups_of_large_rows(spark):
    """Rows that do not compress: 100 of 400 kB went into one row group, and one page a column, before."""
    digests = F.transform(F.sequence(F.lit(1), F.lit(6000)), lambda i: F.sha2(F.concat_ws("-", "id", i), 512))
    rows = materialize(spark.range(120, numPartitions=1).select("id", F.unhex(F.array_join(digests, "")).alias("data")), "rows").coalesce(1)
    stored = materialize(rows, "large", large_rows=True)
    files = [f.removeprefix("file:").replace("///", "/") for f in stored.inputFiles()]
    groups = [g for f in files for m in [pq.ParquetFile(f).metadata] for g in map(m.row_group, range(m.num_row_groups))]
    assert sum(g.num_rows for g in groups) == 120 and max(g.total_byte_size for g in groups) < 24 << 20
    assert stored.exceptAll(rows).count() == 0
    assert len(groups) > 2


def test_slices_are_large_rows_of_narrow_numbers(spark, monkeypatch):
    seen, kept = {}, vectors.materialize
    monkeypatch.setattr(vectors, "materialize", lambda df, label, large_rows=False: seen.setdefault(label, large_rows) and None or kept(df, label, large_rows))
    docs = spark.createDataFrame([(1, "aa bb aa"), (2, "bb " * 300), (3, None), (4, "")], "id long, text string")
    slices = vectors.counted(docs.coalesce(1), ["id"], "text", [])
    assert seen["counted"] and sorted(map(tuple, vectors._each(slices, ["id"]).collect())) == [
        (1, "aa", 2), (1, "bb", 1), (2, "bb", 300)]
    [r] = slices.collect()
    assert len(r["places"]) == 3 and len(r["times"]) == 6  # one byte a place, two a number of times
