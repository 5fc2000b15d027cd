from pyspark.sql import functions as F

from catalens.fixtures import view
from catalens.sources import posters, tables

SF_DIR = "/root/testdata/sf0.001"


def same(a, b):
    return sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))


def test_csv_round_trip(spark, tmp_path):
    rows = [(1, 'Quote "this", please', "two\nlines", '[{"id": 1, "name": "A, B"}]', "[]"), (2, "Plain", None, "[]", "[]")]
    df = spark.createDataFrame(rows, tables.MOVIES)
    tables.write_csv(df, str(tmp_path / "movies"))
    assert same(tables.read_csv(spark, str(tmp_path / "movies"), tables.MOVIES), df)
    for name, schema in (("laptop_raw", tables.LAPTOPS), ("credits_raw", tables.CREDITS)):
        raw = view(spark, SF_DIR, name)
        tables.write_csv(raw, str(tmp_path / name))
        assert same(tables.read_csv(spark, str(tmp_path / name), schema), raw)


def test_table_round_trip(spark, tmp_path):
    raw = view(spark, SF_DIR, "laptop_raw")
    tables.write_table(raw, str(tmp_path / "t"))
    assert same(tables.read_table(spark, str(tmp_path / "t")), raw)


def test_neighbours_are_stored_by_facet(spark, tmp_path):
    df = spark.createDataFrame([(1, 2, 0.5, 1, "content"), (1, 3, 0.9, 1, "genre")], "id long, near_id long, score double, rank int, facet string")
    tables.write_neighbours(df, str(tmp_path / "n"))
    back = tables.read_table(spark, str(tmp_path / "n"))
    assert same(back.select(*df.columns), df)
    plan = back.where("facet = 'genre'")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(facet" in plan


def test_posters_fall_back_to_the_default(spark):
    rows = spark.createDataFrame([(1, "A"), (2, "B"), (3, "C"), (4, "D")], "movie_id long, title string")
    known = spark.createDataFrame([(1, "/a.jpg"), (2, None), (3, ""), (1, "/a.jpg")], "movie_id long, poster_path string")
    for bounded in (False, True):
        got = {r["movie_id"]: r for r in posters.with_posters(rows, known, bounded).collect()}
        assert len(got) == 4
        assert got[1]["poster"] == posters.IMAGE_BASE + "/a.jpg"
        assert {got[i]["poster"] for i in (2, 3, 4)} == {posters.DEFAULT_IMAGE}
        assert got[4]["link"] == posters.MOVIE_PAGE + "4-D"


def test_scratch_tables_go(spark):
    from pathlib import Path

    from catalens.session import materialize, scratch

    with scratch(spark):
        df = materialize(spark.range(5), "gone")
        folder = Path(df.inputFiles()[0].removeprefix("file://")).parent
        assert df.count() == 5 and folder.exists()
    assert not folder.exists()


def test_neighbour_buckets_are_read_alone(spark, tmp_path):
    """A look-up reads the buckets of its ids, and tables bucketed alike are joined without a shuffle."""
    rows = [(i, i, (i * 7) % 300, (i * 7) % 300, 0.5, 1, "genre") for i in range(300)]
    near = spark.createDataFrame(rows, "id long, movie_id long, near_id long, near_movie_id long, score double, rank int, facet string")
    for name in ("near_a", "near_b"):
        tables.write_neighbour_buckets(near, name, str(tmp_path / name), buckets=16)
    stored = tables.read_neighbour_buckets(spark, "near_a")
    assert len(list((tmp_path / "near_a").glob("part-*"))) == 16
    one = stored.where(F.col("id").isin([17]))
    assert [tuple(r) for r in one.collect()] == [rows[17]]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")  # else the plan does not tell the buckets
    try:
        again = stored.where(F.col("id").isin([17]))
        plan = again._jdf.queryExecution().executedPlan().toString()
        assert "SelectedBucketsCount: 1 out of 16" in plan and "Exchange" not in plan
        both = stored.join(tables.read_neighbour_buckets(spark, "near_b").select("id", F.col("score").alias("other")), "id")
        assert "Exchange" not in both._jdf.queryExecution().executedPlan().toString() and both.count() == 300
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
    for name in ("near_a", "near_b"):
        spark.sql(f"DROP TABLE {name}")
