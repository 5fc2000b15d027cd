import numpy as np
import pytest

from catalens.operators import charts, profile


@pytest.fixture(scope="module")
def values():
    rng = np.random.default_rng(5)
    return np.round(rng.lognormal(7.0, 0.6, 3000), 2)


@pytest.fixture(scope="module")
def frame(spark, values):
    data = [(i, "abc"[i % 3], float(v)) for i, v in enumerate(values)] + [(9000, "a", None)]
    return spark.createDataFrame(data, "id long, c string, v double")


def test_histogram_like_numpy(frame, values):
    got = {r["bin"]: r["n"] for r in charts.histogram(frame, "v").collect()}
    edges = np.histogram_bin_edges(values, "auto")
    counts, _ = np.histogram(values, edges)
    assert sum(got.values()) == len(values)
    assert len(edges) - 1 == len(counts) > max(got)
    assert sum(abs(got.get(i, 0) - n) for i, n in enumerate(counts)) <= 2  # values on an edge may fall either way


def test_histogram_of_one_value_and_of_nothing(spark):
    same = spark.createDataFrame([(4.0,), (4.0,)], "v double")
    assert [tuple(r) for r in charts.histogram(same, "v").collect()] == [(0, 4.0, 4.0, 2)]
    assert charts.histogram(same.where("v > 9"), "v").collect() == []


def test_quartiles_by_zooming(frame, values):
    assert charts.quartiles(frame, "v") == pytest.approx(tuple(np.percentile(values, [25, 75])))


def test_nan_is_missing(spark, values):
    df = spark.createDataFrame([(i, "a", float(v)) for i, v in enumerate(values[:300])], "id long, c string, v double")
    bad = df.unionByName(spark.createDataFrame([(900, "a", float("nan")), (901, "a", None)], "id long, c string, v double"))
    for make in (charts.histogram, charts.density, charts.density,
                 lambda d, v: charts.bootstrap_interval(d, "c", v, "id", 50)):
        a, b = (sorted(map(tuple, make(x, "v").collect())) for x in (bad, df))
        assert len(a) == len(b) and all(x[1:] == pytest.approx(y[1:]) for x, y in zip(a, b))
    assert charts.quartiles(bad, "v") == pytest.approx(tuple(np.percentile(values[:300], [25, 75])))


def test_quartiles_by_zooming_with_a_hot_value(spark):
    data = [1.0] * 500 + [2.0] * 3 + [1e9] + list(np.linspace(0.0, 0.5, 200))
    df = spark.createDataFrame([(float(v),) for v in data], "v double")
    assert charts.quartiles(df, "v") == pytest.approx(tuple(np.percentile(data, [25, 75])))


@pytest.mark.parametrize("seed", range(4))
def test_quartiles_between_sketched_values(spark, monkeypatch, seed):
    """More rows than the sketch tells apart: the bracket is narrow, and the answer is still exact."""
    monkeypatch.setattr(charts, "ACCURACY", 100)
    rng = np.random.default_rng(seed)
    n = 4001 + seed
    data = [rng.normal(size=n), np.round(rng.exponential(size=n), 1), rng.integers(0, 3, n).astype(float), np.sort(rng.random(n))][seed]
    df = spark.createDataFrame([(float(v),) for v in data] + [(None,), (float("nan"),)], "v double").repartition(6)
    assert charts.quartiles(df, "v") == pytest.approx(tuple(np.percentile(data, [25, 75])))
    s = charts.summarize(df.where("NOT isnan(v)"), "v")
    low1, high1, low2, high2 = s["near"]
    assert low1 <= np.percentile(data, 25) <= high1 and low2 <= np.percentile(data, 75) <= high2


def test_density_like_formula(frame, values):
    got = charts.density(frame, "v").orderBy("point").collect()
    h = values.std(ddof=1) * len(values) ** -0.2
    grid = np.linspace(values.min(), values.max(), 200)
    expected = np.exp(-(((values[:, None] - grid) / h) ** 2) / 2).sum(axis=0) / (len(values) * h * np.sqrt(2 * np.pi))
    assert np.allclose([r["density"] for r in got], expected, atol=1e-8)


def test_bootstrap_interval(frame, values):
    for r in charts.bootstrap_interval(frame, "c", "v", "id").collect():
        mine = values["abc".index(r["c"])::3]
        assert r["low"] < mine.mean() < r["high"]
        assert (r["high"] - r["low"]) == pytest.approx(3.92 * mine.std() / np.sqrt(len(mine)), rel=0.15)
    few_units = {r["c"]: r for r in charts.bootstrap_interval(frame, "c", "v", "id", units=500).collect()}
    assert len(few_units) == 3


def test_scatter_grid_counts_every_point(frame, values):
    grid = charts.scatter_grid(frame, "id", "v", 10).collect()
    assert sum(r["n"] for r in grid) == len(values)
    assert all(0 <= r["bin_x"] < 10 and 0 <= r["bin_y"] < 10 for r in grid)


def test_profile_counts_nulls_and_duplicates(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "x"), (None, "x"), (1, None)], "a int, b string")
    assert [tuple(r) for r in profile.null_counts(df).collect()] == [("a", 1), ("b", 3)]
    assert profile.duplicate_rows(df).first()[0] == 2
    assert [tuple(r) for r in profile.info(df).collect()] == [(0, "a", "int", 4), (1, "b", "string", 2)]
    assert tuple(profile.shape(df).first()) == (5, 2)
    assert [tuple(r) for r in profile.value_counts(df, "b").collect()] == [("x", 2)]
    assert profile.numeric_columns(df) == ["a"]


def test_sample_is_repeatable(frame):
    first = [tuple(r) for r in profile.sample_rows(frame, "id", 7, 1).collect()]
    again = [tuple(r) for r in profile.sample_rows(frame.repartition(13), "id", 7, 1).collect()]
    assert first == again and len(set(first)) == 7
    assert first != [tuple(r) for r in profile.sample_rows(frame, "id", 7, 2).collect()]


def test_bootstrap_by_value_covers_the_mean(spark):
    """Of many samples with a known mean, about 95 % of the intervals hold it; equal rows are drawn together."""
    rng = np.random.default_rng(9)
    values, shares = np.array([1.0, 2.0, 5.0, 20.0]), np.array([0.5, 0.25, 0.15, 0.1])
    rows = [(f"s{i}", float(v)) for i in range(300) for v in rng.choice(values, 80, p=shares)]
    found = charts.bootstrap_by_value(spark.createDataFrame(rows, "c string, v double").repartition(5), "c", "v", 400).collect()
    held = sum(r["low"] <= (values * shares).sum() <= r["high"] for r in found)
    assert len(found) == 300 and 0.89 <= held / 300 <= 0.99


def test_bootstrap_by_value_like_by_row(spark, frame):
    """The same answer, whatever the partitions, and nearly that of the draw by row; null categories and values are no problem."""
    a, b = (sorted(map(tuple, charts.bootstrap_by_value(frame.repartition(n), "c", "v", 500).collect())) for n in (1, 7))
    assert all(x[0] == y[0] and x[1:] == pytest.approx(y[1:]) for x, y in zip(a, b, strict=True))
    rows = {r["c"]: r for r in charts.bootstrap_interval(frame, "c", "v", "id", 500).collect()}
    for c, low, high in a:
        assert abs(low - rows[c]["low"]) < 0.35 * (high - low) and abs(high - rows[c]["high"]) < 0.35 * (high - low)
    odd = spark.createDataFrame([(None, 1.0), (None, 2.0), ("x", None), ("y", float("nan")), ("z", 4.0)], "c string, v double")
    got = {r["c"]: r for r in charts.bootstrap_by_value(odd, "c", "v", 50).collect()}
    assert set(got) == {None, "z"} and got["z"]["low"] == got["z"]["high"] == 4.0
