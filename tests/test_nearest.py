import random

import pytest

from catalens.operators import nearest
from catalens.operators.nearest import nearest_mean

NUMERIC, CATEGORICAL = ["x", "y"], ["c", "d"]


def rows(n, seed, copies=0):
    rng = random.Random(seed)
    out = [
        (i, float(rng.randint(0, 40)), rng.choice([0.0, 128.0, 256.0]), rng.choice("abc"), rng.choice("pq"), rng.random())
        for i in range(n)
    ]
    return out + [(n + i, 7.0, 128.0, "b", "q", float(i)) for i in range(copies)]


def brute(train, test, k):
    first = {c: min(r[3 + j] for r in train) for j, c in enumerate(CATEGORICAL)}

    def distance(a, b):
        d = (a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2
        for j, c in enumerate(CATEGORICAL):
            u, v = a[3 + j], b[3 + j]
            d += 0 if u == v else 1 if first[c] in (u, v) else 2
        return d

    out = {}
    for t in test:
        best = sorted(train, key=lambda r: (distance(t, r), r[0]))[:k]
        out[t[0]] = sum(r[5] for r in best) / len(best)
    return out


@pytest.mark.parametrize("block_rows", [2048, 16])
def test_equals_brute_force(spark, block_rows):
    schema = "id long, x double, y double, c string, d string, label double"
    train, test = rows(300, 1, copies=150), rows(80, 2, copies=20)
    got = nearest_mean(
        spark.createDataFrame(train, schema).repartition(5), spark.createDataFrame(test, schema), "id", NUMERIC,
        CATEGORICAL, "label", 3, block_rows,
    )
    answer = {r["id"]: r["prediction"] for r in got.collect()}
    expected = brute(train, test, 3)
    assert answer.keys() == expected.keys()
    assert all(abs(answer[i] - expected[i]) < 1e-12 for i in expected)


def test_fewer_training_rows_than_k(spark):
    schema = "id long, x double, y double, c string, d string, label double"
    train, test = rows(2, 3), rows(4, 4)
    got = nearest_mean(
        spark.createDataFrame(train, schema), spark.createDataFrame(test, schema), "id", NUMERIC, CATEGORICAL, "label", 3
    )
    mean = (train[0][5] + train[1][5]) / 2
    assert [round(r["prediction"], 12) for r in got.collect()] == [round(mean, 12)] * 4


def test_boxes_grow_with_the_rows(spark, monkeypatch):
    """Few cells at the top: their own trees cut on, the boxes are of bounded size, and answers stay exact."""
    monkeypatch.setattr(nearest, "MAX_CELLS", 4)
    monkeypatch.setattr(nearest, "SAMPLE_ROWS", 200)
    schema = "id long, x double, y double, c string, d string, label double"
    rng = random.Random(8)
    train = [(i, rng.gauss(0, 50), rng.gauss(0, 50), rng.choice("abc"), rng.choice("pq"), rng.random()) for i in range(1500)]
    test = [(i, rng.gauss(0, 60), rng.gauss(0, 60), rng.choice("abcd"), rng.choice("pq"), 0.0) for i in range(60)]
    made = {}
    kept = nearest._boxed
    monkeypatch.setattr(nearest, "_boxed", lambda *a: made.setdefault(len(made), kept(*a)))
    sides = spark.createDataFrame(train, schema).repartition(3), spark.createDataFrame(test, schema)
    got = {r["id"]: r["prediction"] for r in nearest_mean(*sides, "id", NUMERIC, CATEGORICAL, "label", 3, 20).collect()}
    expected = brute(train, test, 3)
    assert got.keys() == expected.keys() and all(abs(got[i] - expected[i]) < 1e-12 for i in expected)
    sizes = [r["count"] for r in made[0].groupBy("cell", "box").count().collect()]
    assert len(sizes) > 60 and max(sizes) < 80


def test_rows_with_nulls_take_no_part(spark):
    schema = "id long, x double, y double, c string, d string, label double"
    train = [*rows(50, 1), (100, None, 1.0, "a", "p", 9.0)]
    test = [*rows(5, 2), (9, 1.0, None, "a", "p", 0.0)]
    got = nearest_mean(spark.createDataFrame(train, schema), spark.createDataFrame(test, schema), "id", NUMERIC, CATEGORICAL, "label")
    expected = brute(train[:-1], test[:-1], 3)
    assert {r["id"]: round(r["prediction"], 12) for r in got.collect()} == {i: round(p, 12) for i, p in expected.items()}
    assert got.columns == ["id", "x", "y", "c", "d", "label", "prediction"]
