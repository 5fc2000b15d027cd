import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from catalens.llm import hard_negatives as hn

SCHEMA = "vec_id long, label int, embedding array<double>, score string, anchor_id long"


def table(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA).repartition(3)


def brute(rows, is_anchor, positives=5, negatives=10, low=30, high=90):
    best = {}
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        row = (label, [min(max(math.floor(256 * x), -(1 << 63)), (1 << 63) - 1) for x in v])
        best[i] = min(best.get(i, row), row)

    def score(a, b):
        return min(max(sum(x * y for x, y in zip(a, b)), -(1 << 63)), (1 << 63) - 1)

    out = Counter()
    for a, (label, v) in best.items():
        if not is_anchor(a):
            continue
        ranked = sorted((-score(v, w), i, other) for i, (other, w) in best.items() if i != a)
        for s, p, _ in [r for r in ranked if r[2] == label][:positives]:
            fit = [r for r in ranked if r[2] != label and low * -s <= 100 * -r[0] <= high * -s][:negatives]
            for rank, (t, n, _) in enumerate(fit, 1):
                out[a, p, rank, n, -s, -t] += 1
    return out


def vectors(n, dims, labels, seed, spread=1.0):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(5, dims))
    v = centre[rng.integers(0, 5, n)] + spread * rng.normal(size=(n, dims))
    v *= rng.uniform(0.1, 3, (n, 1))
    return [(i, int(rng.integers(0, labels)), x.tolist()) for i, x in enumerate(v)]


@pytest.mark.parametrize("dims, spread", [(3, 0.3), (16, 0.2), (16, 2.0)])
def test_brute(spark, dims, spread):
    rows = vectors(700, dims, 4, dims, spread)
    rows += [(1000 + i, i % 3, rows[i % 20][2]) for i in range(60)]  # equal vectors: ties
    rows += [(2000, 0, [0.0] * dims), (2007, 1, [0.0] * dims), (2010, 9, [1.0] * dims)]
    got = hn.hard_negatives(table(spark, rows), F.col("vec_id") % 10 == 0, bucket_rows=64, block_anchors=30)
    assert Counter(map(tuple, got.collect())) == brute(rows, lambda i: i % 10 == 0)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, [1.0, 2.0]), (None, 1, [1.0, 2.0]), (1, None, [1.0, 2.0]), (2, 1, None), (3, 1, [1.0, None]), (4, 1, [nan, 1.0]),
            (5, 2, [inf, 1.0]), (6, 1, [1.0]), (7, 2, [0.5, 0.5, 9.0]), (8, 2, []), (9, 2, [0.3, 0.3]), (9, 2, [0.3, 0.3]), (9, 3, [9.0, 9.0]),
            (10, 1, [1e300, -1e300]), (20, 2, [1e300, 1e299]), (30, 1, [-1.0, -1.0]), (40, 1, [1e14, 3.0]), (50, 3, [4e13, 1e13])]
    for bucket in (1, 3, 100):
        got = hn.hard_negatives(table(spark, rows), F.col("vec_id") % 10 == 0, bucket_rows=bucket)
        assert Counter(map(tuple, got.collect())) == brute(rows, lambda i: i % 10 == 0)
    assert hn.hard_negatives(table(spark, rows).limit(0), F.lit(True)).collect() == []
    assert hn.hard_negatives(table(spark, rows), F.lit(False)).collect() == []


def test_ranges_hold_all_and_prune():
    """Every row with the wanted cosine is feasible, and with clustered vectors most others are not."""
    rng = np.random.default_rng(2)
    centre = rng.normal(size=(8, 24))
    v = (1000 * (centre[rng.integers(0, 8, 2000)] + 0.05 * rng.normal(size=(2000, 24)))).astype(np.int64)
    bucket = hn.Bucket(np.arange(2000), np.zeros(2000, np.int64), v)
    seen = 0
    for a in range(0, 2000, 100):
        unit = bucket.unit[a]
        for least in (0.3, 0.9, 0.99):
            rows = bucket.feasible(unit, least, 3)
            assert set(np.flatnonzero(bucket.unit @ unit >= least)) <= set(rows.tolist())
            seen += len(rows) if least == 0.9 else 0
    assert seen < 20 * 2000 / 3


def test_short_vectors_end_the_search():
    anchor = hn.Anchor(0, 1, np.array([10, 0], np.int64), [(7, 500, 10_000)], 2, False)
    ids = np.arange(1, 4)
    assert anchor.meet(hn.Bucket(ids, np.zeros(3, np.int64), np.array([[90, 1], [60, 5], [51, 0]])), 2)
    assert anchor.need == [600] and anchor.found[0][0].tolist() == [1, 2]
    assert not anchor.meet(hn.Bucket(ids, np.zeros(3, np.int64), np.array([[59, 0], [5, 0], [1, 0]])), 2)
