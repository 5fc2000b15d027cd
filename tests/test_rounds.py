"""Copies of rows and shuffle files do not pile up on the disk."""

import random
import time

import pytest
from pyspark.sql import functions as F

from catalens.operators import blocks, similar
from catalens.session import CLEAN_UP, materialize


def shuffle_files(spark):
    files = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
    return {f.getName() for f in [files.apply(i) for i in range(files.size())] if f.getName().startswith("shuffle_")}


def test_stored_tables_leave_no_shuffle_files(spark):
    before, setting = shuffle_files(spark), spark.conf.get(CLEAN_UP, None)
    stored = materialize(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.sum("id").alias("s")).repartition(3, "k"), "t")
    assert spark.conf.get(CLEAN_UP, None) in (setting, "false")
    for _ in range(50):  # files go in the background
        left = shuffle_files(spark) - before
        if not left:
            break
        time.sleep(0.1)
    assert not left and stored.count() == 7


@pytest.fixture
def vectors(spark):
    rng, rows = random.Random(4), []
    for i in range(120):
        terms = sorted(rng.sample(range(30), 6))
        weights = [rng.randint(1, 3) for _ in terms]
        rows.append((i, terms, weights, sum(w * w for w in weights)))
    return spark.createDataFrame(rows, "id long, terms array<int>, weights array<long>, norm2 long")


def best(vectors, k):
    rows = [(r["id"], dict(zip(r["terms"], r["weights"])), r["norm2"]) for r in vectors.collect()]
    out = {}
    for i, a, n in rows:
        found = [(-sum(w * b.get(t, 0) for t, w in a.items()) / (n * m) ** 0.5, j) for j, b, m in rows if j != i]
        out[i] = [(j, round(-s, 9)) for s, j in sorted(found) if s < 0][:k]
    return out


def spied(monkeypatch):
    seen, kept = [], blocks.meet
    monkeypatch.setattr(blocks, "meet", lambda left, right, *more: seen.append((left, right)) or kept(left, right, *more))
    return seen


def near(rows, own, other):
    out = {}
    for r in sorted(rows.collect(), key=lambda r: (r[own], r["rank"])):
        out.setdefault(r[own], []).append((r[other], round(r["score"], 9)))
    return out


def test_all_pairs_in_rounds(spark, vectors, monkeypatch):
    seen = spied(monkeypatch)
    got = near(similar.similar_all(vectors, ["id"], 3, block_rows=10), "id", "near_id")
    assert got == best(vectors, 3)
    assert len(seen) >= 3 and all(left.select("target").distinct().count() <= blocks.ROUND_BLOCKS for left, _ in seen)


def test_many_seeds_in_rounds(spark, vectors, monkeypatch):
    monkeypatch.setattr(similar, "SEED_BLOCK", 10)
    monkeypatch.setattr(similar, "MAX_BLOCK_ROWS", 20)
    seen = spied(monkeypatch)
    seeds = vectors.select(F.concat(F.lit("t"), "id").alias("label"), "id")
    found = similar.similar_to(vectors, ["id"], seeds, "label", 3)
    expected = {f"t{i}": rows for i, rows in best(vectors, 3).items()}
    assert near(found, "label", "id") == expected and len(seen) == 2
    nothing = similar.similar_all(vectors.limit(0), ["id"], 3)
    assert nothing.count() == 0
