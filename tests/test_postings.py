"""The inverted index against all products, and the stored bands against the exact answer."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from catalens.operators import lsh, similar
from catalens.operators.postings import Postings, best_of_block
from catalens.queries import QUERIES, _catalogue

SF = "/root/testdata/sf0.001"


def sparse(n, n_terms, seed, skew=1.3):
    """Vectors whose terms are as uneven as words are, and some equal ones."""
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(n):
        terms = np.unique(np.minimum(rng.zipf(skew, rng.integers(3, 60)) - 1, n_terms - 1))
        rows.append((terms, rng.integers(1, 6, len(terms))))
    rows += rows[: n // 10]
    return pd.DataFrame({
        "no": np.arange(len(rows)), "terms": [t for t, _ in rows], "weights": [w for _, w in rows],
        "norm2": [int((w * w).sum()) for _, w in rows]})


def brute(left, right, keep):
    out = set()
    for a in left.itertuples():
        w = dict(zip(a.terms.tolist(), a.weights.tolist()))
        scored = []
        for b in right.itertuples():
            dot = sum(w.get(t, 0) * v for t, v in zip(b.terms.tolist(), b.weights.tolist()))
            if dot:
                scored.append((-(dot / np.sqrt(float(a.norm2 * b.norm2))), b.no))
        out |= {(a.no, no, -s) for s, no in sorted(scored)[:keep]}
    return out


@pytest.mark.parametrize("keep", [1, 6, 1000])
def test_best_of_block(keep):
    left, right = sparse(40, 300, 1), sparse(150, 300, 2)
    want = brute(left, right, keep)
    assert set(best_of_block(left, right.sample(frac=1, random_state=1), keep).itertuples(index=False, name=None)) == want
    # With a bar, the rows at or above it are the same.
    bars = {no: max((s for a, _, s in want if a == no), default=0.0) * 0.8 for no in left["no"]}
    found = best_of_block(left.assign(reach=left["no"].map(bars)), right, keep)
    assert set(found.itertuples(index=False, name=None)) == {x for x in want if x[2] >= bars[x[0]]}


def test_bounds_spare_products():
    """Where rows have close neighbours, most postings, and most pairs, are never multiplied."""
    rng = np.random.default_rng(3)
    made = []
    for topic in sparse(100, 4000, 3, skew=1.15).itertuples():
        for _ in range(15):
            kept = rng.random(len(topic.terms)) < 0.95
            terms = np.union1d(topic.terms[kept], rng.integers(0, 4000, 2))
            weights = dict(zip(topic.terms.tolist(), topic.weights.tolist()))
            made.append((terms, np.array([weights.get(t, 1) for t in terms.tolist()])))
    rows = pd.DataFrame({"terms": [t for t, _ in made], "weights": [w for _, w in made], "norm2": [int((w * w).sum()) for _, w in made]})
    index = Postings(rows)
    all_postings = sum(int(index.size[np.searchsorted(index.terms, t)].sum()) for t in rows["terms"])
    for row in rows.itertuples():
        index.best(row.terms, row.weights, row.norm2, 6)
    assert index.products < 0.6 * all_postings
    assert index.products < 0.001 * len(rows) ** 2 * 4000


def test_no_rows():
    none = sparse(3, 10, 1).iloc[:0]
    assert len(best_of_block(none, sparse(3, 10, 1), 2)) == len(best_of_block(sparse(3, 10, 1), none, 2)) == 0


def table(spark, frame):
    rows = [(int(r.no), r.terms.tolist(), r.weights.tolist(), r.norm2) for r in frame.itertuples()]
    return spark.createDataFrame(rows, "no long, terms array<int>, weights array<long>, norm2 long")


def test_hot_buckets_are_split(spark):
    """Most rows are led by one term; no bucket has much more than its size, and no row is left out of a band but where alone."""
    frame = sparse(600, 200, 5)
    frame["terms"] = [np.append(t, 999) if i % 3 else t for i, t in enumerate(frame["terms"])]
    frame["weights"] = [np.append(w, 60) if i % 3 else w for i, w in enumerate(frame["weights"])]
    frame["norm2"] = [int((w * w).sum()) for w in frame["weights"]]
    rows = table(spark, frame).repartition(4)
    drawn = lsh.draws(rows, "no", 1000, bands=8)
    assert sorted(map(tuple, drawn.collect())) == sorted(map(tuple, lsh.draws(rows.repartition(2), "no", 1000, bands=8).collect()))
    index = lsh.bands_table(drawn, "no", bands=8, bucket_rows=20)
    sizes = [r["count"] for r in index.groupBy("bucket").count().collect()]
    assert max(sizes) <= 50 and sum(sizes) > 0.8 * 8 * len(frame)
    assert index.groupBy("no").count().agg(F.max("count")).first()[0] <= 8
    alone = lsh.bands_table(lsh.draws(rows.limit(1), "no", 1000, bands=8), "no", bands=8)
    assert alone.collect() == []


def test_recall_against_the_exact_answer(spark):
    vectors = _catalogue(spark, SF.replace("0.001", "0.01"), "content").content
    exact = similar.similar_all(vectors, ["id", "movie_id"])
    some = lsh.similar_lsh(vectors, ["id", "movie_id"])
    n_exact, n_found = lsh.recall(some, exact, ["id", "movie_id"]).first()
    assert n_found >= 0.9 * n_exact
    # What is found has its exact score.
    pair = ["id", "movie_id", "near_id", "near_movie_id"]
    both = exact.select(*pair, "score").join(some.select(*pair, F.col("score").alias("other")), pair)
    assert both.where("abs(score - other) > 1e-12").count() == 0 and both.count() > 0.8 * n_exact


def test_empty_catalogue(spark):
    vectors = _catalogue(spark, SF, "content").content.limit(0)
    assert lsh.similar_lsh(vectors, ["id", "movie_id"]).collect() == []


def test_query(spark):
    rows = QUERIES["q_similar_lsh"](spark, SF).collect()
    assert {r["facet"] for r in rows} == {"content"} and all(1 <= r["rank"] <= 5 and 0 < r["score"] <= 1 for r in rows)
