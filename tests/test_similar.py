"""Vectors and cosine neighbours against brute force."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from catalens.operators import joins, similar, vectors

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa the of".split()


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(3)
    texts = [" ".join(rng.choices(WORDS, k=rng.randint(1, 9))) for _ in range(60)]
    texts += ["alpha beta beta"] * 30  # one text in a third of the rows
    texts += ["the of", "", "alpha beta beta alpha beta beta", "a b c"]
    return [(i // 2, i, t) for i, t in enumerate(texts)]


def frame(spark, docs, parts=3):
    return spark.createDataFrame(docs, "a long, b long, text string").repartition(parts)


def brute_vectors(docs, n_terms, stop=("the", "of")):
    counts = {(a, b): Counter(w for w in t.split() if len(w) > 1 and w not in stop) for a, b, t in docs}
    total = sum(counts.values(), Counter())
    vocab = set(sorted(total, key=lambda w: (-total[w], w))[:n_terms])
    kept = {k: {w: n for w, n in c.items() if w in vocab} for k, c in counts.items()}
    return {k: c for k, c in kept.items() if c}


def brute_top(vecs, key, k):
    out = []
    for other, c in vecs.items():
        dot = sum(n * c.get(w, 0) for w, n in vecs[key].items())
        if other != key and dot:
            n2 = [sum(n * n for n in v.values()) for v in (vecs[key], c)]
            out.append((-dot / math.sqrt(float(n2[0] * n2[1])), other))
    return [(other, -score) for score, other in sorted(out)[:k]]


@pytest.mark.parametrize("block_rows,parts", [(None, 1), (7, 5), (3, 2)])
def test_all_pairs_equal_brute_force(spark, docs, block_rows, parts):
    vecs = brute_vectors(docs, 8)
    made = vectors.document_vectors(frame(spark, docs, parts), ["a", "b"], "text", ["the", "of"], 8)
    assert made.count() == len(vecs)
    got = {}
    for r in similar.similar_all(made, ["a", "b"], 5, block_rows).orderBy("a", "b", "rank").collect():
        got.setdefault((r["a"], r["b"]), []).append(((r["near_a"], r["near_b"]), r["score"]))
    assert got == {key: top for key in vecs if (top := brute_top(vecs, key, 5))}
    assert all(0 < s <= 1 for top in got.values() for _, s in top)


def test_no_documents(spark, docs):
    made = vectors.document_vectors(frame(spark, docs), ["a", "b"], "text", ["the", "of"], 8).limit(0)
    assert similar.similar_all(made, ["a", "b"]).collect() == []
    seeds = spark.createDataFrame([("x", 0, 0)], "name string, a long, b long")
    assert similar.similar_to(made, ["a", "b"], seeds, "name").collect() == []


def test_few_seeds_equal_brute_force(spark, docs):
    vecs = brute_vectors(docs, 8)
    made = vectors.document_vectors(frame(spark, docs), ["a", "b"], "text", ["the", "of"], 8)
    keys = sorted(vecs)[::9]
    seeds = spark.createDataFrame([(f"s{a}-{b}", a, b) for a, b in keys], "name string, a long, b long")
    got = {}
    for r in similar.similar_to(made, ["a", "b"], seeds, "name", 4).orderBy("name", "rank").collect():
        got.setdefault(r["name"], []).append(((r["a"], r["b"]), r["score"]))
    assert got == {f"s{a}-{b}": brute_top(vecs, (a, b), 4) for a, b in keys}


def test_every_document_as_seed(spark, docs, monkeypatch):
    """Seeds in several blocks give what each gets alone."""
    vecs = brute_vectors(docs, 8)
    made = vectors.document_vectors(frame(spark, docs), ["a", "b"], "text", ["the", "of"], 8)
    seeds = made.select(F.concat_ws("-", "a", "b").alias("name"), "a", "b")
    expected = {f"{a}-{b}": top for a, b in vecs if (top := brute_top(vecs, (a, b), 5))}
    for block in (1000, 7):
        monkeypatch.setattr(similar, "SEED_BLOCK", block)
        monkeypatch.setattr(similar, "MAX_BLOCK_ROWS", 20)
        got = {}
        for r in similar.similar_to(made, ["a", "b"], seeds, "name").orderBy("name", "rank").collect():
            got.setdefault(r["name"], []).append(((r["a"], r["b"]), r["score"]))
        assert got == expected


def test_many_classes_are_joined_by_salt(spark, docs, monkeypatch):
    made = vectors.document_vectors(frame(spark, docs), ["a", "b"], "text", ["the", "of"], 8)
    expected = sorted(map(tuple, similar.similar_all(made, ["a", "b"], 5).collect()))
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, similar.similar_all(made, ["a", "b"], 5).collect())) == expected


def test_vocabulary_ties_are_alphabetical(spark):
    counts = vectors.term_counts(spark.createDataFrame([(1, "bb aa cc cc")], "k long, text string"), ["k"], "text", [])
    assert [tuple(r) for r in vectors.vocabulary(counts, 2).collect()] == [("cc", 2), ("aa", 1)]
    assert sorted(map(tuple, vectors.numbered_vocabulary(counts, 2).collect())) == [("aa", 1, 1), ("cc", 2, 0)]


def test_tokens_are_two_word_characters_or_more(spark):
    df = spark.createDataFrame([("A big_one, é été x9 don't",)], "t string")
    assert df.select(vectors.tokens(F.col("t"))).first()[0] == ["big_one", "été", "x9", "don"]
