"""The most frequent terms by sketch and exact counts, against a plain count of all terms."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from catalens.operators import vectors


def zipf(rng, n_docs, n_terms, power):
    weights = [(i + 1) ** -power for i in range(n_terms)]
    return [" ".join(f"w{i:05d}" for i in rng.choices(range(n_terms), weights, k=120)) for _ in range(n_docs)]


def best(texts, n_terms, stop=()):
    counts = Counter(w for t in texts for w in (t or "").split() if w not in stop)
    return sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:n_terms]


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(6)


@pytest.mark.parametrize("tracked", [40, 300, 65536])
@pytest.mark.parametrize("power", [0.0, 1.1])
def test_equal_to_a_full_count(spark, tracked, power):
    """Also where counts are flat, so that a small sketch proves nothing and must grow."""
    texts = zipf(random.Random(5), 250, 4000, power) + [None, "", "  "]
    got = vectors.frequent_terms(frame(spark, texts), "text", ["w00001"], 30, tracked).collect()
    assert [tuple(r) for r in got] == best(texts, 30, {"w00001"})


def test_largest_sketch_is_not_enough(spark, monkeypatch):
    """Then all terms are counted."""
    monkeypatch.setattr(vectors, "MAX_TRACKED", 100)
    texts = zipf(random.Random(6), 60, 3000, 0.0)
    got = vectors.frequent_terms(frame(spark, texts), "text", ["x"], 20, 50).collect()
    assert [tuple(r) for r in got] == best(texts, 20)


def test_ties_few_terms_and_empty_table(spark):
    texts = ["bb aa cc", "cc bb aa", None]
    got = vectors.frequent_terms(frame(spark, texts), "text", ["x"], 2).collect()
    assert [tuple(r) for r in got] == [("aa", 2), ("bb", 2)]
    assert len(vectors.frequent_terms(frame(spark, texts), "text", ["x"], 50).collect()) == 3
    assert vectors.frequent_terms(frame(spark, texts).limit(0), "text", ["x"], 50).collect() == []


def test_no_hash_beyond_the_bound(spark):
    """A term that the sketch does not name comes at most ``bound`` times."""
    texts = zipf(random.Random(7), 400, 6000, 0.7)
    words = vectors._words(frame(spark, texts), [], "text", ["x"])
    row = vectors._followed(words, 200).first()
    named = set(row["hashes"])
    rest = [r["n"] for r in words.groupBy("term", F.xxhash64("term").alias("h")).agg(F.count("*").alias("n")).collect() if r["h"] not in named]
    assert row["n_words"] == 400 * 120 and len(named) <= 200 and rest and max(rest) <= row["bound"]


def test_rare_terms_are_not_shuffled(spark, monkeypatch):
    """Of 20,000 terms only those with a named hash come to the count."""
    stored = {}
    keep = vectors.materialize
    monkeypatch.setattr(vectors, "materialize", lambda df, label: stored.setdefault(label, keep(df, label)))
    texts = zipf(random.Random(8), 400, 20_000, 1.3)
    got = vectors.frequent_terms(frame(spark, texts), "text", ["x"], 10, 500).collect()
    assert [tuple(r) for r in got] == best(texts, 10) and stored["frequent-terms"].count() <= 500


def test_counts_per_document(spark):
    texts = zipf(random.Random(9), 50, 500, 1.0)
    docs = frame(spark, texts)
    key = lambda rows: sorted(tuple(r[c] for c in ("id", "term", "tf", "n", "term_no")) for r in rows)
    plain = vectors.vocabulary_counts(docs, ["id"], "text", ["x"], 40).collect()
    assert key(vectors.frequent_counts(docs, ["id"], "text", ["x"], 40, 64).collect()) == key(plain)
