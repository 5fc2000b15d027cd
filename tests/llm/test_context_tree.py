"""Context-tree weighting against its definition: a prediction is the ratio of two weighted block probabilities."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from odd_rows import plain

from catalens.llm import context_tree
from catalens.llm.queries import QUERIES

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def steps(text, depth):
    data = b"\xff" * depth + text.translate(LOWER).encode() + b"\xff"
    for at in range(depth, len(data)):
        symbol = data[at]
        for i in range(8):
            yield data[at - depth : at][::-1], (1 << i) | (symbol >> (8 - i)), symbol >> (7 - i) & 1


def brute(rows, depth):
    counts, children = defaultdict(lambda: [0, 0]), defaultdict(set)
    learn = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2
    for doc_id, text in rows:
        if learn(doc_id):
            for context, prefix, bit in steps(text, depth):
                for d in range(depth + 1):
                    counts[context[:d], prefix][bit] += 1
                    if d:
                        children[context[: d - 1], prefix].add(context[:d])
    known = {}

    def weighted(context, prefix, path=None, bit=None):
        """Log probability of all decisions at this node, with one more along ``path`` if given."""
        on = path is not None and path[: len(context)] == context
        if not on and (context, prefix) in known:
            return known[context, prefix]
        a, b = counts[context, prefix] if (context, prefix) in counts else (0, 0)
        a, b = (a + (on and bit == 0), b + (on and bit == 1))
        kt = math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
        if len(context) < depth:
            below = set(children[context, prefix]) | ({path[: len(context) + 1]} if on else set())
            kt = np.logaddexp(kt, sum(weighted(c, prefix, path, bit) for c in below)) - math.log(2)
        if not on:
            known[context, prefix] = kt
        return kt

    train = [t for i, t in rows if learn(i)]
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t.translate(LOWER))
    c = Counter(w for t in train for w in [*words(t), None])
    n, v, memo, out = sum(c.values()), len(c), {}, []
    for doc_id, text in rows:
        own = 0.0
        for step in steps(text, depth):
            if step not in memo:
                context, prefix, bit = step
                memo[step] = weighted(b"", prefix, context, bit) - weighted(b"", prefix)
            own += memo[step]
        tokens = [*words(text), None]
        out.append((doc_id, not learn(doc_id), len(tokens), sum(c[w] > 0 for w in tokens), n,
                    sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens), own / math.log(10)))
    return out


def same(got, expected):
    key = lambda r: (r[0] is None, r[0] or 0, r[-1])
    got = sorted((tuple(r)[:7] for r in got), key=key)
    assert len(got) == len(expected)
    for a, b in zip(got, sorted(expected, key=key), strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-5)


def test_definition(spark, odd_docs, no_docs):
    for depth, block in ((2, 1 << 20), (3, 300)):
        same(context_tree.score(odd_docs, depth, block).collect(), brute(plain(odd_docs), depth))
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("length(text) < 700")
    same(context_tree.score(docs, 4, 5_000).collect(), brute(plain(docs), 4))
    assert context_tree.score(no_docs).collect() == []


def test_no_training_rows(spark):
    held_out = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    docs = spark.createDataFrame([(held_out, "ab")], "doc_id long, text string")
    row = context_tree.score(docs).first()
    assert row["score"] == pytest.approx(-24 * math.log10(2), rel=1e-6) and row["base_score"] == 0 and row["train_tokens"] == 0


def test_log_kt():
    n = np.array([0, 1, 2, 9, 11, 1000, 10**9])
    expected = [math.lgamma(a + 0.5) + math.lgamma(3.5) - math.lgamma(a + 4.0) - math.log(math.pi) for a in n]
    assert np.allclose(context_tree.log_kt(n, np.full(len(n), 3)), expected, rtol=1e-12)


def test_held_out_texts(spark):
    rows = QUERIES["op3_context_tree"](spark, "/root/testdata/sf0.1").filter("held_out").collect()
    assert len(rows) > 1000
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)
    assert 1 < sum(-r["score"] for r in rows) * math.log2(10) / sum(r["n_bytes"] for r in rows) < 2.2
