import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from odd_rows import plain

from catalens.llm import simhash


def brute_fingerprint(text, n_words=3):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + n_words]) for i in range(max(1, len(words) - n_words + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(fps, differ):
    """Root of every distinct fingerprint."""
    nodes = sorted(set(fps))
    top = {n: n for n in nodes}

    def root(n):
        while top[n] != n:
            n = top[n]
        return n

    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if (a ^ b).bit_count() <= differ:
                top[root(a)] = root(b)
    return {n: root(n) for n in nodes}


def brute(rows, differ=3, n_words=3):
    fps = [brute_fingerprint(t, n_words) for _, t in rows]
    root = brute_groups(fps, differ)
    least = {}
    for (doc_id, _), fp in zip(rows, fps):
        ids = [i for i in (least.get(root[fp]), doc_id) if i is not None]
        least[root[fp]] = min(ids) if ids else None
    return Counter((doc_id, f"{fp:016x}", least[root[fp]]) for (doc_id, _), fp in zip(rows, fps))


def near_texts(n, seed=5):
    rng = random.Random(seed)
    base = [[rng.choice("abcdefghijklmnop") * rng.randint(1, 4) for _ in range(rng.randint(4, 300))] for _ in range(12)]
    out = []
    for _ in range(n):
        words = list(rng.choice(base))
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = rng.choice(["Ä", "Zed", "qq"])
        out.append(rng.choice([" ", "\t", "\n\n"]).join(words))
    return out


def test_code_covers_everything():
    fps = np.random.default_rng(1).integers(0, 2**63, 500, dtype=np.uint64)
    row, anchor, near = simhash.anchors(fps, 0)
    assert sorted(row.tolist()) == list(range(500)) and near.all()
    for differ, copies in ((3, (55, 68)), (1, (5, 12))):
        row, anchor, near = simhash.anchors(fps, differ)
        assert len(set(zip(row.tolist(), anchor.tolist()))) == len(row)
        assert copies[0] < len(row) / len(fps) < copies[1]


@pytest.mark.parametrize("differ", [0, 1, 2, 3, 4])
def test_pairs_meet(differ):
    rng = np.random.default_rng(differ)
    one = rng.integers(0, 2**64, 400, dtype=np.uint64)
    two = one.copy()
    for i in range(len(one)):
        for bit in rng.choice(64, rng.integers(0, differ + 1), replace=False):
            two[i] ^= np.uint64(1 << int(bit))
    spots = []
    for fps in (one, two):
        row, anchor, near = simhash.anchors(fps, differ)
        spots.append([{} for _ in fps])
        for r, a, n in zip(row.tolist(), anchor.tolist(), near.tolist()):
            spots[-1][r][a] = n
    for a, b in zip(*spots):
        assert any(a[x] or b[x] for x in a.keys() & b.keys())


def test_odd_rows(odd_docs, no_docs):
    for differ, n_words in ((3, 3), (0, 1)):
        got = simhash.simhash_groups(odd_docs, n_words, differ)
        assert Counter(map(tuple, got.collect())) == brute(plain(odd_docs), differ, n_words)
    assert simhash.simhash_groups(no_docs).collect() == []


def test_near_copies(spark):
    rows = list(enumerate(near_texts(500) + ["same again"] * 200 + [None, ""]))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = brute([(i, t or "") for i, t in rows])
    assert Counter(map(tuple, simhash.simhash_groups(docs).collect())) == want
    assert len({c for _, _, c in want}) < 480  # some of them are linked


def test_crowded_anchor(spark):
    """Thousands of different fingerprints around one value share anchors, which are cut into parts."""
    rng = np.random.default_rng(3)
    centre = int(rng.integers(0, 2**63))
    fps = {centre ^ sum(1 << int(b) for b in rng.choice(60, rng.integers(0, 5), replace=False)) for _ in range(800)}
    fps |= {int(x) for x in rng.integers(0, 2**63, 300)}
    table = spark.createDataFrame([(f,) for f in fps], "fp long").repartition(4)
    for differ in (2, 3):
        edges = [(r["a"], r["b"]) for r in simhash.links(table, len(fps), differ, part=16).collect()]
        assert all((a ^ b).bit_count() <= 64 and a in fps and b in fps for a, b in edges)
        root = brute_groups(fps, differ)
        top = {f: f for f in fps}

        def find(n):
            while top[n] != n:
                n = top[n]
            return n

        for a, b in edges:
            assert root[a] == root[b]
            top[find(a)] = find(b)
        assert len({find(f) for f in fps}) == len(set(root.values()))


def test_batches_cut_groups():
    """A group that several batches share is compared across them."""
    import pyarrow as pa

    rng = np.random.default_rng(4)
    fps = np.array([int(x) for x in rng.integers(0, 16, 60)] + [1 << 40, 3 << 40], np.int64)
    near = np.array([i < 20 for i in range(60)] + [True, False])
    key = np.array([1] * 60 + [2, 2], np.int32)
    rows = [(key, np.zeros(62, np.int32), near, fps)]
    whole = [pa.RecordBatch.from_arrays([pa.array(c) for c in rows[0]], ["anchor", "part", "near", "fp"])]
    cut = [whole[0].slice(at, 7) for at in range(0, 62, 7)]
    answers = []
    for batches in (whole, cut):
        pairs = [p for b in simhash._compare(iter(batches), 1) for p in zip(*(c.to_pylist() for c in b.columns))]
        nodes = {n for p in pairs for n in p}
        answers.append(len(nodes) - len(set(pairs)))
        assert (1 << 40, 3 << 40) in pairs or (3 << 40, 1 << 40) in pairs
    assert answers[0] == answers[1]
