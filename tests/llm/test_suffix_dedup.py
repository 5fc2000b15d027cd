"""Removed passages against a dictionary of all 50-byte strings; the merged transforms against sorted suffixes."""

import hashlib
import random
from collections import Counter

import numpy as np
from odd_rows import plain

from catalens.llm import suffix_dedup
from catalens.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def brute(rows, length=50):
    least = {}
    for doc_id, text in rows:
        data, own = text.encode(), suffix_dedup.LAST if doc_id is None else doc_id
        for i in range(len(data) - length + 1):
            w = data[i : i + length]
            least[w] = min(own, least.get(w, own))
    out = Counter()
    for doc_id, text in rows:
        data, own = text.encode(), suffix_dedup.LAST if doc_id is None else doc_id
        gone = np.zeros(len(data) + 1, bool)
        for i in range(len(data) - length + 1):
            if least[data[i : i + length]] < own:
                gone[i : i + length] = True
        kept = bytes(b for b, g in zip(data, gone, strict=False) if not g)
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum())
        out[doc_id, len(data), len(data) - len(kept), spans, hashlib.sha256(kept).hexdigest()] += 1
    return out


def test_whole_table(spark):
    rows = plain(spark.read.parquet(f"{SF}/documents.parquet"))
    assert Counter(map(tuple, QUERIES["op1_suffix_dedup"](spark, SF).collect())) == brute(rows)


def test_odd_rows(spark, odd_docs, no_docs):
    for sizes in ({}, {"block_bytes": 500, "bucket_bytes": 100, "shard_bytes": 300}):
        got = suffix_dedup.remove_repeats(odd_docs, **sizes)
        assert Counter(map(tuple, got.collect())) == brute(plain(odd_docs))
    assert suffix_dedup.remove_repeats(no_docs).collect() == []


def made_texts(rng, n):
    passages = ["".join(rng.choices("abé \x00😀", k=rng.randrange(20, 200))) for _ in range(12)]
    texts = []
    for _ in range(n):
        parts = ["".join(rng.choices("abcdefgh ", k=rng.randrange(0, 120))) for _ in range(3)]
        cut = rng.choice(passages)
        parts[1:1] = [cut[rng.randrange(10):][: rng.randrange(30, 200)] * rng.randrange(0, 3)]
        texts.append("".join(parts))
    return texts + texts[: n // 5] + ["aaaa" * 60, "a" * 120, "abab" * 80, "ab" * 33]


def test_passages_in_many_texts(spark):
    rng = random.Random(11)
    for length, gram in ((50, 20), (20, 9)):
        texts = made_texts(rng, 150)
        ids = list(range(len(texts)))
        rng.shuffle(ids)
        docs = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").repartition(4)
        for sizes in ({"block_bytes": 2_000, "bucket_bytes": 3_000, "shard_bytes": 700}, {}):
            got = suffix_dedup.remove_repeats(docs, length, gram, whole=True, **sizes).collect()
            assert Counter(tuple(r)[:5] for r in got) == brute(plain(docs), length)
            by_id = dict(plain(docs))
            for r in got:
                data, cuts = by_id[r["doc_id"]].encode(), r["spans"]
                assert bytes(r["kept_text"]) == b"".join(data[a:b] for a, b in zip([0, *cuts[1::2]], [*cuts[::2], len(data)], strict=True))


def test_merged_intervals():
    rng = random.Random(3)
    for _ in range(60):
        length = rng.randrange(3, 30)
        strings = list({bytes(rng.choices(b"ab\x00", k=rng.randrange(length, 2 * length))) for _ in range(rng.randrange(1, 40))})
        least = np.array([rng.randrange(50) for _ in strings], np.int64)
        expected = {}
        for s, own in zip(strings, least.tolist(), strict=True):
            for i in range(len(s) - length + 1):
                w = s[i : i + length]
                expected[w] = min(own, expected.get(w, own))
        got = suffix_dedup.repeats(strings, least, length, rng.choice([40, 10_000]))
        assert got.tolist() == [expected[s[i : i + length]] for s in strings for i in range(len(s) - length + 1)]


def test_windows_alone_leave_the_rounds():
    """A window that no other equals takes no part in all rounds: fewer suffixes are dealt than windows times rounds."""
    rng, dealt, sort = random.Random(9), [], np.argsort
    strings = [bytes(rng.choices(range(1, 250), k=60)) for _ in range(200)]
    strings += [strings[0][:55], strings[1][2:]]
    least = np.arange(len(strings))
    suffix_dedup.np.argsort = lambda x, **kw: (dealt.append(len(x)) if x.dtype == np.uint8 else None, sort(x, **kw))[1]
    try:
        got = suffix_dedup.repeats(strings, least, 50, 3_000)
    finally:
        suffix_dedup.np.argsort = sort
    windows = [(s[i : i + 50], own) for s, own in zip(strings, least.tolist(), strict=True) for i in range(len(s) - 49)]
    first = {}
    for w, own in windows:
        first[w] = min(own, first.get(w, own))
    assert got.tolist() == [first[w] for w, _ in windows]
    assert len(dealt) == 50 and sum(dealt) < 10 * len(windows)


def test_segments_with_an_anchor_of_their_own_have_no_repeats():
    rng = random.Random(7)
    texts = [t.encode() for t in made_texts(rng, 40)]
    strings = sorted({texts[d][b : b + w + 19] for d, b, w, _ in zip(*map(list, suffix_dedup.segments(texts, 20, 9)), strict=True)})
    among, held = suffix_dedup.shared(strings, 20, 9), Counter()
    for s in strings:
        held.update({s[i : i + 20] for i in range(len(s) - 19)})
    assert len(among) == len(strings) and 0 < among.sum() < len(among)
    for s, some in zip(strings, among.tolist(), strict=True):
        assert some or all(held[s[i : i + 20]] == 1 for i in range(len(s) - 19))


def test_transform():
    rng = random.Random(5)
    for _ in range(60):
        strings = [bytes(rng.choices(b"abc", k=rng.randrange(1, 60))) for _ in range(rng.randrange(1, 20))] + [b"ab" * 30] * 2
        text = np.frombuffer(b"\xff".join([*strings, b""]), np.uint8) + np.uint8(1)
        shard, raw = suffix_dedup.Transform(text), text.tobytes()
        end = [raw.index(0, i) + 1 for i in range(len(raw))]
        order = sorted(range(len(raw)), key=lambda i: (raw[i : end[i]], i))
        assert shard.place[order].tolist() == list(range(len(raw)))
        assert shard.bwt.tolist() == [0 if i == 0 else raw[i - 1] for i in order]
