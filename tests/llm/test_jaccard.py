"""The Jaccard join against all pairs of Python sets, and components against a plain union-find."""

import random
import re
from collections import Counter, defaultdict

from odd_rows import plain

from catalens.llm import jaccard
from catalens.llm.groups import components
from catalens.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def tops(nodes, edges):
    up = {n: n for n in nodes}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def brute(rows, percent=75, n_words=5):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", text.translate(lower))
        sets.append({tuple(w[i : i + n_words]) for i in range(len(w) - n_words + 1)} or ({tuple(w)} if w else set()))
    lists, edges = defaultdict(list), []
    for i, s in enumerate(sets):
        for g in s:
            lists[g].append(i)
    for i, s in enumerate(sets):
        for j, both in Counter(j for g in s for j in lists[g] if j < i).items():
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                edges.append((i, j))
    top = tops(range(len(rows)), edges)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[top[i]] = min(doc_id, least.get(top[i], doc_id))
    return Counter((doc_id, len(sets[i]), least.get(top[i])) for i, (doc_id, _) in enumerate(rows))


def test_whole_table(spark):
    rows = plain(spark.read.parquet(f"{SF}/documents.parquet"))
    assert Counter(map(tuple, QUERIES["op6_jaccard_join"](spark, SF).collect())) == brute(rows)


def test_odd_rows(spark, odd_docs, no_docs):
    got = jaccard.jaccard_groups(odd_docs)
    assert Counter(map(tuple, got.collect())) == brute(plain(odd_docs))
    assert jaccard.jaccard_groups(no_docs).collect() == []


def near_copies(rng, bases, copies):
    made = []
    for _ in range(bases):
        base = [f"w{rng.randrange(500)}" for _ in range(rng.randrange(12, 70))]
        for _ in range(copies):
            copy = list(base)
            for _ in range(rng.randrange(0, 5)):
                at = rng.randrange(len(copy))
                copy[at : at + rng.randrange(0, 2)] = [f"w{rng.randrange(500)}"] * rng.randrange(0, 2)
            made.append(" ".join(copy) + " common line that many texts have in one place" * rng.randrange(0, 2))
    return made


def test_groups_of_near_copies(spark):
    rng = random.Random(7)
    texts = near_copies(rng, 12, 25) + near_copies(rng, 1, 150) + ["same words again and again"] * 90
    rng.shuffle(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    for percent, cell in ((75, 4096), (75, 16), (60, 20)):
        got = jaccard.jaccard_groups(docs, percent=percent, block_bytes=4_000, cell=cell)
        assert Counter(map(tuple, got.collect())) == brute(plain(docs), percent)


def test_components(spark):
    rng = random.Random(1)
    for n, m in ((1, 0), (60, 30), (60, 50), (200, 150)):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + [(500 + i, 501 + i) for i in range(40)]
        got = components(spark.createDataFrame(edges, "a long, b long")).collect()
        nodes = {x for e in edges if e[0] != e[1] for x in e}
        assert {r["node"]: r["component"] for r in got} == tops(nodes, [e for e in edges if e[0] != e[1]]) and len(got) == len(nodes)


def test_every_link_counts(spark):
    rng = random.Random(3)
    texts = near_copies(rng, 6, 12) + near_copies(rng, 1, 60) + ["same words again and again"] * 9 + [""]
    rng.shuffle(texts)
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = {i: sum(i != j and bool(s) and 100 * len(s & t) >= 75 * len(s | t) for j, t in enumerate(sets)) for i, s in enumerate(sets)}
    for cell in (4096, 16):
        got = {r["doc_id"]: r["n_links"] for r in jaccard.jaccard_links(docs, block_bytes=4_000, cell=cell).collect()}
        assert got == want
