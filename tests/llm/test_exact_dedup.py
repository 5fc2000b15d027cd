import hashlib
from collections import Counter, defaultdict

from odd_rows import plain

from catalens.llm import exact_dedup


def brute(rows, pick):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[text].append(doc_id)
    out, seen = Counter(), set()
    for doc_id, text in rows:
        ids = [i for i in groups[text] if i is not None]
        keep = pick(ids) if ids else None
        kept = doc_id == keep and (text, doc_id) not in seen
        seen |= {(text, doc_id)} if kept else set()
        out[doc_id, keep, len(groups[text]), kept, hashlib.sha256(text.encode()).hexdigest()] += 1
    return out


def test_odd_rows(odd_docs, no_docs):
    for keep, pick in (("max", max), ("min", min)):
        got = exact_dedup.exact_dedup(odd_docs, keep, fan_in=2, rounds=3)
        assert Counter(map(tuple, got.collect())) == brute(plain(odd_docs), pick)
    assert exact_dedup.exact_dedup(no_docs).collect() == []


def test_hot_group(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"t{i % 400}") for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    for fan_in, rounds in ((4, 2), (8, None)):
        got = exact_dedup.exact_dedup(docs, fan_in=fan_in, rounds=rounds)
        assert Counter(map(tuple, got.collect())) == brute(rows, max)


def test_runs_are_sorted_and_merged(spark, odd_docs):
    """Every round sorts by digest and merges equal neighbours; no hash table stands in for it."""
    rows = exact_dedup._digests(odd_docs)
    plan = exact_dedup.merge_runs(rows, fan_in=2, rounds=3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortAggregate") >= 4 and "HashAggregate" not in plan.split("Initial Plan")[0]
    assert plan.count("Sort [run") >= 4
