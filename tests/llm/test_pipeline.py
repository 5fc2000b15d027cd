"""The pipeline against plain Python, stage by stage, and odd rows through every stage."""

import hashlib
from collections import Counter

import corpus_pipeline
from odd_rows import plain
from test_jaccard import brute as near_groups
from test_tokens import expected

from __spark_entry__ import queries

SF = "/root/testdata/sf0.01"


def test_whole_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(i, t) for i, t in plain(docs) if any(map(str.isalpha, t))]
    last = {t: i for i, t in sorted(rows)}
    rows = [(i, t) for i, t in rows if last[t] == i]
    first = {i for i, _, least in near_groups(rows) if i == least}
    rows = [(i, t) for i, t in rows if i in first]
    leaks = {r["doc_id"] for r in queries()["op5_decontamination"](spark, SF).collect()}
    rows = [(i, t) for i, t in rows if i not in leaks]
    got = queries()["pipeline"](spark, SF).collect()
    assert Counter(map(tuple, got)) == expected(rows)
    assert 0.5 * docs.count() < len(got) < docs.count()


def test_odd_rows(spark, odd_docs, no_docs, tmp_path):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "exact_dedup", "near_dedup", "decontamination", "byte_bpe"]
    for docs in (odd_docs, no_docs):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            if name != "byte_bpe":
                assert out.columns == docs.columns
            docs = spark.createDataFrame(out.collect(), out.schema)
        rows = docs.collect()
    assert rows == []


def test_odd_rows_that_stay(spark, odd_docs):
    docs = odd_docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
    kept = plain(docs)
    # Of the two rows 4, the other equal text has the larger id; 6 then is a near copy of 5 and goes.
    assert len(kept) == len(set(kept)) and 5 in dict(kept) and not {0, 1, 2, 4, 6} & dict(kept).keys()
    assert None in dict(kept)
    out = corpus_pipeline.encoded(spark, docs, SF).collect()
    assert Counter((r["doc_id"], r["decoded_sha256"]) for r in out) == Counter(
        (i, hashlib.sha256(t.encode()).hexdigest()) for i, t in kept)


def test_clashing_columns(spark):
    """Columns named like those that stages work with come out as they went in."""
    names = ["lang", "kept_id", "kept_text", "found_id", "no_id", "id", "sha", "row", "kept", "keep_id", "text_sha256", "component_id", "lang_pred"]
    texts = ["one text of some words", "one text of some words", "another text here", None, "words words"]
    rows = [(i, t, *[f"{n} {i}" for n in names]) for i, t in enumerate(texts)] + [(-(1 << 63), "least", *names), (None, "least", *names)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    kept = {"exact_dedup": [r for r in rows if r[0] not in (0, None)], "near_dedup": [r for r in rows if r[0] not in (1, None)]}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        got = sorted(map(tuple, out.collect()), key=repr)
        assert set(got) <= set(rows)
        if name == "exact_dedup":
            assert got == sorted(kept[name], key=repr)
