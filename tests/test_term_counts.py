"""Terms are counted inside the row of a document."""

from collections import Counter

from catalens.operators import vectors

TEXTS = [(1, "bb aa, cc aa Aa"), (2, None), (3, ""), (4, "the x 1 the"), (5, "zz")]


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, text string").repartition(3)


def counts(rows):
    return sorted((r["id"], r["term"], r["tf"]) for r in rows.collect())


def test_documents_are_not_shuffled(spark):
    found = vectors.term_counts(frame(spark, TEXTS), ["id"], "text", ["the"])
    assert counts(found) == [(1, "aa", 3), (1, "bb", 1), (1, "cc", 1), (5, "zz", 1)]
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    for made in (vectors.vocabulary_counts, vectors.frequent_counts):
        plan = made(frame(spark, TEXTS), ["id"], "text", ["the"], 2)._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(id" not in plan


def test_rows_that_share_their_keys_are_one_document(spark):
    rows = [*TEXTS, (1, "aa dd"), (None, "nn mm"), (None, "nn")]
    found = vectors.term_counts(frame(spark, rows), ["id"], "text", [])
    expected = Counter()
    for i, text in rows:
        expected.update((i, w) for w in (text or "").lower().replace(",", "").split() if len(w) > 1)
    assert {(r["id"], r["term"]): r["tf"] for r in found.collect()} == expected and found.count() == len(expected)


def test_vectors_by_hand(spark):
    found = vectors.document_vectors(frame(spark, [*TEXTS, (1, "zz")]), ["id"], "text", ["the"], 2)
    # The vocabulary is aa (3) and zz (2).
    assert sorted(map(tuple, found.collect())) == [(1, [0, 1], [3, 1], 10), (5, [1], [1], 1)]
    empty = vectors.document_vectors(frame(spark, TEXTS).limit(0), ["id"], "text", [], 2, tfidf=True)
    assert empty.count() == 0 and empty.schema["weights"].dataType.simpleString() == "array<double>"


ODD = ["", None, "x", "a b c", "İstanbul ΣΑΣ straße", "𝐀𝐁 𝟙𝟚 \U00020000\U00020001 zz", "a\u0301b ab\u200dcd", "½¾ Ⅷⅷ ٣٤ _a _", "tab\tbb\x85cc\u3000dd\n",
       "the the of zz", "ﬁﬂ ǅx 한글 日本語 ก่า", "\U0001e900\U0001e901 \ufffd\x00ab"]


def test_slices_and_pieces_have_the_words_of_the_expression(spark, monkeypatch):
    docs = frame(spark, [(i, t) for i, t in enumerate(ODD * 3)])
    words = vectors._words(docs, ["id"], "text", ["the"]).groupBy("id", "term").count()
    expected = sorted(map(tuple, words.collect()))
    for size in (vectors.SLICE_BYTES, 30, 1):
        monkeypatch.setattr(vectors, "SLICE_BYTES", size)
        assert counts(vectors.term_counts(docs, ["id"], "text", ["the"])) == expected
    inside = vectors.np.unpackbits(vectors.np.frombuffer(vectors._word_characters(), vectors.np.uint8)).astype(bool)
    texts = ["ab ab c", "", "dd ab", "é été"] * 4
    whole = vectors._tokens_of(texts, inside)
    monkeypatch.setattr(vectors, "PIECE_CHARS", 8)
    cut = vectors._tokens_of(texts, inside)
    named = [list(zip(of.tolist(), terms.take(vectors.pa.array(no)).to_pylist(), strict=True)) for of, no, terms in (whole, cut)]
    assert named[0] == named[1] and named[0][:4] == [(0, "ab"), (0, "ab"), (2, "dd"), (2, "ab")]


def test_totals_have_a_term_once_a_slice(spark):
    """The vocabulary reads one row for each term of a slice, not one for each document that has it."""
    docs = spark.createDataFrame([(i, "aa bb aa") for i in range(100)], "id long, text string").coalesce(1)
    totals = vectors._totals(vectors.counted(docs, ["id"], "text", []))
    assert sorted(map(tuple, totals.collect())) == [("aa", 200, 100), ("bb", 100, 100)]
