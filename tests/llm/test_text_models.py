"""Language identification and toxicity: held-out accuracy, spans, pairs of terms, and odd rows."""

import itertools
import random

import numpy as np
from odd_rows import ODD_TEXTS

from catalens.llm import language, toxicity
from catalens.llm.queries import QUERIES, language_model

SF = "/root/testdata/sf0.01"


def test_languages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    rows = QUERIES["op8_language"](spark, SF).join(docs, "doc_id").collect()
    assert len(rows) == docs.count() and {r["held_out"] for r in rows} == {True, False}
    for held_out in (True, False):
        part = [r for r in rows if r["held_out"] == held_out]
        assert sum(r["lang"] == r["lang_pred"] for r in part) >= 0.99 * len(part)
        assert all(0 <= r["score"] <= 1 for r in part)


def test_odd_languages(spark, odd_docs, no_docs):
    model = language_model(spark.read.parquet(f"{SF}/documents.parquet"))
    out = [(r["doc_id"], r["lang_pred"], r["score"]) for r in language.predict(odd_docs, model).collect()]
    assert len(out) == len(ODD_TEXTS) + 2
    assert {i for i, lang, score in out if lang == "und"} == {
        i for i, t in enumerate(ODD_TEXTS) if not any(map(str.isalpha, t or ""))}
    assert all((lang == "und") == (score == 0) for _, lang, score in out)
    kept = language.keep_rows(odd_docs, model)
    assert kept.columns == odd_docs.columns and kept.schema == odd_docs.schema
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(i) for i, lang, s in out if lang != "und")
    assert language.predict(no_docs, model).collect() == []
    nothing = language.train(no_docs)
    assert {r["lang_pred"] for r in language.predict(odd_docs, nothing).collect()} == {"und"}
    assert {r["doc_id"] for r in language.keep_rows(odd_docs, nothing).collect()} == {
        None, *(i for i, t in enumerate(ODD_TEXTS) if any(map(str.isalpha, t or "")))}


def test_spans_and_scripts(spark):
    rng = random.Random(1)
    kinds = {"aa": "abcde", "bb": "vwxyz", "gr": "αβγδε"}
    made = lambda k, n: " ".join("".join(rng.choices(kinds[k], k=5)) for _ in range(n))
    rows = [(made(k, 40), k) for k in kinds for _ in range(20)] + [(None, "aa"), ("x", None)]
    model = language.train(spark.createDataFrame(rows, "text string, lang string"))
    assert model[0] == ["aa", "bb", "gr"]
    table = language.script_table()
    text = " ".join([made("aa", 9), made("bb", 1)[:3], made("aa", 8), made("bb", 12), made("gr", 2)])
    *_, label = language.spans([text, "", made("bb", 3)], model, table)
    # A single short word does not switch; a run of words does; a script that only one language uses decides at once.
    assert [(model[0][k], len(list(g))) for k, g in itertools.groupby(label)] == [("aa", 18), ("bb", 12), ("gr", 2), ("bb", 3)]


def test_more_languages_than_a_byte_numbers():
    score = np.zeros((4, 300), np.float32)
    score[:, 280] = 1
    assert language.viterbi(score, np.array([0]), np.array([4]), 0.5).tolist() == [280] * 4


def test_mixtures_stay(spark):
    rng = random.Random(4)
    kinds = {"aa": "abcde", "bb": "vwxyz", "gr": "αβγδε"}
    made = lambda k, n: " ".join("".join(rng.choices(kinds[k], k=5)) for _ in range(n))
    model = language.train(spark.createDataFrame([(made(k, 40), k) for k in kinds for _ in range(20)], "text string, lang string"))
    docs = spark.createDataFrame([(1, " ".join(made(k, 20) for k in kinds)), (2, "12 34"), (3, made("aa", 9))], "doc_id long, text string")
    assert language.predict(docs, model).filter("doc_id = 1").first()["score"] < 0.5
    assert sorted(r["doc_id"] for r in language.keep_rows(docs, model).collect()) == [1, 3]
    assert [r["doc_id"] for r in language.keep_rows(docs, model, least_share=0.9).collect()] == [3]


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(2)
    size = np.array([1, 4, 6, 2, 6])
    start = np.concatenate([[0], np.cumsum(size)[:-1]])
    score = rng.normal(0, 2, (size.sum(), 3)).astype(np.float32)
    label = language.viterbi(score, start, size, 1.5)

    def worth(at, path):
        return sum(score[at + i, k] for i, k in enumerate(path)) - 1.5 * sum(a != b for a, b in itertools.pairwise(path))

    for at, n in zip(start, size, strict=True):
        best = max(worth(at, p) for p in itertools.product(range(3), repeat=n))
        assert abs(worth(at, label[at : at + n]) - best) < 1e-4


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    rows = QUERIES["op7_toxicity"](spark, sf).join(labels, "doc_id").filter("held_out").collect()
    bad, clean = [r for r in rows if r["toxic"]], [r for r in rows if not r["toxic"]]
    assert sum(r["predicted"] for r in bad) >= 0.8 * len(bad)
    assert sum(r["predicted"] for r in clean) <= 0.01 * len(clean)
    assert all(r["predicted"] == (r["score"] >= 0.7) and 0 <= r["score"] <= 1 for r in rows)


def test_pairs_of_terms():
    """Toxic only where an insult meets a group: no sum of term weights can tell, the pair term can."""
    rng = random.Random(4)
    filler = [f"word{i}" for i in range(60)]

    def text(insult, group):
        return " ".join(rng.sample(filler, 6) + ["insulting"] * insult + ["grouping"] * group)

    kinds = [(a, b) for a in (0, 1) for b in (0, 1)] * 300
    texts, labels = [text(a, b) for a, b in kinds], np.array([a != b for a, b in kinds], int)
    machine = toxicity.fit(toxicity.term_sets(texts), labels, epochs=40)
    fresh = [text(a, b) for a, b in kinds]
    assert np.mean((machine.score(fresh) >= 0.5) == labels) > 0.97


def test_odd_toxicity(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(i, i % 2) for i in range(10)] + [(None, 1), (3, None), (99, 1)], "doc_id long, label int")
    machine = toxicity.train(odd_docs, labels)
    out = toxicity.predict(odd_docs, machine).collect()
    assert len(out) == len(ODD_TEXTS) + 2 and all(0 < r["score"] < 1 for r in out)
    assert len({r["score"] for r in out if r["doc_id"] in (0, 1)}) == 1
    assert toxicity.predict(no_docs, machine).collect() == []
    for none in (labels.limit(0), labels.filter("label = 1")):
        alone = toxicity.train(odd_docs, none)
        assert len({r["score"] for r in toxicity.predict(odd_docs, alone).collect()}) == 1


def test_repeated_ids_do_not_grow_the_sample(spark, monkeypatch):
    """However many documents share a sampled id, one text per label comes to the driver."""
    docs = spark.createDataFrame([(i % 7, f"text {i} of words") for i in range(700)], "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, i % 2) for i in range(7)] * 3, "doc_id long, label int")
    sizes = []
    monkeypatch.setattr(toxicity, "fit", lambda sets, marks: sizes.append((len(sets), sorted(marks.tolist()))))
    toxicity.train(docs, labels)
    toxicity.train(docs, labels, most=3)
    assert sizes[0] == (7, [0, 0, 0, 0, 1, 1, 1]) and sizes[1][0] == 3
