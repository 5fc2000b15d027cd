"""Language identification of mixed-language texts.

Words are runs of letters. The scripts of a word's letters narrow the languages that may have written it to those that
used the script in training; within these every word gets a score per language from hashed letter trigrams. Viterbi
decoding with a penalty for each switch labels the words, so a text becomes spans of languages. The language with most
letters is the prediction, and its share of the letters is the score.

Training counts trigrams and scripts over every labelled row by Spark; the model is (languages x bins) numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalens.llm.texts import STEP_ROWS, by_rows, id_text
from catalens.llm.words import mix, slices

BINS = 1 << 16
SWITCH = 8.0  # natural-log units that a change of language costs
#: Code points that numpy works on at a time.
SLICE = 1 << 18
NONE = "und"

# First code points of ranges, and the script of each range up to the next one (0: any other script).
_RANGES = [
    (0x0, "latin"), (0x370, "greek"), (0x400, "cyrillic"), (0x530, "armenian"), (0x590, "hebrew"), (0x600, "arabic"),
    (0x780, "other"), (0x900, "indic"), (0xE00, "thai"), (0xE80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"),
    (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "latin"), (0x2E80, "han"), (0x3040, "kana"),
    (0x3100, "han"), (0x3130, "hangul"), (0x3190, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"),
    (0xF900, "han"), (0xFB00, "other"), (0xFF21, "latin"), (0xFF66, "kana"), (0xFFA0, "hangul"), (0x10000, "other"),
    (0x20000, "han"), (0x32000, "other"),
]
SCRIPTS = sorted({name for _, name in _RANGES})


def script_table() -> np.ndarray:
    """For each code point 1 + the number of its script, or 0 if it is no letter."""
    letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    starts = np.array([at for at, _ in _RANGES])
    names = np.array([SCRIPTS.index(name) + 1 for _, name in _RANGES], np.uint8)
    return np.where(letter, names[np.searchsorted(starts, np.arange(0x110000), "right") - 1], 0).astype(np.uint8)


class Letters:
    """Words and trigram bins of a slice of texts."""

    def __init__(self, texts: list[str], table: np.ndarray):
        joined = "\n".join([*texts, ""]).lower()
        if len(joined) != sum(map(len, texts)) + len(texts):  # some letters grow when lower-cased
            texts = [t.lower() for t in texts]
            joined = "\n".join([*texts, ""])
        point = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
        script = table[point]
        self.at = np.flatnonzero(script)  # letters
        sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        low = np.where(script > 0, point, 0).astype(np.uint64)
        padded = np.concatenate([[np.uint64(0)], low, [np.uint64(0)]])
        one = np.uint64(21)
        mixed = mix((padded[:-2] << one << one) ^ (padded[1:-1] << one) ^ padded[2:])[self.at]
        self.bins = (mixed >> np.uint64(48)).astype(np.int64)
        self.script = script[self.at].astype(np.int64) - 1
        ends = np.cumsum(sizes)
        self.doc = np.searchsorted(ends, self.at, "right")
        # A word starts where the letter before is not next to this one.
        self.first = np.flatnonzero(np.diff(self.at, prepend=-2) != 1)
        self.word_doc = self.doc[self.first]
        self.length = np.diff(self.first, append=len(self.at))


def train(labelled: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, log weights (languages x bins), and which scripts each language uses, from columns text and lang.

    Rows without text or language are left out. With no rows the list is empty. Every row is counted.
    """
    rows = labelled.select("text", F.col("lang").cast("string").alias("lang")).filter("text IS NOT NULL AND lang IS NOT NULL")

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table, sums = script_table(), {}
        width = BINS + len(SCRIPTS)
        for part in parts:
            for lang, of_lang in part.groupby("lang"):
                texts = list(of_lang["text"])
                total = sums.setdefault(lang, np.zeros(width, np.int64))
                for a, b in slices([len(t) for t in texts], SLICE):
                    found = Letters(texts[a:b], table)
                    total[:BINS] += np.bincount(found.bins, minlength=BINS)
                    total[BINS:] += np.bincount(found.script, minlength=len(SCRIPTS))
        for lang, total in sums.items():
            at = np.flatnonzero(total)
            yield pd.DataFrame({"lang": lang, "bin": at, "n": total[at]})

    counts = rows.mapInPandas(count, "lang string, bin long, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n"))
    found = counts.toPandas()  # at most languages x (bins + scripts) rows, however long the corpus
    langs = sorted(found["lang"].unique())
    table = np.zeros((len(langs), BINS + len(SCRIPTS)))
    table[found["lang"].map({k: i for i, k in enumerate(langs)}).to_numpy(int), found["bin"].to_numpy(int)] = found["n"]
    grams, scripts = table[:, :BINS], table[:, BINS:]
    log = np.log(grams + 0.5) - np.log(grams.sum(1, keepdims=True) + 0.5 * BINS)
    used = scripts >= np.maximum(1, 0.001 * scripts.sum(1, keepdims=True))
    return langs, (log - log.mean(0) if langs else log).astype(np.float32), used


def viterbi(score: np.ndarray, start: np.ndarray, size: np.ndarray, penalty: float) -> np.ndarray:
    """Best label of every word; text d has ``size[d]`` words from ``start[d]`` on. All texts advance in step."""
    label = np.zeros(len(score), np.int64)
    order = np.argsort(-size, kind="stable")
    start, size = start[order], size[order]
    active = np.searchsorted(-size, -np.arange(size[0] if len(size) else 0), "left")  # texts longer than t
    kind = np.min_scalar_type(max(0, score.shape[1] - 1))
    came = np.zeros(score.shape, kind)
    value = np.zeros((len(size), score.shape[1]), np.float32)
    last = np.zeros(len(size), np.int64)
    for t, n in enumerate(active):
        rows, v = start[:n] + t, value[:n]
        if t:
            best = v.argmax(1)
            switch = v[np.arange(n), best] - penalty
            stay = v >= switch[:, None]
            came[rows] = np.where(stay, np.arange(v.shape[1], dtype=kind), best[:, None])
            np.maximum(v, switch[:, None], out=v)
        v += score[rows]
    for t in range(len(active) - 1, -1, -1):
        n, before = active[t], active[t + 1] if t + 1 < len(active) else 0
        last[before:n] = value[before:n].argmax(1)
        rows = start[:n] + t
        label[rows] = last[:n]
        last[:n] = came[rows, last[:n]]
    return label


def spans(texts: list[str], model, table: np.ndarray, penalty: float = SWITCH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, letters and label of every word. Letters are looked at slice by slice, words decoded for all texts at once."""
    langs, weights, used = model
    docs, lengths, scores = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros((0, len(langs)), np.float32)]
    for a, b in slices([len(t) for t in texts], SLICE):
        found = Letters(texts[a:b], table)
        if len(found.first):
            score = np.stack([np.add.reduceat(w[found.bins], found.first) for w in weights], 1)
            may = used[:, found.script[found.first]].T
            may |= ~may.any(1, keepdims=True)  # a script that no language used narrows nothing
            docs.append(found.word_doc + a)
            lengths.append(found.length)
            scores.append(np.where(may, score, np.float32(-1e6)))
    doc = np.concatenate(docs)
    _, start, size = np.unique(doc, return_index=True, return_counts=True)
    return doc, np.concatenate(lengths), viterbi(np.concatenate(scores), start, size, penalty)


def _shares(texts: list[str], model, table: np.ndarray, penalty: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text its language, its letters, and the letters of that language."""
    doc, length, label = spans(texts, model, table, penalty)
    letters = np.zeros((len(texts), len(model[0])), np.int64)
    np.add.at(letters, (doc, label), length)
    return letters.argmax(1), letters.sum(1), letters.max(1)


def predict(docs: DataFrame, model, penalty: float = SWITCH) -> DataFrame:
    """doc_id, lang_pred, score of every row. Null text or no letter: ``und`` and 0; likewise if nothing was learned.

    Long texts are taken whole; repeated rows get equal answers; a null id stays; other columns are not read. Ties go to
    the language that sorts first.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        table, (langs, *_rest) = script_table(), sent.value

        def work(ids, texts):
            if not langs:
                return {"doc_id": ids, "lang_pred": [NONE] * len(texts), "score": [0.0] * len(texts)}
            best, total, most = _shares(texts, sent.value, table, penalty)
            return {"doc_id": ids, "lang_pred": [langs[k] if n else NONE for k, n in zip(best, total, strict=True)],
                    "score": most / np.maximum(total, 1)}

        return work

    return by_rows(id_text(docs), None, "doc_id long, lang_pred string, score double", start)


def keep_rows(docs: DataFrame, model, least_share: float = 0.0, penalty: float = SWITCH) -> DataFrame:
    """The rows of ``docs``, with their columns, that ``predict`` gives a language with at least ``least_share`` of the letters.

    By default a mixture of languages stays, whatever the share of the largest. Texts without a letter, and null ones, go. If nothing was learned, every text with a letter stays.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):
        table, (langs, *_rest) = script_table(), sent.value
        for batch in batches:
            for row in range(0, batch.num_rows, STEP_ROWS):
                part = batch.slice(row, STEP_ROWS)
                texts = [t or "" for t in part.column(at).to_pylist()]
                if langs:
                    _, total, most = _shares(texts, sent.value, table, penalty)
                    keep = (total > 0) & (most >= least_share * total)
                else:
                    keep = np.array([any(map(str.isalpha, t)) for t in texts], bool)
                yield part.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
