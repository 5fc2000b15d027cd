"""Toxicity by a factorization machine over hashed terms.

A text is the set of its terms, hashed to bins: runs of letters and digits, lower-cased, and their first bytes, so that
inflected forms of a stem share a term; terms that come often are terms of their own. The machine's score is a bias, a
weight per term, and for every pair of terms the product of their factor vectors, so that a term may matter only beside
another one (an insult beside the name of a group). Pairs cost nothing extra: their sum is half of (squared sum minus sum
of squares) of the factors.

Fitting takes a bounded sample of labelled rows (``MAX_SAMPLE``, picked by hash); scoring takes every row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalens.llm.texts import by_rows, id_text
from catalens.llm.words import ALPHANUMERIC, mix, powers, prefix_hashes, slices, words

BINS = 1 << 20
FACTORS = 8
#: Bytes of the beginnings of words, and how often a term must come for each of its levels.
PREFIXES = (5, 7)
LEVELS = (1, 2, 4)
#: Labelled rows that are fitted at most; documented bound of the classifier's sample.
MAX_SAMPLE = 12_000
#: Terms in fewer sampled texts than this have no weight.
LEAST_TEXTS = 5
SLICE = 1 << 18


def terms(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text, bin) pairs, sorted, each once: words, their beginnings, and both again if they come twice or four times."""
    found = words([t.lower() for t in texts], ALPHANUMERIC)
    inner, size = prefix_hashes(found.flat), found.end - found.start
    seen = [(found.doc, found.hash)]
    for n in PREFIXES:
        at = np.flatnonzero(size > n)
        begin = found.start[at]
        seen.append((found.doc[at], mix((inner[begin + n] - inner[begin]) * powers(len(inner))[1][begin]) + np.uint64(n)))
    doc = np.concatenate([d for d, _ in seen]).astype(np.uint64)
    term = np.concatenate([h for _, h in seen]) >> np.uint64(24)
    pair, count = np.unique(doc << np.uint64(40) | term, return_counts=True)
    doc, term = pair >> np.uint64(40), pair & np.uint64((1 << 40) - 1)
    out = []
    for level, least in enumerate(LEVELS):
        often = count >= least
        out.append(doc[often] << np.uint64(20) | mix(term[often] + (np.uint64(level) << np.uint64(40))) >> np.uint64(44))
    pairs = np.unique(np.concatenate(out)).astype(np.int64)
    return pairs >> 20, pairs & (BINS - 1)


class Machine:
    def __init__(self, bins: np.ndarray, bias: float, weight: np.ndarray, factor: np.ndarray):
        self.bins, self.bias, self.weight, self.factor = bins, bias, weight, factor

    def raw(self, doc: np.ndarray, term: np.ndarray, n: int) -> np.ndarray:
        """Log odds of n texts from (text, position in ``bins``) pairs."""
        linear = np.bincount(doc, self.weight[term], n)
        sums = np.stack([np.bincount(doc, v, n) for v in self.factor[term].T], 1) if len(term) else np.zeros((n, 1))
        squares = np.bincount(doc, (self.factor[term] ** 2).sum(1), n)
        return self.bias + linear + 0.5 * ((sums**2).sum(1) - squares)

    def score(self, texts: list[str]) -> np.ndarray:
        doc, term = terms(texts)
        at = np.searchsorted(self.bins, term)
        known = (at < len(self.bins)) & (self.bins[np.minimum(at, len(self.bins) - 1)] == term) if len(self.bins) else at > 0
        return 1 / (1 + np.exp(-np.clip(self.raw(doc[known], at[known], len(texts)), -30, 30)))


class Proximal:
    """Follow-the-regularised-leader: per-coordinate rates, and exact zeros where the summed evidence is below ``l1``."""

    def __init__(self, start: np.ndarray, rate: float, l1: float, l2: float):
        self.start, self.rate, self.l1, self.l2 = start, rate, l1, l2
        self.value, self.z, self.n = start.copy(), np.zeros_like(start), np.zeros_like(start)

    def step(self, at, slope: np.ndarray) -> None:
        z, n = self.z[at], self.n[at]
        new = n + slope**2
        z = z + slope - (np.sqrt(new) - np.sqrt(n)) / self.rate * (self.value[at] - self.start[at])
        self.z[at], self.n[at] = z, new
        pull = np.sign(z) * np.maximum(np.abs(z) - self.l1, 0)
        self.value[at] = self.start[at] - pull / ((1 + np.sqrt(new)) / self.rate + self.l2)


def fit(sets: list[np.ndarray], labels: np.ndarray, epochs: int = 10, rate: float = 0.3, l1: float = 12.0, l1_pairs: float = 8.0,
        l2: float = 0.1, seed: int = 1) -> Machine:
    """Logistic loss in small batches; terms without enough evidence keep zero weights, so chance words stay out.

    Classes are not reweighted, so scores are probabilities. Without rows, or with one class alone, the machine answers the
    smoothed share of that class.
    """
    labels = np.asarray(labels, float)
    doc = np.repeat(np.arange(len(sets), dtype=np.int32), [len(x) for x in sets])
    at = np.concatenate([*sets, np.zeros(0, np.int32)])
    share = (labels.sum() + 0.5) / (len(labels) + 1)
    often = np.bincount(at, minlength=BINS) >= LEAST_TEXTS
    bins, known = np.flatnonzero(often), often[at]
    doc, at = doc[known], (np.cumsum(often, dtype=np.int32) - 1)[at[known]]
    bias = Proximal(np.array([np.log(share / (1 - share))]), rate, 0.0, 0.0)
    if not len(bins) or labels.min() == labels.max():
        return Machine(bins[:0], float(bias.value[0]), np.zeros(0), np.zeros((0, FACTORS)))
    rng = np.random.default_rng(seed)
    weight = Proximal(np.zeros(len(bins)), rate, l1, l2)
    factor = Proximal(rng.normal(0, 0.01, (len(bins), FACTORS)), rate, l1_pairs, l2)
    machine = Machine(bins, float(bias.value[0]), weight.value, factor.value)
    first = np.searchsorted(doc, np.arange(len(labels) + 1))
    for _ in range(epochs):
        order = rng.permutation(len(labels))
        for k in range(0, len(order), 64):
            batch = order[k : k + 64]
            size = first[batch + 1] - first[batch]
            row = np.repeat(np.arange(len(batch)), size)
            t = at[np.repeat(first[batch] - np.cumsum(size) + size, size) + np.arange(size.sum())]
            slope = 1 / (1 + np.exp(-np.clip(machine.raw(row, t, len(batch)), -30, 30))) - labels[batch]
            touched, local = np.unique(t, return_inverse=True)
            sums = np.stack([np.bincount(row, v, len(batch)) for v in factor.value[t].T], 1)
            pull = slope[row][:, None] * (sums[row] - factor.value[t])
            weight.step(touched, np.bincount(local, slope[row], len(touched)))
            factor.step(touched, np.stack([np.bincount(local, p, len(touched)) for p in pull.T], 1))
            bias.step(slice(None), np.array([slope.sum()]))
            machine.bias = float(bias.value[0])
    return machine


def term_sets(texts: list[str]) -> list[np.ndarray]:
    out = []
    for a, b in slices([len(t) for t in texts], SLICE):
        doc, term = terms(texts[a:b])
        out += np.split(term.astype(np.int32), np.searchsorted(doc, np.arange(1, b - a)))
    return out


def train(docs: DataFrame, labels: DataFrame, most: int = MAX_SAMPLE) -> Machine:
    """Fit on the texts of at most ``most`` rows of ``labels`` (doc_id, label 0 or 1), picked by a hash of the id.

    Rows without id or label are left out. Of documents that share an id, one text counts for each label: the one whose set of
    terms sorts first. So the sample has a fixed bound, its ids are broadcast, and its sets of hashed terms come to the
    driver, one per row of the sample and each of at most BINS numbers.
    """
    chosen = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("label").cast("int").alias("label")).filter(
        "doc_id IS NOT NULL AND label IS NOT NULL").distinct().orderBy(F.xxhash64("doc_id"), "label").limit(most)

    def hashed(batches):
        for batch in batches:
            sets = term_sets(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column(1), "label": batch.column(2), "terms": pa.array([x.tobytes() for x in sets], pa.binary())})

    rows = id_text(docs).join(F.broadcast(chosen), "doc_id").select("text", "doc_id", "label").mapInArrow(
        hashed, "doc_id long, label int, terms binary").groupBy("doc_id", "label").agg(F.min("terms").alias("terms")).toPandas()
    rows = rows.sort_values(["doc_id", "label"], ignore_index=True)
    return fit([np.frombuffer(x, np.int32) for x in rows["terms"]], rows["label"].to_numpy())


def predict(docs: DataFrame, machine: Machine, threshold: float = 0.7) -> DataFrame:
    """doc_id, score, predicted of every row; a null text scores as an empty one, that is by the bias alone.

    Whole texts are read; repeated rows score alike; null ids stay; other columns are not read.
    """
    # Bounded: the frequent terms of at most MAX_SAMPLE texts.
    sent = docs.sparkSession.sparkContext.broadcast((machine.bins, machine.bias, machine.weight, machine.factor))

    def start():
        own = Machine(*sent.value)

        def work(ids, texts):
            score = np.zeros(len(texts))
            for a, b in slices([len(t) for t in texts], SLICE):
                score[a:b] = own.score(texts[a:b])
            return {"doc_id": ids, "score": score, "predicted": (score >= threshold).astype(np.int32)}

        return work

    return by_rows(id_text(docs), None, "doc_id long, score double, predicted int", start)
