"""Context-tree weighting over bytes: log probability of every text, and its code length per byte.

A byte is eight binary decisions. For every decision (a prefix of the byte's bits) there is a tree of contexts: the bytes
before, up to ``DEPTH`` of them. A node holds how often 0 and 1 followed in training; its Krichevsky-Trofimov estimate is
mixed half and half with the product of its children, so all depths vote by what they have proved to be worth. After
training the mixture's prediction is a weighted mean along the path of the context, from the whole corpus to the last
``DEPTH`` bytes.

Counting and looking up are by blocks: a block asks for its distinct byte sequences of DEPTH + 1, dealt to buckets by
their last two context bytes. Below that depth a bucket has whole subtrees; the two levels above are sums of at most 65,280
numbers. Text is lower-cased (A-Z) and ended by the byte 255, which no text contains and which also stands before it.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalens.llm.blocks import ANSWER, BLOCK_BYTES, BUCKET_BYTES, Bucket, answered, answers_of, ask, bucket_bits, pack, unpack
from catalens.llm.words import LOWER, NOT_SPACE, distinct, slices, words
from catalens.session import materialize

DEPTH = 6
END = 255
SLICE = 1 << 19
_U = np.uint64
#: Odd; multiplying by it modulo 2^16 spreads the two nearest context bytes evenly over buckets.
_SPREAD = _U(40503)


def trains(doc_id) -> bool:
    """Whether a document is learned from: crc32 of its id in decimal digits, modulo 7, is not 2. A null id is empty."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 7 != 2


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Natural log of the Krichevsky-Trofimov probability of a sequence with so many zeros and ones."""
    return _lgamma(zeros + 0.5) + _lgamma(ones + 0.5) - _lgamma(zeros + ones + 1.0) - math.log(math.pi)


def _lgamma(x: np.ndarray) -> np.ndarray:
    """Log gamma for x >= 0.5: Stirling's series after moving x beyond 10."""
    x = np.asarray(x, float)
    shift = np.zeros_like(x)
    y = x.copy()
    for _ in range(10):
        low = y < 10
        shift[low] += np.log(y[low])
        y[low] += 1
    inv = 1 / y
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + inv / 12 - inv**3 / 360 + inv**5 / 1260 - inv**7 / 1680 - shift


def sequences(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, key) of every byte and end: nearest context byte first, so that equal contexts are neighbours in order."""
    flat = LOWER[np.frombuffer(b"".join(b"\xff" * depth + t + b"\xff" for t in texts), np.uint8)].astype(_U)
    total = len(flat) - depth
    near = (flat[depth - 1 : depth - 1 + total] << _U(8)) | flat[depth - 2 : depth - 2 + total]
    key = (near * _SPREAD) & _U(0xFFFF)
    for k in range(3, depth + 1):
        key = key << _U(8) | flat[depth - k : depth - k + total]
    key = (key << _U(8) | flat[depth : depth + total]) << _U(56 - 8 * depth)
    size = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    begin = np.cumsum(size + depth) - size - depth
    at = np.repeat(begin - np.cumsum(size) + size, size) + np.arange(size.sum())
    return np.repeat(np.arange(len(texts)), size), key[at]


class Tree:
    """Nodes of one bit of the byte, below the two context bytes that the keys of a bucket touch; ``key`` is sorted.

    The bits are eight separate trees: a node belongs to a context and the bits before, so each is built on its own.
    """

    def __init__(self, key: np.ndarray, count: np.ndarray, depth: int, nth: int):
        symbol = ((key >> _U(56 - 8 * depth)) & _U(255)).astype(np.int64)
        self.prefix = (1 << nth) | (symbol >> (8 - nth))
        self.bit = ((symbol >> (7 - nth)) & 1).astype(bool)
        trained = count * self.bit
        self.levels = []  # from ``depth`` to 2: node of each key, estimate of a one, weight of stopping there
        below = None
        for d in range(depth, 1, -1):
            context = key >> _U(64 - 8 * d)
            number = np.cumsum(np.concatenate([[0], context[1:] != context[:-1]]))
            names, first, node = np.unique(number << 8 | self.prefix, return_index=True, return_inverse=True)
            ones = np.bincount(node, trained, len(names))
            zeros = np.bincount(node, count, len(names)) - ones
            kt = log_kt(zeros, ones)
            if below is None:
                mixed, stop = kt, np.ones(len(names))
            else:
                deeper = np.bincount(node[below[0]], below[1], len(names))
                mixed = np.logaddexp(kt, deeper) - math.log(2)
                stop = np.exp(kt - math.log(2) - mixed)
            self.levels.append((node.astype(np.int32), (ones + 0.5) / (zeros + ones + 1), stop))
            below = first, mixed
        self.first, self.mixed, self.zeros, self.ones = first, mixed, zeros, ones
        near = (key >> _U(48)) * _U(pow(int(_SPREAD), -1, 1 << 16)) & _U(0xFFFF)
        self.nearest = (near >> _U(8)).astype(np.int64)

    def above(self) -> pd.DataFrame:
        """What the two-byte contexts hand to the one-byte contexts: per (byte, prefix) the log product and the counts."""
        rows = pd.DataFrame({"byte": self.nearest[self.first], "prefix": self.prefix[self.first], "mixed": self.mixed,
                             "zeros": self.zeros.astype(np.int64), "ones": self.ones.astype(np.int64)})
        return rows.groupby(["byte", "prefix"], as_index=False).sum()

    def log10(self, top: dict) -> np.ndarray:
        """Log10 probability of this bit of every key after the bytes and bits before it."""
        p = None
        for node, one, stop in self.levels:
            p = one[node] if p is None else stop[node] * one[node] + (1 - stop[node]) * p
        for name, at in (("near", self.nearest << 8 | self.prefix), ("all", self.prefix)):
            one, stop = top[name]
            p = stop[at] * one[at] + (1 - stop[at]) * p
        return np.log10(np.where(self.bit, p, 1 - p))


def _top(rows: pd.DataFrame) -> dict:
    """Estimates and stopping weights of the one-byte contexts and of the whole corpus."""
    out, size = {}, 1 << 16
    mixed, zeros, ones = (np.zeros(size) for _ in range(3))
    at = rows["byte"].to_numpy(np.int64) << 8 | rows["prefix"].to_numpy(np.int64)
    for a, name in ((mixed, "mixed"), (zeros, "zeros"), (ones, "ones")):
        a[at] = rows[name]
    for name in ("near", "all"):
        kt = log_kt(zeros, ones)
        whole = np.logaddexp(kt, mixed) - math.log(2)
        out[name] = (ones + 0.5) / (zeros + ones + 1), np.exp(kt - math.log(2) - whole)
        mixed, zeros, ones = (x.reshape(-1, 256).sum(0) for x in (whole, zeros, ones))
    return out


class Slice:
    """Keys of a slice of texts: the distinct ones, and the texts of all of them in that order."""

    def __init__(self, doc: np.ndarray, key: np.ndarray):
        order = np.argsort(key)
        ranked = key[order]
        new = np.ones(len(key), bool)
        np.not_equal(ranked[1:], ranked[:-1], out=new[1:])
        self.first = np.flatnonzero(new)
        self.keys, self.doc = ranked[self.first], doc[order].astype(np.int32)

    def trained(self, learn: np.ndarray) -> np.ndarray:
        return np.add.reduceat(learn[self.doc].astype(np.int64), self.first) if len(self.first) else self.first

    def spread(self, value: np.ndarray) -> np.ndarray:
        """One value per distinct key, repeated for every occurrence."""
        return np.repeat(value, np.diff(self.first, append=len(self.doc)))


def _slices(row: dict, keys_of) -> list[tuple[int, np.ndarray, Slice]]:
    """(first text, whether each text trains, keys) of a block's slices; ``keys_of(texts)`` gives (text, key) pairs."""
    texts, learn = unpack(row["sizes"], row["data"]), np.array([trains(i) for i in row["ids"]], bool)
    return [(a, learn[a:b], Slice(*keys_of(texts[a:b]))) for a, b in slices([len(t) for t in texts], SLICE)]


def _distinct(parts) -> np.ndarray:
    return distinct(np.concatenate([np.zeros(0, _U), *(part.keys for _, _, part in parts)]))


def _asked(row: dict, keys_of) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of a block and how often they come in training."""
    parts = _slices(row, keys_of)
    keys = _distinct(parts)
    counts = np.zeros(len(keys), np.int64)
    for _, learn, part in parts:
        counts[np.searchsorted(keys, part.keys)] += part.trained(learn)
    return keys, counts


def _words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    found = words(texts, NOT_SPACE)
    return found.doc, found.hash


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pd.DataFrame, Bucket]]:
    for batch in batches:
        for row in batch.to_pylist():
            part = pd.DataFrame(row["all"]).assign(bucket=row["bucket"])
            yield part, Bucket(part, np.int64, 8)


def score(docs: DataFrame, depth: int = DEPTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte of every row.

    Learns from the rows of ``trains``. ``base_score`` is the add-one unigram score of words and one end; ``score`` the tree's
    log10 probability of the lower-cased bytes and the end. A null text is an empty one, scored by its end alone; without
    training rows every decision has probability one half. Repeated rows count and score one by one; null ids stay; other
    columns are not read.
    """
    if not 2 <= depth <= 7:
        raise ValueError("depth is 2 to 7 bytes")
    packed = pack(docs, "score-blocks", block_bytes)
    bits = min(16, bucket_bits(packed, BUCKET_BYTES // 4))
    spark = docs.sparkSession

    def sequence_keys(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return sequences(texts, depth)

    # Each bucket is one row, of a size that ``bucket_bits`` bounds; both rounds then read it without a shuffle.
    asked = ask(packed, lambda row: _asked(row, sequence_keys), bits, 8)
    asked = materialize(asked.groupBy("bucket").agg(F.collect_list(F.struct("block", "keys", "counts")).alias("all")), "sequences")

    def above(batches):
        for _, bucket in _buckets(batches):
            for nth in range(8):
                yield pa.RecordBatch.from_pandas(Tree(bucket.keys, bucket.total, depth, nth).above(), preserve_index=False)

    of_near = asked.mapInArrow(above, "byte long, prefix long, mixed double, zeros long, ones long")
    top = spark.sparkContext.broadcast(_top(of_near.groupBy("byte", "prefix").agg(
        F.sum("mixed").alias("mixed"), F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones")).toPandas()))

    def predicted(batches):
        for _, bucket in _buckets(batches):
            said = sum(Tree(bucket.keys, bucket.total, depth, nth).log10(top.value) for nth in range(8))
            said = bucket.answers(said.astype(np.float32))
            yield pa.RecordBatch.from_pandas(said.astype({"bucket": np.int32}), preserve_index=False)

    def counted(part: pd.DataFrame) -> pd.DataFrame:
        bucket = Bucket(part, np.int64, 8)
        sums = np.array([bucket.total.sum(), (bucket.total > 0).sum()], np.int64)  # tokens and distinct ones, as block -1
        return pd.concat([bucket.answers(bucket.total), pd.DataFrame(
            {"block": [-1], "bucket": [int(part["bucket"].iloc[0])], "answer": [sums.tobytes()]})])

    of_words = ask(packed, lambda row: _asked(row, _words), bits, 8).groupBy("bucket").applyInPandas(counted, ANSWER)
    of_words = materialize(of_words, "word-counts")
    sums = [np.frombuffer(r["answer"], np.int64) for r in of_words.filter("block = -1").select("answer").collect()]
    ends = packed.select(F.explode("ids").alias("doc_id")).filter(
        F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 != 2).count()
    n_train = int(sum(s[0] for s in sums)) + ends
    n_kinds = int(sum(s[1] for s in sums)) + (ends > 0)
    ready = answered(packed, asked.mapInArrow(predicted, ANSWER), "of_sequences")
    ready = answered(ready, of_words.filter("block >= 0"), "of_words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                n = len(row["ids"])
                n_tokens, n_known, base, own = np.ones(n, np.int64), np.full(n, int(ends > 0)), np.zeros(n), np.zeros(n)
                parts = _slices(row, sequence_keys)
                keys, said = _distinct(parts), answers_of(row, np.float32, "of_sequences")
                for a, learn, part in parts:
                    m, value = len(learn), said[np.searchsorted(keys, part.keys)]
                    own[a : a + m] = np.bincount(part.doc, part.spread(value), m)
                parts = _slices(row, _words)
                keys, said = _distinct(parts), answers_of(row, np.int64, "of_words")
                for a, learn, part in parts:
                    m, c = len(learn), said[np.searchsorted(keys, part.keys)]
                    n_tokens[a : a + m] += np.bincount(part.doc, minlength=m)
                    n_known[a : a + m] += np.bincount(part.doc, part.spread(c > 0), m).astype(np.int64)
                    base[a : a + m] = np.bincount(part.doc, part.spread(np.log10(c + 1.0)), m)
                base += math.log10(ends + 1) - n_tokens * math.log10(n_train + n_kinds + 1)
                size = np.array(row["sizes"], np.int64)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(row["ids"], pa.int64()), "held_out": pa.array([not trains(i) for i in row["ids"]]),
                    "n_tokens": n_tokens, "n_known": n_known, "train_tokens": np.full(n, n_train), "base_score": base,
                    "score": own, "n_bytes": size, "bits_per_byte": -own * math.log2(10) / (size + 1)})

    return ready.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
                                 "base_score double, score double, n_bytes long, bits_per_byte double")
