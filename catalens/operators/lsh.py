"""Approximate cosine neighbours by weighted MinHash: a stored table of bands, and an exact look at those who share one.

In every band a vector draws one of its terms, with a chance in proportion to the square of its weight, by the same random
numbers as all others: two vectors draw the same term the more often, the more of their squared weight they share. Vectors that
drew the same term share a bucket. A bucket of more than ``bucket_rows`` is hot and is split by a further draw, and so on; what no
draw splits is dealt by a hash of the row. So a row meets at most ``bands`` x ``bucket_rows`` others, however common a term is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from catalens.operators.bounds import best_rows
from catalens.operators.joins import look_up
from catalens.operators.similar import numbered_classes, of_members
from catalens.session import materialize

BANDS, DRAWS, BUCKET_ROWS = 64, 4, 128
SEED = 20


def draws(vectors: DataFrame, key: str, n_terms: int, bands: int = BANDS, draws: int = DRAWS) -> DataFrame:
    """(key, drawn): the terms that a vector draws, ``draws`` for each of ``bands`` bands, one after the other."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chance = np.random.default_rng(SEED).exponential(size=(n_terms, bands * draws)).astype(np.float32)
        for rows in batches:
            drawn = [t[np.argmin(chance[t] / np.square(w, dtype=np.float32)[:, None], axis=0)].tolist() for t, w in zip(
                (np.asarray(t, np.int64) for t in rows["terms"]), (np.asarray(w, np.float32) for w in rows["weights"]), strict=True)]
            yield pd.DataFrame({key: rows[key], "drawn": drawn})

    kind = vectors.schema[key].dataType.simpleString()
    return vectors.select(key, "terms", "weights").mapInPandas(run, f"{key} {kind}, drawn array<int>")


def bands_table(drawn: DataFrame, key: str, bands: int = BANDS, draws: int = DRAWS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(bucket, key): every row in one bucket per band, except where it is alone. Store it to use it as an index."""
    each = drawn.select(key, F.explode(F.sequence(F.lit(0), F.lit(bands - 1))).alias("band"), "drawn").select(
        key, "band", F.slice("drawn", F.col("band") * draws + 1, draws).alias("drawn"))
    rows, out = each.withColumn("bucket", F.lit(0).cast("long")), None
    for level in range(draws):
        rows = materialize(rows.withColumn("bucket", F.xxhash64("band", "bucket", F.get("drawn", level))), "bands")
        sizes = rows.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
        sizes = materialize(sizes, "bucket-sizes")
        rows = look_up(rows, sizes, ["bucket"], sizes.count())
        small = rows.where(F.col("size") <= bucket_rows).select("bucket", key)
        out = small if out is None else out.unionByName(small)
        rows = rows.where(F.col("size") > bucket_rows)
        if level == draws - 1:
            part = F.pmod(F.xxhash64(key, "band"), F.ceil(F.col("size") / bucket_rows))
            out = out.unionByName(rows.select(F.xxhash64("bucket", part).alias("bucket"), key))
        rows = rows.drop("size")
    return out


def similar_lsh(vectors: DataFrame, keys: list[str], k: int = 5, bands: int = BANDS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(keys, near_*, score, rank): like ``similar_all``, but of the documents that share a bucket; scores are exact.

    Documents with equal vectors are one entry, so copies neither fill buckets nor are missed. The band table is written
    to the shared folder. A vector goes to its buckets as a few bytes a term, and each bucket is one dense product.
    """
    keep = k + 1
    documents, numbered, n_classes = numbered_classes(vectors, keys, keep)
    n_terms, most, longest = numbered.agg(F.max(F.array_max("terms")), F.max(F.array_max("weights")), F.max("norm2")).first()
    n_terms = (n_terms or 0) + 1
    rows = numbered.select(F.col("pos").alias("no"), "terms", "weights", "norm2")
    index = materialize(bands_table(draws(rows, "no", n_terms, bands), "no", bands, DRAWS, bucket_rows), "band-table")
    whole = rows.schema["norm2"].dataType.simpleString() != "double"
    kinds = np.min_scalar_type(n_terms), np.min_scalar_type(most or 0) if whole else np.dtype(np.float64)
    # Whole numbers below 2 ** 24 are exact in single precision, and no sum of products passes the larger squared length.
    kind = np.float32 if whole and (longest or 0) < 1 << 24 else np.float64

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come in order of bucket; a bucket that goes on in the next batch waits for it."""
        held = None
        for batch in batches:
            batch = batch if held is None else pa.concat_batches([held, batch])
            bucket = batch.column("bucket").to_numpy()
            cut = int(np.searchsorted(bucket, bucket[-1])) if len(bucket) else 0
            held = batch.slice(cut)
            yield _within(batch.slice(0, cut), n_terms, kinds, kind, keep)
        if held is not None:
            yield _within(held, n_terms, kinds, kind, keep)

    met = index.join(_in_bytes(rows, kinds), "no").repartition("bucket").sortWithinPartitions("bucket", "no")
    found = met.select("bucket", "no", "terms", "weights", "norm2").mapInArrow(search, "no long, near long, score double").distinct()
    return of_members(found, documents, numbered, n_classes, keys, k)


def _in_bytes(rows: DataFrame, kinds: tuple[np.dtype, np.dtype]) -> DataFrame:
    """Rows (no, terms, weights, norm2) with terms and weights as the bytes of arrays of these ``kinds``, stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for name, kind in zip(("terms", "weights"), kinds, strict=True):
                lists = batch.column(name)
                data = lists.flatten().to_numpy().astype(kind).tobytes()
                ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())]).astype(np.int32) * np.int32(kind.itemsize)
                out.append(pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(ends), pa.py_buffer(data)]))
            yield pa.RecordBatch.from_arrays([batch.column("no"), *out, batch.column("norm2")], ["no", "terms", "weights", "norm2"])

    norm2 = rows.schema["norm2"].dataType.simpleString()
    return materialize(rows.select("no", "terms", "weights", "norm2").mapInArrow(run, f"no long, terms binary, weights binary, norm2 {norm2}"), "in-bytes")


def _numbers(column: pa.BinaryArray, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """(where the numbers of every row begin, and at last end; the numbers of all rows)."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]].view(kind)
    return (ends - ends[0]) // kind.itemsize, data


def _within(rows: pa.RecordBatch, n_terms: int, kinds: tuple[np.dtype, np.dtype], kind: type, keep: int) -> pa.RecordBatch:
    """(no, near, score): the ``keep`` best in their bucket of all rows, which come by bucket; a row is its own partner, too."""
    bucket, no = rows.column("bucket").to_numpy(), rows.column("no").to_numpy()
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    if len(no):
        norm2 = rows.column("norm2").to_numpy().astype(np.float64)
        begin, terms = _numbers(rows.column("terms"), kinds[0])
        weights = _numbers(rows.column("weights"), kinds[1])[1]
        edges = np.append(np.flatnonzero(np.diff(bucket, prepend=bucket[0] - 1)), len(no))
        dense = np.zeros((int(np.diff(edges).max()), n_terms), kind)
        for start, stop in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            part, n = slice(begin[start], begin[stop]), stop - start
            cells = np.repeat(np.arange(n) * n_terms, np.diff(begin[start : stop + 1])) + terms[part]
            dense.ravel()[cells] = weights[part]
            dots = (dense[:n] @ dense[:n].T).astype(np.float64)
            dense.ravel()[cells] = 0
            scores = dots / np.sqrt(np.multiply.outer(norm2[start:stop], norm2[start:stop]))
            hit = dots > 0
            if n > keep:
                hit &= scores >= np.partition(scores, n - keep, axis=1)[:, n - keep, None]
            i, j = np.nonzero(hit)
            found.append((i + start, no[start + j], scores[i, j]))
    at, near, score = best_rows(*(np.concatenate(x) for x in zip(*found, strict=True)), keep)
    return pa.RecordBatch.from_arrays([pa.array(no[at]), pa.array(near), pa.array(score)], ["no", "near", "score"])


def recall(approximate: DataFrame, exact: DataFrame, keys: list[str]) -> DataFrame:
    """(n_exact, n_found): rows of the exact answer, and rows of the approximate one that score no less than a document's last exact one."""
    exact_rows = exact.groupBy(*keys).agg(F.min("score").alias("least"), F.count("*").alias("n_exact"))
    hits = approximate.join(exact_rows, keys).where(F.col("score") >= F.col("least")).groupBy(*keys).agg(F.count("*").alias("n_found"))
    return exact_rows.join(hits, keys, "left").agg(F.sum("n_exact").alias("n_exact"), F.sum("n_found").alias("n_found"))
