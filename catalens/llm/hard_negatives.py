"""Hard negatives by inner product, found in buckets of vectors of like length with sorted coordinate lists.

All rows are dealt to lanes and stream through the tasks longest vector first; ``BUCKET_ROWS`` rows at a time form a bucket.
A bucket keeps every coordinate of its normalised vectors as a sorted list. An anchor that needs a score of at least s
drops out when its length times the bucket's greatest length is less, and with it out of all buckets after. Else a row must lie
within the angle arccos(s / (lengths)) of the anchor, which bounds each of its coordinates: the feasible ranges of the anchor's
largest coordinates are cut out of the sorted lists and intersected, and what is left is verified by exact integer products.
The needed score rises with what a lane has found.

Anchors are the queries, in blocks of bounded size; every block meets every lane, and a task holds one block and one bucket. It
returns the first few rows per anchor and question, of which the first few of all lanes are taken.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalens.session import materialize

#: Rows in a bucket, anchors in a block, and coordinates whose ranges are intersected.
BUCKET_ROWS, BLOCK_ANCHORS, FOCUS = 4_096, 4_096, 3
#: Pairs of an anchor block and a lane to aim for, per core.
CELLS_PER_CORE = 4
#: Products of two vectors with lengths below this are exact in floating point, sums of their parts included.
EXACT = float(1 << 52)
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def whole_vectors(rows: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, label, x): components times ``scale``, rounded down; only rows that can take part.

    Rows with a null id, label or vector, or any null or non-finite component, take no part. Of rows that share an id, the one
    with the smallest label, then the smallest vector, counts. Components beyond 64 bits are the nearest 64-bit number.
    """
    number = F.transform("embedding", lambda x: x.cast("double"))
    fit = F.forall("v", lambda x: F.coalesce((F.abs(x) < float("inf")) & ~F.isnan(x), F.lit(False)))
    good = rows.filter("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL").select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), number.alias("v")).filter(fit)
    whole = good.select("vec_id", "label", F.transform("v", lambda x: F.floor(x * scale)).alias("x"))
    return whole.groupBy("vec_id").agg(F.min(F.struct("label", "x")).alias("row")).select("vec_id", "row.label", "row.x")


class Bucket:
    """Rows of like length: whole vectors, normalised ones, and every coordinate of these as a sorted list."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        self.ids, self.labels, self.vectors = ids, labels, vectors
        self.real = vectors.astype(np.float64)
        self.lengths = np.sqrt((self.real * self.real).sum(1))
        self.longest = float(self.lengths.max(initial=0.0))
        self.unit = self.real / np.where(self.lengths > 0, self.lengths, 1)[:, None]
        self.order = np.argsort(self.unit, axis=0)
        self.sorted = np.take_along_axis(self.unit, self.order, axis=0)

    def feasible(self, unit: np.ndarray, least: float, focus: int) -> np.ndarray | None:
        """Rows whose cosine with ``unit`` can be ``least`` (above 0) or more; None for all."""
        wide = np.arccos(min(least, 1.0))
        best, ranges = None, []
        for f in np.argsort(-np.abs(unit))[:focus]:
            angle = np.arccos(np.clip(unit[f], -1, 1))
            low = np.cos(min(np.pi, angle + wide)) - 1e-9
            high = np.cos(max(0.0, angle - wide)) + 1e-9
            a, b = np.searchsorted(self.sorted[:, f], low), np.searchsorted(self.sorted[:, f], high, "right")
            ranges.append((f, low, high))
            if best is None or b - a < best[2] - best[1]:
                best = (f, a, b)
        if best is None:
            return None
        rows = self.order[best[1] : best[2], best[0]]
        for f, low, high in ranges:
            if f != best[0]:
                at = self.unit[rows, f]
                rows = rows[(at >= low) & (at <= high)]
        return rows

    def scores(self, rows: np.ndarray | slice, vector: np.ndarray) -> np.ndarray:
        """Exact inner products; beyond 64 bits the nearest 64-bit number."""
        if self.longest * float(np.sqrt((vector.astype(float) ** 2).sum())) < EXACT:
            return (self.real[rows] @ vector.astype(np.float64)).astype(np.int64)
        exact = self.vectors[rows].astype(object) @ vector.astype(object)
        return np.array([min(max(int(s), LEAST), MOST) for s in exact], np.int64)


class Anchor:
    """An anchor with its questions: (name, low, high), each for the first ``k`` rows that score between low and high."""

    def __init__(self, key: int, label: int, vector: np.ndarray, questions: list[tuple[int, int, int]], k: int, same: bool):
        self.key, self.label, self.vector, self.k, self.same = key, label, vector, k, same
        self.length = float(np.sqrt((vector.astype(float) ** 2).sum()))
        self.unit = vector / self.length if self.length > 0 else vector.astype(float)
        self.questions = questions
        self.need = [low for _, low, _ in questions]
        self.found = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in questions]

    def meet(self, bucket: Bucket, focus: int) -> bool:
        """Take what the bucket has; False if no later, shorter, rows can matter."""
        need, bound = min(self.need), self.length * bucket.longest * (1 + 1e-9)
        if need > 0 and bound < need:
            return False
        rows = bucket.feasible(self.unit, need / bound, focus) if need > 0 else None
        if rows is None:
            rows = np.arange(len(bucket.ids))
        rows = rows[(bucket.labels[rows] == self.label) == self.same]
        rows = rows[bucket.ids[rows] != self.key]
        if len(rows):
            scores = bucket.scores(rows, self.vector)
            for i, (_, _, high) in enumerate(self.questions):
                self._keep(i, bucket.ids[rows], scores, (scores >= self.need[i]) & (scores <= high))
        return True

    def _keep(self, i: int, ids: np.ndarray, scores: np.ndarray, fit: np.ndarray) -> None:
        if fit.any():
            ids, scores = np.concatenate([self.found[i][0], ids[fit]]), np.concatenate([self.found[i][1], scores[fit]])
            first = np.lexsort((ids, -1 - scores))[: self.k]  # -1 - s, as -s of the least number is itself
            self.found[i] = ids[first], scores[first]
            if len(first) == self.k:
                self.need[i] = max(self.need[i], int(scores[first[-1]]))


def _search(cells: DataFrame, k: int, same: bool, bands: tuple[int, int] | None, bucket_rows: int, focus: int) -> DataFrame:
    """(anchor_id, question, base, vec_id, score) from rows (cell, kind, far, vec_id, label, x, asked): anchors first, then longest first.

    Without ``bands``, an anchor has one question for any score. With them, ``asked`` holds its (id, score) pairs, each a
    question for scores from bands[0] to bands[1] hundredths of that score.
    """

    def asked_of(asked: list[dict]) -> list[tuple[int, int, int, int]]:
        if bands is None:
            return [(0, LEAST, MOST, 0)]
        low, high = bands
        return [(a["vec_id"], -(-low * a["score"] // 100), high * a["score"] // 100, a["score"]) for a in asked
                if low * a["score"] <= high * a["score"]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, anchors, active, bases = None, [], [], {}
        ids: list[np.ndarray] = []
        labels: list[np.ndarray] = []
        vectors: list[np.ndarray] = []

        def bucket() -> None:
            nonlocal active, ids, labels, vectors
            if ids and active:
                wide = max(v.shape[1] for v in vectors)
                full = np.concatenate([np.pad(v, ((0, 0), (0, wide - v.shape[1]))) for v in vectors])
                longest = max(len(a.vector) for a in active)
                if longest > wide:
                    full = np.pad(full, ((0, 0), (0, longest - wide)))
                held = Bucket(np.concatenate(ids), np.concatenate(labels), full)
                for a in active:
                    if len(a.vector) < full.shape[1]:
                        a.vector, a.unit = (np.pad(v, (0, full.shape[1] - len(v))) for v in (a.vector, a.unit))
                active = [a for a in active if a.meet(held, focus)]
            ids, labels, vectors = [], [], []

        def answers() -> pa.RecordBatch:
            out = [(a.key, q[0], bases[a.key, q[0]], i, s) for a in anchors for q, (found, scores) in zip(a.questions, a.found, strict=True)
                   for i, s in zip(found.tolist(), scores.tolist(), strict=True)]
            return pa.RecordBatch.from_arrays(
                [pa.array([r[c] for r in out], pa.int64()) for c in range(5)], ["anchor_id", "question", "base", "vec_id", "score"])

        for batch in batches:
            cells_of = batch.column(0).to_numpy()
            kinds = batch.column(1).to_numpy()
            edge = [0, *(np.flatnonzero((cells_of[1:] != cells_of[:-1]) | (kinds[1:] != kinds[:-1])) + 1).tolist(), batch.num_rows]
            for a, b in zip(edge[:-1], edge[1:], strict=True):
                if a == b:
                    continue
                if cells_of[a] != cell:
                    bucket()
                    if anchors:
                        yield answers()
                    cell, anchors, active, bases = cells_of[a], [], [], {}
                part = batch.slice(a, b - a)
                if kinds[a] == 0:
                    for key, label, x, asked in zip(*(part.column(c).to_pylist() for c in (3, 4, 5, 6)), strict=True):
                        questions = asked_of(asked)
                        if questions:
                            anchors.append(Anchor(key, label, np.array(x, np.int64), [q[:3] for q in questions], k, same))
                            bases |= {(key, q[0]): q[3] for q in questions}
                    active = list(anchors)
                    continue
                at = 0
                while at < part.num_rows and active:
                    cut = part.slice(at, bucket_rows - sum(map(len, ids)))
                    at += cut.num_rows
                    ids.append(cut.column(3).to_numpy())
                    labels.append(cut.column(4).to_numpy())
                    vectors.append(_matrix(cut.column(5)))
                    if sum(map(len, ids)) >= bucket_rows:
                        bucket()
        bucket()
        if anchors:
            yield answers()

    return cells.mapInArrow(run, "anchor_id long, question long, base long, vec_id long, score long")


def _matrix(column: pa.Array) -> np.ndarray:
    """Lists of numbers as the rows of a matrix; shorter ones end in zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy().astype(np.int64)
    wide = int(sizes.max(initial=0))
    if (sizes == wide).all():
        return flat.reshape(len(sizes), wide)
    out = np.zeros((len(sizes), wide), np.int64)
    out[np.arange(wide)[None] < sizes[:, None]] = flat
    return out


def _first(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor_id", "question").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90,
                   bucket_rows: int = BUCKET_ROWS, block_anchors: int = BLOCK_ANCHORS, focus: int = FOCUS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score, from rows (vec_id, label, embedding).

    ``is_anchor`` is a condition on vec_id and label. Scores are inner products of whole vectors (see ``whole_vectors``, also for
    nulls and repeated rows; vectors of different lengths are filled up with zeros); higher ones come first, ties by
    smaller vec_id. An anchor's positives are its first ``positives`` other rows of its label. For each of them the first
    ``negatives`` rows of other labels follow that score from ``low`` to ``high`` hundredths of the positive's score; if there are
    none, no row is given. Other columns are not read. No rows in, no rows out.
    """
    squares = F.aggregate("x", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    vectors = materialize(whole_vectors(rows).withColumn("length", F.sqrt(squares)), "vectors")
    anchors = materialize(vectors.filter(is_anchor), "anchors")
    n_blocks = max(1, -(-anchors.count() // block_anchors))
    lanes = max(1, -(-CELLS_PER_CORE * vectors.sparkSession.sparkContext.defaultParallelism // n_blocks))
    some = "array<struct<vec_id: bigint, score: bigint>>"
    columns = ["kind", "far", "vec_id", "label", "x", "asked"]

    def cells(asking: DataFrame) -> DataFrame:
        block = F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks))
        ask = asking.select(
            F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane"), block.alias("block"), F.lit(0).alias("kind"),
            F.lit(0.0).alias("far"), "vec_id", "label", "x", "asked")
        # Every row visits every block of queries once.
        row = vectors.select(
            F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(lanes)).cast("int").alias("lane"),
            F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))).alias("block"), F.lit(1).alias("kind"),
            (-F.col("length")).alias("far"), "vec_id", "label", "x", F.lit(None).cast(some).alias("asked"))
        both = ask.unionByName(row).withColumn("cell", F.col("block") * lanes + F.col("lane")).select("cell", *columns)
        return both.repartition("cell").sortWithinPartitions("cell", "kind", "far", "vec_id")

    plain = anchors.withColumn("asked", F.lit(None).cast(some))
    near = _first(_search(cells(plain), positives, True, None, bucket_rows, focus), positives)
    asked = near.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.collect_list(F.struct("vec_id", "score")).alias("asked"))
    asking = materialize(anchors.join(asked, "vec_id"), "asking")
    found = _first(_search(cells(asking), negatives, False, (low, high), bucket_rows, focus), negatives)
    return found.select(
        "anchor_id", F.col("question").alias("positive_id"), "rank", F.col("vec_id").alias("negative_id"),
        F.col("base").alias("positive_score"), F.col("score").alias("negative_score"))
