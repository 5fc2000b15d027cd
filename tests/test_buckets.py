"""The look inside the buckets of the band table: one dense product per bucket, vectors as bytes."""

import numpy as np
import pyarrow as pa
import pytest

from catalens.operators import lsh
from test_postings import brute, sparse, table


@pytest.mark.parametrize("kind,scale", [(np.float32, 1), (np.float64, 1), (np.float64, 0.37)])
def test_within_buckets(kind, scale):
    """Buckets of one row, of fewer than are kept, and larger ones; a batch may be a slice of another."""
    frame = sparse(90, 300, 8)
    frame["weights"] = [w * scale for w in frame["weights"]]
    frame["norm2"] = [(w * w).sum() for w in frame["weights"]]
    kinds = np.dtype(np.uint16), np.dtype(np.uint8 if scale == 1 else np.float64)
    bucket = np.sort(np.random.default_rng(1).integers(-3, 4, len(frame)) ** 3)
    bucket[0] = -100
    batch = pa.RecordBatch.from_arrays([
        pa.array(bucket), pa.array(frame["no"].to_numpy() + 7),
        *(pa.array([x.astype(k).tobytes() for x in frame[c]], pa.binary()) for c, k in zip(("terms", "weights"), kinds)),
        pa.array(frame["norm2"].to_numpy())], ["bucket", "no", "terms", "weights", "norm2"])
    for start in (0, 20):
        got = lsh._within(batch.slice(start), 300, kinds, kind, 4).to_pydict()
        want = set()
        for number in set(bucket[start:].tolist()):
            inside = frame.iloc[start:][bucket[start:] == number]
            want |= {(a + 7, b + 7, s) for a, b, s in brute(inside, inside, 4)}
        got = set(zip(got["no"], got["near"], got["score"]))
        if scale == 1:
            assert got == want
        else:
            assert {x[0] for x in got} == {x[0] for x in want} and len(got) == len(want)
            assert sorted(s for *_, s in got) == pytest.approx(sorted(s for *_, s in want), abs=1e-12)
    assert lsh._within(batch.slice(0, 0), 300, kinds, kind, 4).num_rows == 0


def test_vectors_as_bytes(spark):
    """A term took twelve bytes on its way to every bucket before."""
    frame = sparse(50, 300, 9)
    kinds = np.dtype(np.uint16), np.dtype(np.uint8)
    rows = {r["no"]: r for r in lsh._in_bytes(table(spark, frame), kinds).collect()}
    for r in frame.itertuples():
        assert np.frombuffer(rows[r.no]["terms"], np.uint16).tolist() == r.terms.tolist()
        assert np.frombuffer(rows[r.no]["weights"], np.uint8).tolist() == r.weights.tolist()
        assert rows[r.no]["norm2"] == r.norm2


def test_buckets_go_on_in_the_next_batch(spark):
    """Small Arrow batches give the same rows."""
    vectors = table(spark, sparse(200, 100, 10)).withColumnRenamed("no", "id")
    whole = sorted(map(tuple, lsh.similar_lsh(vectors, ["id"], 3, bands=4, bucket_rows=30).collect()))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        again = sorted(map(tuple, lsh.similar_lsh(vectors, ["id"], 3, bands=4, bucket_rows=30).collect()))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert whole and again == whole
