"""Blocks of whole texts, and questions that all blocks put to the corpus together.

A block is a row with some MB of texts, compressed, written once to the shared folder. A question is a set of 64-bit keys
per block. Keys are dealt to buckets by their leading bits; one task sees every block's sorted keys of a bucket, merges them
and sends each block one small answer per key. So what is asked and answered shrinks to the distinct keys of a block,
the keys of all blocks meet without a row for each, and a key that every text has is still asked once per block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalens.llm.texts import id_text
from catalens.session import materialize

#: Bytes of text in a block; a longer text is a block of its own. More on larger executors: answers are kept per block.
BLOCK_BYTES = 8 << 20
#: Bytes of text for which there is a bucket.
BUCKET_BYTES = 8 << 20


def squeeze(x: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x).tobytes())


def expand(data: bytes, dtype) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype)


def pack(docs: DataFrame, label: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(block, ids, sizes, data), stored: the texts of the rows in reading order; a null text is an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        ids, texts, total, made = [], [], 0, 0
        base = TaskContext.get().partitionId() << 32

        def block():
            nonlocal ids, texts, total, made
            data = zstandard.ZstdCompressor(level=3).compress(b"".join(texts))
            out = pa.RecordBatch.from_pydict({
                "block": pa.array([base + made], pa.int64()), "ids": pa.array([ids], pa.list_(pa.int64())),
                "sizes": pa.array([[len(t) for t in texts]], pa.list_(pa.int64())), "data": pa.array([data], pa.binary())})
            ids, texts, total, made = [], [], 0, made + 1
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = text.as_py().encode()
                if texts and total + len(data) > block_bytes:
                    yield block()
                ids.append(doc_id)
                texts.append(data)
                total += len(data)
        if texts:
            yield block()

    return materialize(id_text(docs).mapInArrow(run, "block long, ids array<long>, sizes array<long>, data binary"), label)


def unpack(sizes, data: bytes) -> list[bytes]:
    import zstandard

    flat = zstandard.ZstdDecompressor().decompress(data) if len(sizes) else b""
    ends = np.cumsum(np.asarray(sizes, np.int64))
    return [flat[e - n : e] for e, n in zip(ends.tolist(), sizes, strict=True)]


def bucket_bits(blocks: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> int:
    """So that a bucket has the keys of about ``bucket_bytes`` of text, whatever the size of the corpus."""
    total = blocks.select(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    return min(20, max(4, int(total // bucket_bytes).bit_length()))


def ask(blocks: DataFrame, keys_of: Callable[[dict], tuple[np.ndarray, np.ndarray]], bits: int, key_bytes: int = 4) -> DataFrame:
    """(bucket, block, keys, counts): the questions of all blocks; store them if they are put more than once.

    ``keys_of(block row)`` gives sorted distinct 64-bit keys and a count for each. The leading ``bits`` say the bucket; of the
    rest, the next 32 bits go along, or with ``key_bytes`` 8 all of them.
    """

    def questions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                keys, counts = keys_of(row)
                ends = np.searchsorted(keys >> np.uint64(64 - bits), np.arange((1 << bits) + 1))
                out = {"bucket": [], "block": [], "keys": [], "counts": []}
                for k in np.flatnonzero(np.diff(ends)):
                    own = keys[ends[k] : ends[k + 1]]
                    if key_bytes == 4:
                        own = ((own >> np.uint64(32 - bits)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                    gaps = np.diff(own, prepend=own.dtype.type(0))
                    out["bucket"].append(int(k))
                    out["block"].append(row["block"])
                    out["keys"].append(squeeze(gaps.view(np.uint8).reshape(-1, key_bytes).T))
                    out["counts"].append(squeeze(counts[ends[k] : ends[k + 1]]))
                yield pa.RecordBatch.from_pydict({
                    "bucket": pa.array(out["bucket"], pa.int32()), "block": pa.array(out["block"], pa.int64()),
                    "keys": pa.array(out["keys"], pa.binary()), "counts": pa.array(out["counts"], pa.binary())})

    return blocks.mapInArrow(questions, "bucket int, block long, keys binary, counts binary")


class Bucket:
    """The questions of all blocks in one bucket, merged: distinct keys and the sum of their counts."""

    def __init__(self, part: pd.DataFrame, count_type, key_bytes: int = 4):
        kind, lists = (np.uint32 if key_bytes == 4 else np.uint64), []
        for data in part["keys"]:
            planes = expand(data, np.uint8).reshape(key_bytes, -1)
            lists.append(np.cumsum(np.ascontiguousarray(planes.T).view(kind)[:, 0], dtype=kind))
        self.part, self.sizes = part, [len(x) for x in lists]
        all_keys = np.concatenate(lists)
        del lists
        counts = np.concatenate([expand(c, count_type) for c in part["counts"]]).astype(np.int64)
        self.order = np.argsort(all_keys, kind="stable")
        ranked = all_keys[self.order]
        self.first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
        self.keys, self.total = ranked[self.first], np.add.reduceat(counts[self.order], self.first)
        self.order = self.order.astype(np.uint32)

    def answers(self, said: np.ndarray) -> pd.DataFrame:
        """One answer per distinct key, as rows (block, bucket, answer) in the order in which the blocks asked."""
        out = np.empty(len(self.order), said.dtype)
        out[self.order] = np.repeat(said, np.diff(self.first, append=len(self.order)))
        cut = np.split(out, np.cumsum(self.sizes)[:-1])
        return pd.DataFrame({"block": self.part["block"], "bucket": self.part["bucket"], "answer": [squeeze(x) for x in cut]})


ANSWER = "block long, bucket int, answer binary"


def answered(blocks: DataFrame, answers: DataFrame, name: str = "answers") -> DataFrame:
    """Blocks with the answers to their questions, in order of bucket."""
    own = answers.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("bucket", "answer"))).alias("all"))
    return blocks.join(own.select("block", F.col("all.answer").alias(name)), "block", "left")


def answers_of(row: dict, dtype=np.uint8, name: str = "answers") -> np.ndarray:
    return np.concatenate([np.zeros(0, dtype), *(expand(a, dtype) for a in row[name] or ())])
