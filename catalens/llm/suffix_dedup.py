"""Repeated passages by merged Burrows-Wheeler transforms.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts in a document with a smaller id. The suffixes that
matter are few, and those that may be equal are brought together exactly:

* Every window of LENGTH bytes has an anchor, the ``GRAM`` bytes in it with the least hash (the leftmost, if several). Equal
  windows have equal anchors, so only anchors that the corpus holds twice matter. All blocks ask for theirs at once.
* Neighbouring windows with one anchor make a segment of less than 2 * LENGTH bytes. Each block sends its distinct segments
  with such an anchor, and the smallest id of each, to the bucket of the anchor. Equal windows meet there, and a passage
  that every document holds comes once from each block.
* A segment that is the only one of its bucket with its anchor has no window that comes twice. A bucket cuts the others into shards, builds the transform of each, and merges them by refining their interleave: one
  round goes from the order by the first h bytes to that by h + 1, reading the transforms along their last-to-first maps
  and dealing the suffixes out by the byte before them, stably. No suffix is sorted again. A suffix leaves its neighbour's
  interval in the round that reaches their common prefix, and takes no more part once it is alone; those still together after
  LENGTH rounds are a repeat. Only
  suffixes from which a window can be reached in the rounds left take part.
* The smallest id in an interval says which of its windows are removed; each block gets a bit for every window it sent.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalens.llm.blocks import (
    ANSWER, BLOCK_BYTES, BUCKET_BYTES, Bucket, answered, answers_of, ask, bucket_bits, expand, pack, squeeze, unpack,
)
from catalens.llm.words import BYTE_VALUES, distinct, mix, powers, slices
from catalens.session import materialize

LENGTH = 50
#: Bytes of an anchor; chance repeats of so many bytes are rare, and a window still has a choice of 31.
GRAM = 20
#: Bytes of text whose segments are found at once; small, so that the arrays stay in the processor's cache.
SLICE = 1 << 18
#: Bytes of segments whose transform is built at once.
SHARD_BYTES = 1 << 20
#: Stands for a missing id, after all others.
LAST = (1 << 63) - 1
_U = np.uint64


def segments(texts: list[bytes], length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text, begin, windows, anchor hash) of every segment, in order; ``begin`` counts bytes from the start of its text."""
    sizes = np.array([len(t) for t in texts], np.int64)
    flat = np.frombuffer(b"".join(texts), np.uint8)
    total, choice = len(flat), length - gram + 1
    if total < length:
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(_U)
    h = np.zeros(total + 1, _U)
    np.cumsum(BYTE_VALUES[flat] * powers(total)[0], out=h[1:])
    value = mix((h[gram:] - h[:-gram]) * powers(total + 1)[1][: total - gram + 1])
    least = (value >> _U(32) << _U(32)) | np.arange(len(value), dtype=_U)  # ties: the leftmost
    width = 1
    while 2 * width <= choice:
        least = np.minimum(least[: len(least) - width], least[width:])
        width *= 2
    windows = total - length + 1
    least = np.minimum(least[:windows], least[choice - width : choice - width + windows])
    anchor = (least & _U(0xFFFFFFFF)).astype(np.int64)
    ends = np.cumsum(sizes)
    doc = np.searchsorted(ends, np.arange(windows), "right")
    inside = np.arange(windows) + length <= ends[doc]
    new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1]) | ~inside[:-1]]) & inside
    begin = np.flatnonzero(new)
    # Windows of a text that its segments leave out come only at its end, so a segment lasts to the next or to the end.
    stop = np.minimum(np.concatenate([begin[1:], [windows]]), (ends - length + 1)[doc[begin]])
    own = mix(value[anchor[begin]] + _U(1))  # least hashes share their leading bits; spread them again
    return doc[begin], begin - (ends - sizes)[doc[begin]], stop - begin, own


def _segments(texts: list[bytes], length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text, begin, windows, anchor) of all texts of a block."""
    parts = [segments([], length, gram)]
    for a, b in slices([len(t) for t in texts], SLICE):
        doc, begin, windows, anchor = segments(texts[a:b], length, gram)
        parts.append(((doc + a).astype(np.int32), begin.astype(np.int32), windows.astype(np.int32), anchor))
    return tuple(map(np.concatenate, zip(*parts, strict=True)))


def _anchor_keys(doc: np.ndarray, anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct anchors of a block and in how many of its documents they are, up to 255."""
    order = np.lexsort((doc, anchor))
    doc, anchor = doc[order], anchor[order]
    new = np.concatenate([[True], anchor[1:] != anchor[:-1]])[: len(anchor)]
    first = np.flatnonzero(new)
    other = new | np.concatenate([[True], doc[1:] != doc[:-1]])[: len(anchor)]
    counts = np.add.reduceat(other.astype(np.int64), first) if len(first) else first
    return anchor[first], np.minimum(counts, 255).astype(np.uint8)


QUESTION = "bucket int, block long, strings binary, sizes binary, least binary, kept binary"


def _questions(batches: Iterator[pa.RecordBatch], bits: int, length: int, gram: int) -> Iterator[pa.RecordBatch]:
    """Each block's distinct segments with a repeated anchor by bucket, and a row (bucket -1) of where it has them."""
    for batch in batches:
        for row in batch.to_pylist():
            ids = np.array([LAST if i is None else i for i in row["ids"]], np.int64)
            texts = unpack(row["sizes"], row["data"])
            doc, begin, windows, anchor = _segments(texts, length, gram)
            keys, repeated = distinct(anchor), answers_of(row)
            hit = np.flatnonzero(repeated[np.searchsorted(keys, anchor)]) if len(keys) else np.zeros(0, np.int64)
            doc, begin, windows = doc[hit].astype(np.int64), begin[hit].astype(np.int64), windows[hit].astype(np.int64)
            bucket = (anchor[hit] >> _U(64 - bits)).astype(np.int64)
            del keys, repeated, anchor
            known: list[dict] = [{} for _ in range(1 << bits)]
            least: list[list] = [[] for _ in known]
            number = np.empty(len(hit), np.int64)
            spots = zip(doc.tolist(), begin.tolist(), (begin + windows + length - 1).tolist(), bucket.tolist(),
                        ids[doc].tolist(), strict=True)
            for i, (d, a, b, k, own) in enumerate(spots):
                number[i] = n = known[k].setdefault(texts[d][a:b], len(known[k]))
                if n == len(least[k]):
                    least[k].append(own)
                elif own < least[k][n]:
                    least[k][n] = own
            place = (np.cumsum(row["sizes"]) - row["sizes"])[doc] + begin
            out = {name.split()[0]: [] for name in QUESTION.split(", ")}
            for k, strings in enumerate(known):
                if strings:
                    values = (k, row["block"], squeeze(np.frombuffer(b"".join(strings), np.uint8)),
                              squeeze(np.array([len(s) for s in strings], np.uint8)), squeeze(np.array(least[k], np.int64)), None)
                    for name, x in zip(out, values, strict=True):
                        out[name].append(x)
            first = np.fromiter((least[k][n] for k, n in zip(bucket.tolist(), number.tolist(), strict=True)), np.int64, len(bucket))
            kept = np.stack([np.diff(place, prepend=0), windows, bucket, number]).astype(np.uint32)
            for name, x in zip(out, (-1, row["block"], None, None, squeeze(first == ids[doc]), squeeze(kept)), strict=True):
                out[name].append(x)
            yield pa.RecordBatch.from_pydict({
                "bucket": pa.array(out["bucket"], pa.int32()), "block": pa.array(out["block"], pa.int64()),
                **{k: pa.array(out[k], pa.binary()) for k in ("strings", "sizes", "least", "kept")}})


class Transform:
    """Burrows-Wheeler transform of the strings of a shard, each ended by 0 and its bytes raised by one."""

    def __init__(self, text: np.ndarray):
        n = len(text)
        order, rank = self._suffixes(text)
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        first = np.concatenate([[True], text[:-1] == 0])  # of a string; nothing stands before it
        before = np.where(first, 0, np.concatenate([text[:1], text[:-1]]))
        self.place = place
        self.bwt = before[order]
        self.to_first = place[np.where(first, np.arange(n), np.arange(n) - 1)][order]

    @staticmethod
    def _suffixes(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffixes in order, equal ones in order of place: by eight bytes, then twice as many among those still equal."""
        n = len(text)
        padded = np.concatenate([text, np.zeros(8, np.uint8)])
        key, alive = np.zeros(n, _U), np.ones(n, bool)
        for k in range(8):
            byte = np.where(alive, padded[k : k + n], 0).astype(np.uint8)
            key = key << _U(8) | byte
            alive &= byte > 0
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        start = np.concatenate([[True], ranked[1:] != ranked[:-1]])
        group = np.maximum.accumulate(np.where(start, np.arange(n), 0))
        rank = np.empty(n, np.int64)
        rank[order] = group
        depth, slots = 8, np.arange(n)
        while True:
            # Slots of groups of several suffixes that go on beyond ``depth`` bytes.
            several = ~(start & np.concatenate([start[1:], [True]])) & alive[order[slots]]
            slots = slots[several]
            if not len(slots):
                return order, rank
            who = order[slots]
            both = rank[who] << 32 | rank[who + depth]
            by = np.argsort(both, kind="stable")
            who, both = who[by], both[by]
            order[slots] = who
            start = np.concatenate([[True], both[1:] != both[:-1]])
            rank[who] = slots[np.maximum.accumulate(np.where(start, np.arange(len(who)), 0))]
            alive[who] &= alive[who + depth]  # ended within the next stretch: nothing left to compare
            depth *= 2


def repeats(strings: list[bytes], least: np.ndarray, length: int, shard_bytes: int) -> np.ndarray:
    """For every window of every string, in order, the smallest id of its interval in the merged transforms."""
    size = np.array([len(s) for s in strings], np.int64)
    windows = size - length + 1
    bwt, to_first, at, offset = [], [], [], 0
    for a, b in slices(size.tolist(), shard_bytes):
        text = np.frombuffer(b"\xff".join([*strings[a:b], b""]), np.uint8) + np.uint8(1)  # 255, never in UTF-8, becomes 0
        shard = Transform(text)
        bwt.append(shard.bwt)
        to_first.append((shard.to_first + offset).astype(np.int32))
        # The suffix that comes ``length`` bytes after the start of each window.
        begin = np.cumsum(size[a:b] + 1) - size[a:b] - 1
        w = windows[a:b]
        spot = np.repeat(begin - np.cumsum(w) + w, w) + np.arange(w.sum()) + length
        at.append((shard.place[spot] + offset).astype(np.int32))
        offset += len(text)
    bwt, to_first = np.concatenate(bwt), np.concatenate(to_first)
    window = np.argsort(np.concatenate(at), kind="stable").astype(np.int32)  # each shard in its own order, one after the other
    place = np.concatenate(at)[window]
    interval = np.zeros(len(place), np.int32)
    out = np.repeat(least, windows)
    for _ in range(length):
        if not len(window):
            return out
        byte = bwt[place]
        deal = np.argsort(byte, kind="stable").astype(np.int32)
        byte, interval = byte[deal], interval[deal]
        place, window = to_first[place[deal]], window[deal]
        new = np.concatenate([[True], (byte[1:] != byte[:-1]) | (interval[1:] != interval[:-1])])
        interval = np.cumsum(new, dtype=np.int32)
        # Alone in its interval, a window has no equal; it keeps its own id and takes no part in later rounds.
        several = ~(new & np.concatenate([new[1:], [True]]))
        if 4 * np.count_nonzero(several) < 3 * len(several):
            place, window, interval, new = place[several], window[several], interval[several], new[several]
    start = np.flatnonzero(new)
    if len(start):
        out[window] = np.repeat(np.minimum.reduceat(out[window], start), np.diff(start, append=len(window)))
    return out


def shared(strings: list[bytes], length: int, gram: int) -> np.ndarray:
    """Which of these different segments have the anchor of another; no window of the others comes twice."""
    _, number, count = np.unique(_segments(strings, length, gram)[3], return_inverse=True, return_counts=True)
    return count[number] > 1


def _merge(part: pd.DataFrame, length: int, gram: int, shard_bytes: int) -> pd.DataFrame:
    """For each block and segment a bit for every window that also starts in a document before all of the block's."""
    known, numbers, least = {}, [], []
    for strings, sizes, own in zip(part["strings"], part["sizes"], part["least"], strict=True):
        data, ends = expand(strings, np.uint8).tobytes(), np.cumsum(expand(sizes, np.uint8), dtype=np.int64).tolist()
        numbers.append(np.array([known.setdefault(data[a:b], len(known)) for a, b in zip([0, *ends], ends)], np.int64))
        least.append(expand(own, np.int64))
    smallest = np.full(len(known), LAST, np.int64)
    np.minimum.at(smallest, np.concatenate(numbers), np.concatenate(least))
    strings = list(known)
    windows = np.array([len(s) for s in strings], np.int64) - length + 1
    flat, begin = np.repeat(smallest, windows), np.cumsum(windows) - windows
    among = shared(strings, length, gram)
    if among.any():
        some = [strings[i] for i in np.flatnonzero(among)]
        flat[np.repeat(among, windows)] = repeats(some, smallest[among], length, shard_bytes)
    answers = []
    for number, own in zip(numbers, least, strict=True):
        w = windows[number]
        nth = np.arange(w.sum()) - np.repeat(np.cumsum(w) - w, w)
        earlier = flat[np.repeat(begin[number], w) + nth] < np.repeat(own, w)
        bits = np.add.reduceat(earlier.astype(np.uint32) << nth.astype(np.uint32), np.cumsum(w) - w, dtype=np.uint32)
        answers.append(squeeze(bits))
    return pd.DataFrame({"block": part["block"], "bucket": part["bucket"], "answer": answers})


def _removed(row: dict, length: int, gram: int) -> np.ndarray:
    """Which bytes of a block's joined texts go."""
    gap, windows, bucket, number = expand(row["kept"], np.uint32).reshape(4, -1).astype(np.int64)
    place, distinct = np.cumsum(gap), np.zeros(bucket.max(initial=-1) + 1, np.int64)
    np.maximum.at(distinct, bucket, number + 1)
    said = answers_of(row, np.uint32)[(np.cumsum(distinct) - distinct)[bucket] + number]
    # A document after the first one of its block with a segment loses all its windows; the first loses what the bucket says.
    said = np.where(expand(row["own"], bool), said, np.uint32(0xFFFFFFFF))
    start = np.zeros(sum(row["sizes"]) + 1, np.int32)
    for k in range(length - gram + 1):
        start[place[(windows > k) & ((said >> np.uint32(k)) & np.uint32(1) > 0)] + k] = 1
    before = np.cumsum(start[:-1], dtype=np.int32)
    before[length:] -= before[:-length].copy()
    return before > 0


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text binary, spans array<long>"


def _results(batches: Iterator[pa.RecordBatch], length: int, gram: int, whole: bool) -> Iterator[pa.RecordBatch]:
    names = {"doc_id": pa.int64(), "n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string()}
    names |= {"kept_text": pa.binary(), "spans": pa.list_(pa.int64())} if whole else {}
    for batch in batches:
        for row in batch.to_pylist():
            gone, at, out = _removed(row, length, gram), 0, {k: [] for k in names}
            for doc_id, text in zip(row["ids"], unpack(row["sizes"], row["data"]), strict=True):
                mask = gone[at : at + len(text)]
                at += len(text)
                edges = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]])))
                kept = np.frombuffer(text, np.uint8)[~mask].tobytes() if len(edges) else text
                values = (doc_id, len(text), len(text) - len(kept), len(edges) // 2, hashlib.sha256(kept).hexdigest(), kept, edges)
                for name, x in zip(out, values, strict=False):
                    out[name].append(x)
            yield pa.RecordBatch.from_pydict({k: pa.array(out[k], kind) for k, kind in names.items()})


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, block_bytes: int = BLOCK_BYTES,
                   bucket_bytes: int = BUCKET_BYTES, shard_bytes: int = SHARD_BYTES, whole: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row; ``whole`` adds kept_text and spans (begin, end, …).

    A null text is an empty one. Texts shorter than ``length`` lose nothing. Rows with the same id lose nothing to each other,
    nor do rows without id, which come after all others. Long texts are taken whole; other columns are not read.
    """
    if not gram < length or length - gram + 1 > 32 or 2 * length > 255:
        raise ValueError("an anchor is shorter than a window by 31 bytes at most, and a window has at most 127 bytes")
    packed = pack(docs, "passage-blocks", block_bytes)
    bits = bucket_bits(packed, bucket_bytes)

    def twice(part: pd.DataFrame) -> pd.DataFrame:
        bucket = Bucket(part, np.uint8)
        return bucket.answers((bucket.total > 1).astype(np.uint8))

    def anchor_keys(row: dict) -> tuple[np.ndarray, np.ndarray]:
        doc, _, _, anchor = _segments(unpack(row["sizes"], row["data"]), length, gram)
        return _anchor_keys(doc, anchor)

    anchors = ask(packed, anchor_keys, bits).groupBy("bucket").applyInPandas(twice, ANSWER)
    asked = materialize(
        answered(packed, anchors).mapInArrow(lambda x: _questions(x, bits, length, gram), QUESTION), "segments")
    own = asked.filter("bucket < 0").select("block", "kept", F.col("least").alias("own"))
    said = asked.filter("bucket >= 0").groupBy("bucket").applyInPandas(lambda part: _merge(part, length, gram, shard_bytes), ANSWER)
    schema = RESULT if whole else RESULT[: RESULT.index(", kept_text")]
    return answered(packed.join(own, "block"), said).mapInArrow(lambda x: _results(x, length, gram, whole), schema)
