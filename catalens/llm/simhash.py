"""Near copies by 64-bit fingerprints that differ in few bits, met at the anchors of a covering code.

A fingerprint bit is set if more than half of the hashes of a text's shingles have it. Anchors are the words of a code that
covers all 64-bit numbers: bits 0 to 22 and 23 to 45 each belong to a binary Golay code of length 23, whose words are within 3
bits of everything, and the other 18 bits to the code of the zero word alone. So no number is further than 3 + 3 + 18 = 24 bits
from its nearest anchor, its home.

Two fingerprints a threshold apart have a number between them, at most half of the threshold (rounded down) from one and the
rest from the other; both go to that number's home. So a fingerprint is copied to the homes of all numbers within the larger
share, all of them within the covering radius plus the threshold of it, and is marked as near where the smaller share
suffices. Per anchor every near fingerprint is compared with all others. At a threshold of 3 that makes about 61 copies, some
10 of them near, whatever the size of the corpus, over 2^24 anchors.

Anchors with very many near fingerprints are cut into parts; every part sees all that came to the anchor. Tasks pass
on a forest of the links they find, never the pairs of a group.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalens.llm.groups import HOT_SHARE, components, join_groups
from catalens.llm.texts import id_text
from catalens.llm.words import slices
from catalens.session import materialize

WORDS, DIFFERENT, SEED = 3, 3, 42
#: Near fingerprints of an anchor that one part of it holds.
PART = 2_048
#: Bytes of text, shingles, pairs and links that a task holds at once.
SLICE_BYTES, SLICE_SHINGLES, SLICE_PAIRS, SLICE_LINKS = 1 << 20, 1 << 17, 1 << 20, 1 << 20

# The binary Golay code has length 23 and this generator polynomial; its words are all 3-bit balls apart.
LENGTH, CHECK_BITS, GENERATOR, RADIUS = 23, 11, 0b110001110101, 3
_U = np.uint64


def fingerprint(words: list[bytes], n_words: int = WORDS) -> int:
    """Majority of the bits of all shingles' hashes; no words give zero, fewer than ``n_words`` one shingle."""
    import xxhash

    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    starts, ends = starts[: max(1, len(words) - n_words + 1)].tolist(), ends[min(n_words, len(words)) - 1 :].tolist()
    count = np.zeros(64, np.int64)
    for at in range(0, len(starts), SLICE_SHINGLES):
        cut = zip(starts[at : at + SLICE_SHINGLES], ends[at : at + SLICE_SHINGLES], strict=True)
        hashes = np.array([xxhash.xxh64_intdigest(joined[s:e], SEED) for s, e in cut], "<u8")
        count += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * count > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, n_words: int = WORDS) -> DataFrame:
    """(doc_id, fp): fp holds the 64 bits as a signed number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lower = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
        for batch in batches:
            sizes = pc.binary_length(batch.column(1)).to_pylist()
            for a, b in slices(sizes, SLICE_BYTES):
                texts = batch.column(1).slice(a, b - a)
                # Splitting bytes without an argument splits at space and the controls 9 to 13.
                found = [fingerprint(t.as_py().encode().translate(lower).split(), n_words) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(np.array(found, np.uint64).view(np.int64))], ["doc_id", "fp"])

    return id_text(docs).mapInArrow(run, "doc_id long, fp long")


def _syndromes(patterns: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit patterns by the generator polynomial."""
    rest = patterns.astype(np.int64)
    for k in range(LENGTH - 1, CHECK_BITS - 1, -1):
        rest = np.where(rest >> k & 1, rest ^ (GENERATOR << (k - CHECK_BITS)), rest)
    return rest


def _flips(most: int) -> tuple[np.ndarray, np.ndarray]:
    """All patterns of at most ``most`` of 23 bits, with their weights, lightest first."""
    found = [(sum(1 << i for i in bits), n) for n in range(most + 1) for bits in combinations(range(LENGTH), n)]
    return np.array([f for f, _ in found], np.int64), np.array([n for _, n in found], np.int64)


@lru_cache(maxsize=4)
def _reach(most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What turns a 23-bit number of each syndrome into the code words it reaches as homes after n flips and no fewer.

    (offsets, first, count): count[n, syndrome] offsets begin at first[n, syndrome].
    """
    patterns, _ = _flips(RADIUS)
    leader = np.zeros(1 << CHECK_BITS, np.int64)
    leader[_syndromes(patterns)] = patterns
    flips, weight = _flips(most)
    syndrome = np.arange(1 << CHECK_BITS)[:, None]
    offset = flips[None] ^ leader[syndrome ^ _syndromes(flips)[None]]
    _, at = np.unique(((syndrome << LENGTH) | offset).ravel(), return_index=True)  # the first, so the lightest, of equals
    row, level = at // len(flips), weight[at % len(flips)]
    order = np.lexsort((row, level))
    count = np.zeros((most + 1, 1 << CHECK_BITS), np.int64)
    np.add.at(count, (level, row), 1)
    first = np.concatenate([[0], np.cumsum(count.ravel())[:-1]]).reshape(count.shape)
    return offset.ravel()[at][order], first, count


def anchors(fps: np.ndarray, differ: int = DIFFERENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index, anchor, near): the anchors that each of the 64-bit numbers is copied to."""
    less, more = differ // 2, differ - differ // 2
    offsets, first, count = _reach(more)
    mask = _U((1 << LENGTH) - 1)
    low, high = (fps & mask).astype(np.int64), (fps >> _U(LENGTH) & mask).astype(np.int64)
    s_low, s_high = _syndromes(low), _syndromes(high)
    parts = []
    for i in range(more + 1):
        for j in range(more + 1 - i):
            wide = count[j, s_high]
            copies = count[i, s_low] * wide
            row = np.repeat(np.arange(len(fps)), copies)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(copies) - copies, copies)
            a, b = np.divmod(nth, np.maximum(wide[row], 1))
            one = low[row] ^ offsets[first[i, s_low[row]] + a]
            two = high[row] ^ offsets[first[j, s_high[row]] + b]
            # The leading 12 bits tell code words apart.
            anchor = (one >> CHECK_BITS) << (LENGTH - CHECK_BITS) | (two >> CHECK_BITS)
            parts.append((row, anchor, np.full(len(row), i + j <= less)))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _visits(fps: DataFrame, differ: int, near_only: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy().view(np.uint64)
            for at in range(0, len(values), 2_000):
                part = values[at : at + 2_000]
                row, anchor, near = anchors(part, differ)
                if near_only:
                    row, anchor, near = row[near], anchor[near], near[near]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor.astype(np.int32)), pa.array(near), pa.array(part[row].view(np.int64))], ["anchor", "near", "fp"])

    return fps.select("fp").mapInArrow(run, "anchor int, near boolean, fp long")


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fewer links that tie together the same nodes: each node with the smallest of its component."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    top = np.arange(len(nodes))
    while (differ := top[x] != top[y]).any():
        x, y = x[differ], y[differ]
        low = np.minimum(top[x], top[y])
        np.minimum.at(top, top[x], low)
        np.minimum.at(top, top[y], low)
        while (top[top] != top).any():
            top = top[top]
    own = top != np.arange(len(nodes))
    return nodes[own], nodes[top[own]]


def _compare(batches: Iterator[pa.RecordBatch], differ: int) -> Iterator[pa.RecordBatch]:
    """Links between fingerprints of one (anchor, part); the rows come group by group, the near ones first.

    A group that goes on in the next batch is continued with its near rows, which PART bounds.
    """
    found: list[tuple[np.ndarray, np.ndarray]] = []
    held, last = np.zeros(0, _U), None

    def batch_of(pairs):
        a, b = forest(*(np.concatenate(x) for x in zip(*pairs, strict=True)))
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy().astype(np.int64) << 32 | batch.column(1).to_numpy()
        near = batch.column(2).to_numpy(zero_copy_only=False)
        fps = batch.column(3).to_numpy().view(_U)
        if key[0] == last:
            key = np.concatenate([np.full(len(held), last), key])
            near, fps = np.concatenate([np.ones(len(held), bool), near]), np.concatenate([held, fps])
        new = np.concatenate([[True], key[1:] != key[:-1]])
        begin = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        n_near = np.add.reduceat(near.astype(np.int64), begin)
        partners = np.minimum(np.arange(len(key)) - begin[group], n_near[group])
        ends = np.cumsum(partners)
        at = 0
        while at < len(key):
            until = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE_PAIRS, "right")))
            many = partners[at:until]
            row = np.repeat(np.arange(at, until), many)
            other = begin[group[row]] + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
            hit = np.bitwise_count(fps[row] ^ fps[other]) <= differ
            hit &= fps[row] != fps[other]
            if hit.any():
                found.append((fps[row[hit]], fps[other[hit]]))
            if sum(len(x) for x, _ in found) > SLICE_LINKS:
                found = [forest(*(np.concatenate(x) for x in zip(*found, strict=True)))]
                if len(found[0][0]) > SLICE_LINKS // 2:
                    yield batch_of(found)
                    found = []
            at = until
        last = key[-1]
        held = fps[begin[-1] : begin[-1] + n_near[-1]].copy()
    if found:
        yield batch_of(found)


def links(fps: DataFrame, n_fps: int, differ: int = DIFFERENT, part: int = PART) -> DataFrame:
    """Edges (a, b) that tie together all of the distinct ``fps`` that chains of at most ``differ`` bits connect."""
    if not 0 <= differ <= 6:
        raise ValueError("differ is 0 to 6: the number of copies grows with its power")
    crowd = max(part, int(n_fps * HOT_SHARE))
    # A fingerprint has about 10 near copies, so at most 10 / HOT_SHARE = 100,000 anchors are crowded: a few MB to broadcast.
    crowded = _visits(fps, differ, True).groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > crowd)
    crowded = materialize(crowded.select("anchor", F.ceil(F.col("n") / part).cast("int").alias("parts")), "anchors")
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    met = _visits(fps, differ, False).join(F.broadcast(crowded), "anchor", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    met = met.select("anchor", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "near", "fp", own.alias("own"))
    met = met.select("anchor", "part", (F.col("near") & (F.col("own") == F.col("part"))).alias("near"), "fp")
    met = met.repartition("anchor", "part").sortWithinPartitions("anchor", "part", F.desc("near"))
    return met.mapInArrow(lambda x: _compare(x, differ), "a long, b long")


def simhash_groups(docs: DataFrame, n_words: int = WORDS, differ: int = DIFFERENT, part: int = PART) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable by links) of every row.

    Words are runs of bytes other than space and controls 9 to 13, with A-Z lower-cased. A text without words, or null, has
    fingerprint zero and is linked like any other. Repeated rows are answered alike. A null id takes part in links and is a
    component id only if no member has an id. Other columns are not read. No rows in, no rows out.
    """
    rows = materialize(fingerprints(docs, n_words), "fingerprints")
    fps = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("size")), "fingerprint-groups")
    edges = materialize(links(fps, fps.count(), differ, part).distinct(), "fingerprint-links")
    own = fps.join(components(edges).withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    own = materialize(own, "fingerprint-components")
    roots = own.groupBy("component").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("members"))
    groups = join_groups(own, roots, ["component"], "members", own.count()).select("fp", "size", "component_id")
    found = join_groups(rows, groups, ["fp"], "size", rows.count())
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
