"""Exact Jaccard join of word-shingle sets, by set relations.

Shingles are ordered from rare to common (how often, by powers of two, then by hash). Two sets that link share one of the
first shingles of both, so a document whose first shingles are all its own links with nothing; that leaves few documents,
and lists of who shares a first shingle tie these into clusters. Within a cluster

* lists of the index are skipped in blocks by position: entries beyond the position from which the required overlap can no
  longer be reached are not looked at;
* answers are skipped by set relation: a set whose partners are all in its component already asks nothing, and otherwise
  its overlaps with all others are derived from those of a similar set by the few shingles in which the two differ.
  To count links, every set asks, and only the derivation spares work.

Equal sets are one set throughout. Clusters beyond ``CELL`` sets are cut into cells, two parts at a time, so that every pair
meets in some cell and none grows with the data.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalens.llm.blocks import ANSWER, BLOCK_BYTES, Bucket, answered, answers_of, ask, bucket_bits, pack, unpack
from catalens.llm.groups import components, join_groups
from catalens.llm.words import NOT_SPACE, distinct, mix, slices, words
from catalens.session import materialize

WORDS = 5
#: Sets link if 100 * overlap >= PERCENT * union.
PERCENT = 75
#: Bytes of text whose words are found at once.
SLICE = 1 << 18
#: Sets in half a cell of a large cluster.
CELL = 4096
#: And the bytes of their shingles.
CELL_BYTES = 8 << 20
_U = np.uint64


def shingles(texts: list[bytes], n_words: int = WORDS) -> Iterator[np.ndarray]:
    """The set of each text: sorted distinct 64-bit hashes of its word sequences; of all its words, if they are fewer."""
    for a, b in slices([len(t) for t in texts], SLICE):
        found = words(texts[a:b], NOT_SPACE)
        h, total = found.hash, len(found.hash)
        rolled = h.copy()
        for k in range(1, min(n_words, total)):
            rolled[: total - k] = mix(rolled[: total - k] + _U(k)) + h[k:]
        first = np.searchsorted(found.doc, np.arange(b - a + 1))
        for d in range(b - a):
            lo, hi = first[d], first[d + 1]
            if hi - lo >= n_words:
                yield distinct(mix(rolled[lo : hi - n_words + 1]))
            elif hi > lo:
                short = h[lo : lo + 1]
                for k in range(1, hi - lo):
                    short = mix(short + _U(k)) + h[lo + k : lo + k + 1]
                yield mix(short + _U(hi - lo))
            else:
                yield h[:0]


def set_id(s: np.ndarray) -> int:
    """64 bits that equal sets share."""
    return int(mix(np.array([np.add.reduce(mix(s)), len(s)], _U)).sum().astype(np.int64))


def _keys(texts: list[bytes], n_words: int) -> tuple[np.ndarray, np.ndarray]:
    seen, sets = set(), []
    for s in shingles(texts, n_words):
        own = set_id(s)
        if own not in seen:
            seen.add(own)
            sets.append(s)
    keys, counts = np.unique(np.concatenate(sets) if sets else np.zeros(0, _U), return_counts=True)
    return keys, np.minimum(counts, 255).astype(np.uint8)


def prefix(n: int, percent: int) -> int:
    """How many first shingles of n must hold one that any linked set shares."""
    return n - -(-n * percent // 100) + 1


def _sets(batches: Iterator[pa.RecordBatch], n_words: int, percent: int) -> Iterator[pa.RecordBatch]:
    """For every document its set; where a first shingle may be shared, also its shingles that may be, in common order."""
    for batch in batches:
        for row in batch.to_pylist():
            out = {"doc_id": [], "set_id": [], "n": [], "shared": []}
            texts = unpack(row["sizes"], row["data"])
            sets = list(shingles(texts, n_words))
            keys, often = distinct(np.concatenate(sets)), answers_of(row)
            seen = set()
            for doc_id, s in zip(row["ids"], sets, strict=True):
                own, n = set_id(s), len(s)
                kind = often[np.searchsorted(keys, s)]
                shared = s[kind > 0]
                data = None
                if own not in seen and n and n - len(shared) < prefix(n, percent):
                    data = shared[np.lexsort((shared, kind[kind > 0]))].tobytes()
                seen.add(own)
                for name, x in zip(out, (doc_id, own, n, data), strict=True):
                    out[name].append(x)
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array(out["doc_id"], pa.int64()), "set_id": pa.array(out["set_id"], pa.int64()),
                "n": pa.array(out["n"], pa.int64()), "shared": pa.array(out["shared"], pa.binary())})


def _first_shingles(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, tokens = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for own, n, data in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            shared = np.frombuffer(data, np.int64)
            few = shared[: prefix(n, percent) - (n - len(shared))]
            ids.append(np.full(len(few), own))
            tokens.append(few)
        yield pa.RecordBatch.from_pydict({"token": pa.array(np.concatenate(tokens)), "set_id": pa.array(np.concatenate(ids))})


class Cluster:
    """The sets of a cell: an index over all their shared shingles, and one over the first ones with positions."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, sets: list[np.ndarray], percent: int):
        self.ids, self.n, self.sets, self.percent = ids, sizes, sets, percent
        length = np.array([len(s) for s in sets])
        doc = np.repeat(np.arange(len(sets)), length)
        terms, self.term = np.unique(np.concatenate(sets), return_inverse=True)
        self.begin = np.concatenate([[0], np.cumsum(length)])
        order = np.argsort(self.term, kind="stable")
        self.docs = doc[order]
        self.lists = np.searchsorted(self.term[order], np.arange(len(terms) + 1))
        place = np.arange(len(doc)) - self.begin[doc] + (sizes - length)[doc]  # own shingles come before shared ones
        early = np.flatnonzero(place < (sizes - -(-sizes * percent // 100) + 1)[doc])
        by = early[np.lexsort((place[early], self.term[early]))]
        self.early_doc, self.early_place = doc[by], place[by]
        self.early = np.searchsorted(self.term[by], np.arange(len(terms) + 1))
        self.own_early = [self.term[e] for e in np.split(early, np.cumsum(np.bincount(doc[early], minlength=len(sets)))[:-1])]
        self.up = np.arange(len(sets))

    def top(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def partners(self, x: int) -> np.ndarray:
        """Sets that may link with x, by size and by position."""
        n, least = self.n[x], -(-self.n[x] * self.percent // 100)
        found = []
        for place, term in enumerate(self.own_early[x], int(n - (self.begin[x + 1] - self.begin[x]))):
            lo, hi = self.early[term], self.early[term + 1]
            # Overlap from here on is at most 1 + what either has left; the least overlap with any set is ``least``.
            if n - place < least:
                break
            stop = lo + np.searchsorted(self.early_place[lo:hi], n * 100 // self.percent - least, "right")
            found.append(self.early_doc[lo:stop])
        other = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        size = self.n[other]
        return other[(other != x) & (size * 100 >= n * self.percent) & (n * 100 >= size * self.percent)]

    def count(self, terms: np.ndarray) -> np.ndarray:
        lo, hi = self.lists[terms], self.lists[terms + 1]
        size = hi - lo
        at = np.repeat(lo - np.cumsum(size) + size, size) + np.arange(size.sum())
        return np.bincount(self.docs[at], minlength=len(self.sets))

    def link(self, weight: np.ndarray | None = None, counted=None) -> list[tuple[int, int, int]]:
        """Edges (a, b, 0) that tie linked sets together; with ``weight``, also (a, a, links) for every set a that has any.

        Links are the weights of all linked sets z for which ``counted(a, z)``, arguments and answer by position.
        """
        edges, known, last = [], {}, None
        for x in np.argsort(self.n, kind="stable"):
            home = self.top(x)
            partners = self.partners(x)
            other = [z for z in partners.tolist() if self.top(z) != home]
            if not (other if weight is None else len(partners)):
                continue
            own = self.term[self.begin[x] : self.begin[x + 1]]
            near = known.get(home, last)
            if near is not None:
                theirs, overlap = near
                gained, lost = np.setdiff1d(own, theirs, True), np.setdiff1d(theirs, own, True)
                near = overlap + self.count(gained) - self.count(lost) if len(gained) + len(lost) < len(own) else None
            overlap = self.count(own) if near is None else near
            last = own, overlap
            if weight is not None:
                both = overlap[partners]
                linked = partners[100 * both >= self.percent * (self.n[x] + self.n[partners] - both)]
                total = int(weight[linked][counted(x, linked)].sum())
                if total:
                    edges.append((int(self.ids[x]), int(self.ids[x]), total))
            for z in other:
                both = int(overlap[z])
                if 100 * both >= self.percent * (self.n[x] + self.n[z] - both):
                    a, b = self.top(x), self.top(z)
                    if a != b:
                        self.up[max(a, b)] = min(a, b)
                        edges.append((int(self.ids[x]), int(self.ids[z]), 0))
            known[self.top(x)] = last
            if len(known) > 64:  # overlaps of recent sets are enough
                known.pop(next(iter(known)))
        return edges


def _link_cell(part: pd.DataFrame, percent: int, every: bool) -> pd.DataFrame:
    part = part.drop_duplicates("set_id")
    sets, weight, counted = [np.frombuffer(s, _U) for s in part["shared"]], None, None
    if every:
        weight, own = part["size"].to_numpy(), part["part"].to_numpy()
        i, j, parts = (int(part[x].iloc[0]) for x in ("i", "j", "parts"))

        def counted(x: int, other: np.ndarray) -> np.ndarray:
            """Sets of one part meet in several cells and count in that with the next part."""
            if parts < 3:
                return np.ones(len(other), bool)
            return (own[other] != own[x]) | ((own[x] + 1) % parts == i + j - own[x])

    cluster = Cluster(part["set_id"].to_numpy(), part["n"].to_numpy(), sets, percent) if len(sets) > 1 else None
    return pd.DataFrame(cluster.link(weight, counted) if cluster else [], columns=["a", "b", "n_links"]).astype("int64")


def links(near: DataFrame, percent: int, cell: int = CELL, every: bool = False) -> DataFrame:
    """Edges (a, b, 0) between set ids that tie all linked sets together; ``near`` has set_id, n, shared, a row for each set.

    ``every``: also rows (a, a, n_links) whose sum over a set is the ``size`` of all sets that link with it.
    """
    tokens = near.select("set_id", "n", "shared").mapInArrow(lambda x: _first_shingles(x, percent), "token long, set_id long")
    tokens = materialize(tokens, "first-shingles")
    least = tokens.groupBy("token").agg(F.min("set_id").alias("a"), F.count(F.lit(1)).alias("size"))
    least = least.filter("size > 1")
    stars = join_groups(tokens, least, ["token"], "size", tokens.count()).select("a", F.col("set_id").alias("b")).distinct()
    clusters = components(stars)
    weight = near.select(F.col("set_id").alias("node"), F.octet_length("shared").alias("bytes"))
    parts = clusters.join(weight, "node").groupBy("component").agg(
        F.count(F.lit(1)).alias("size"), F.greatest(F.ceil(F.count(F.lit(1)) / cell), F.ceil(F.sum("bytes") / CELL_BYTES)).alias("parts"))
    parts = materialize(parts, "clusters")
    placed = join_groups(clusters, parts, ["component"], "size", clusters.count()).withColumn(
        "part", F.pmod(F.xxhash64("node"), "parts"))
    # One part: the cluster is its only cell. More: cell (i, j) has the sets of parts i and j.
    cells = placed.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).filter(
        "parts < 3 OR j <> part").select(
        F.col("node").alias("set_id"), "component", "part", "parts",
        F.when(F.col("parts") < 3, 0).otherwise(F.least("part", "j")).alias("i"),
        F.when(F.col("parts") < 3, 0).otherwise(F.greatest("part", "j")).alias("j")).distinct()
    return cells.join(near, "set_id").groupBy("component", "i", "j").applyInPandas(
        lambda part: _link_cell(part, percent, every), "a long, b long, n_links long")


def jaccard_groups(docs: DataFrame, n_words: int = WORDS, percent: int = PERCENT, block_bytes: int = BLOCK_BYTES,
                   cell: int = CELL) -> DataFrame:
    """The columns of ``jaccard_links`` but n_links: groups only, which spares the links inside a component."""
    return _joined(docs, n_words, percent, block_bytes, cell, False).drop("n_links")


def jaccard_links(docs: DataFrame, n_words: int = WORDS, percent: int = PERCENT, block_bytes: int = BLOCK_BYTES,
                  cell: int = CELL) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links), n_links (other rows it links with) of every row.

    Words are runs of bytes other than space and controls 9 to 13, with A-Z lower-cased. A text without words, or null, has
    no shingles and links with nothing. Repeated rows are answered alike. A null id takes part in links and is never a
    component id unless no member has an id. Other columns are not read. No rows in, no rows out.
    """
    return _joined(docs, n_words, percent, block_bytes, cell, True)


def _joined(docs: DataFrame, n_words: int, percent: int, block_bytes: int, cell: int, every: bool) -> DataFrame:
    packed = pack(docs, "shingle-blocks", block_bytes)
    asked = ask(packed, lambda row: _keys(unpack(row["sizes"], row["data"]), n_words), bucket_bits(packed))

    def how_often(part: pd.DataFrame) -> pd.DataFrame:
        bucket = Bucket(part, np.uint8)
        return bucket.answers(np.floor(np.log2(bucket.total)).astype(np.uint8))

    asked = answered(packed, asked.groupBy("bucket").applyInPandas(how_often, ANSWER))
    sets = materialize(
        asked.mapInArrow(lambda x: _sets(x, n_words, percent), "doc_id long, set_id long, n long, shared binary"), "sets")
    near = sets.filter("shared IS NOT NULL").dropDuplicates(["set_id"]).select("set_id", "n", "shared")
    if every:
        near = near.join(sets.groupBy("set_id").agg(F.count(F.lit(1)).alias("size")), "set_id")
    near = materialize(near, "near-sets")
    edges = materialize(links(near, percent, cell, every), "links")
    linked = components(edges)
    least = sets.filter("n > 0").groupBy("set_id").agg(F.min("doc_id").alias("own"), F.count(F.lit(1)).alias("size"))
    least = least.join(linked.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn(
        "component", F.coalesce("component", "set_id")).join(
        edges.groupBy(F.col("a").alias("set_id")).agg(F.sum("n_links").alias("n_links")), "set_id", "left").withColumn(
        "n_links", F.coalesce("n_links", F.lit(0)) + F.col("size") - 1)
    least = materialize(least, "set-groups")
    roots = least.groupBy("component").agg(F.min("own").alias("component_id"), F.count(F.lit(1)).alias("sets"))
    groups = join_groups(least, roots, ["component"], "sets", least.count()).select("set_id", "size", "component_id", "n_links")
    found = join_groups(sets.filter("n > 0").select("doc_id", "n", "set_id"), groups, ["set_id"], "size", sets.count())
    return found.select("doc_id", F.col("n").alias("n_shingles"), "component_id", "n_links").unionByName(sets.filter("n = 0").select(
        "doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links")))
