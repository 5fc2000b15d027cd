"""Byte-level BPE through a sentencepiece model that is written straight from the rank file.

Each vocabulary entry is a byte string with a rank. The model file (protocol buffers, written field by field) holds the
entries with every byte mapped to one character, scored by minus their rank, and an identity normaliser. Merging the
pair with the best score is then the same as merging the pair with the lowest rank. A pre-token that is itself an
entry is that entry, as in the usual byte-pair encoders. Decoding maps ids back to byte strings.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame

from catalens.llm.texts import by_rows, id_text
from catalens.llm.words import slices

#: Byte b is written as the character 256 + b: a letter, never white space and never a sentencepiece symbol.
SHIFT = {b: 256 + b for b in range(256)}
#: Pre-tokens that a task remembers; the memo starts anew when it is full, which changes no result.
MEMO = 400_000
#: Longer pre-tokens are rare and not remembered.
MEMO_CHARS = 64
#: Characters of texts that are split before new pre-tokens are encoded together.
TOGETHER = 1 << 19


def read_ranks(data: bytes) -> list[bytes]:
    """The entries of a rank file in order of rank."""
    pairs = (line.split() for line in data.splitlines() if line.strip())
    ranks = {int(rank): base64.b64decode(entry) for entry, rank in pairs}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError("ranks are not 0, 1, 2, …")
    return [ranks[i] for i in range(len(ranks))]


def as_chars(data: bytes) -> str:
    return data.decode("latin-1").translate(SHIFT)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _number(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n)


def _bytes(field: int, data: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(data)) + data


def model_file(entries: list[bytes]) -> bytes:
    """A sentencepiece BPE model: piece i is entry i, the last piece stands for unknown characters."""
    # Fixed values, field numbers and enums of the public model format: ModelProto pieces 1, trainer_spec 2,
    # normalizer_spec 3; piece text 1, score 2, type 3 (NORMAL 1, UNKNOWN 2); trainer model_type 3 (BPE 2), vocab_size 4,
    # unk_id 40, bos_id 41, eos_id 42, pad_id 43; normalizer name 1, add_dummy_prefix 3, remove_extra_whitespaces 4,
    # escape_whitespaces 5.
    pieces = [(as_chars(entry), -float(rank), 1) for rank, entry in enumerate(entries)] + [("<unk>", 0.0, 2)]
    none = (1 << 64) - 1  # -1: there is no such piece
    trainer = _number(3, 2) + _number(4, len(pieces)) + _number(40, len(entries)) + b"".join(
        _number(field, none) for field in (41, 42, 43))
    normalizer = _bytes(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0)
    body = b"".join(
        _bytes(1, _bytes(1, text.encode()) + _varint(2 << 3 | 5) + struct.pack("<f", score) + _number(3, kind))
        for text, score, kind in pieces)
    return body + _bytes(2, trainer) + _bytes(3, normalizer)


class Codec:
    """Encodes and decodes on one task; ``encode`` remembers pre-tokens it has met."""

    def __init__(self, entries: list[bytes], pattern: str):
        import regex
        import sentencepiece

        self.entries, self.split = entries, regex.compile(pattern).findall
        self.own = {entry: i for i, entry in enumerate(entries)}
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_file(entries))
        self.memo: dict[str, tuple[str, bytes]] = {}

    def _learn(self, tokens: list[str]) -> dict[str, tuple[str, bytes]]:
        data = [token.encode() for token in tokens]
        found = self.model.encode([as_chars(d) for d in data], num_threads=1)
        out = {}
        for token, raw, ids in zip(tokens, data, found, strict=True):
            if raw in self.own:
                ids = [self.own[raw]]
            out[token] = (",".join(map(str, ids)), self.decode(ids))
        return out

    def pieces(self, texts: list[str]) -> Iterator[list[tuple[str, bytes]]]:
        """For each pre-token of each text its ids, joined by commas, and the bytes that those ids decode to."""
        for a, b in slices([len(t) for t in texts], TOGETHER):
            split = [self.split(t) for t in texts[a:b]]
            if len(self.memo) > MEMO:
                self.memo = {}
            memo = self.memo
            fresh = {t for tokens in split for t in tokens if t not in memo}
            if fresh:
                found = self._learn(list(fresh))
                memo.update((t, x) for t, x in found.items() if len(t) <= MEMO_CHARS)
                if any(len(t) > MEMO_CHARS for t in fresh):
                    memo = memo | found
            for tokens in split:
                yield [memo[t] for t in tokens]

    def encode(self, text: str) -> list[int]:
        return [int(i) for ids, _ in next(self.pieces([text])) for i in ids.split(",")]

    def decode(self, ids: list[int]) -> bytes:
        entries = self.entries
        return b"".join([entries[i] for i in ids])


def _codec(spark, ranks: bytes, pattern: str):
    """A maker of codecs for tasks; the rank file, of bounded size, is sent once to each executor."""
    if len(ranks) > 64 << 20:
        raise ValueError("a rank file of over 64 MB is not broadcast")
    sent = spark.sparkContext.broadcast(ranks)
    return lambda: Codec(read_ranks(sent.value), pattern)


def encode(docs: DataFrame, ranks: bytes, pattern: str) -> DataFrame:
    """doc_id, ids (array) and the decoded bytes of every row. A null text is an empty one: no ids, no bytes."""
    make = _codec(docs.sparkSession, ranks, pattern)

    def start():
        codec = make()

        def work(ids, texts):
            coded = [codec.encode(t) for t in texts]
            return {"doc_id": ids, "ids": coded, "decoded": [codec.decode(x) for x in coded]}

        return work

    return by_rows(id_text(docs), None, "doc_id long, ids array<long>, decoded binary", start)


def digests(docs: DataFrame, ranks: bytes, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row.

    A null text is an empty one, with no tokens and the digests of nothing. Repeated rows are answered one by one, null
    ids stay null, other columns are not read, and very long texts are taken whole.
    """
    make = _codec(docs.sparkSession, ranks, pattern)

    def start():
        codec = make()

        def work(ids, texts):
            out = {"doc_id": ids, "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
            for pieces in codec.pieces(texts):
                joined = ",".join([x[0] for x in pieces])
                out["n_tokens"].append(joined.count(",") + 1 if joined else 0)
                out["ids_sha256"].append(hashlib.sha256(joined.encode()).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(b"".join([x[1] for x in pieces])).hexdigest())
            return out

        return work

    return by_rows(id_text(docs), None, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", start)
