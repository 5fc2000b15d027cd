"""Byte-level BPE against tiktoken; the longest-match automaton against plain greedy matching."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import regex
import tiktoken
from odd_rows import plain

from catalens.llm import byte_bpe, token_counts
from catalens.llm.queries import QUERIES, _ranks

SF = "/root/testdata/sf0.001"


def sha(data):
    return hashlib.sha256(data).hexdigest()


def reference():
    entries = byte_bpe.read_ranks(_ranks())
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, special_tokens={},
                             mergeable_ranks={e: i for i, e in enumerate(entries)})


def expected(rows):
    coder, out = reference(), Counter()
    for doc_id, text in rows:
        ids = coder.encode_ordinary(text)
        out[doc_id, len(ids), sha(",".join(map(str, ids)).encode()), sha(text.encode())] += 1
    return out


def test_bpe_as_tiktoken(spark, odd_docs, no_docs):
    got = byte_bpe.digests(odd_docs, _ranks(), public_tokenizers.PATTERN)
    assert Counter(map(tuple, got.collect())) == expected(plain(odd_docs))
    assert byte_bpe.digests(no_docs, _ranks(), public_tokenizers.PATTERN).collect() == []
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert Counter(map(tuple, QUERIES["op4_byte_bpe"](spark, SF).collect())) == expected(plain(docs))


def test_bpe_random_texts():
    coder, codec, rng = reference(), byte_bpe.Codec(byte_bpe.read_ranks(_ranks()), public_tokenizers.PATTERN), random.Random(5)
    alphabet = "aaeehtnoi 's\n\t.,<|1920é東😀ـЖ́"
    for n in range(400):
        text = "".join(rng.choices(alphabet, k=rng.randrange(1, 80)))
        assert codec.encode(text) == coder.encode_ordinary(text)
        assert codec.decode(codec.encode(text)) == text.encode()
    for entry in coder._mergeable_ranks:  # every entry that is one pre-token is itself
        text = entry.decode("utf-8", "ignore")
        if text.encode() == entry and regex.findall(public_tokenizers.PATTERN, text) == [text]:
            assert codec.encode(text) == coder.encode_ordinary(text)


def test_bpe_operator_output(odd_docs):
    out = byte_bpe.encode(odd_docs, _ranks(), public_tokenizers.PATTERN).collect()
    coder = reference()
    assert Counter((r["doc_id"], tuple(r["ids"]), bytes(r["decoded"])) for r in out) == Counter(
        (i, tuple(coder.encode_ordinary(t)), t.encode()) for i, t in plain(odd_docs))


def greedy(word, starts, inner):
    n, at, known = 0, 0, starts
    while at < len(word):
        for end in range(len(word), at, -1):
            if word[at:end] in known:
                break
        else:
            return 1, False
        n, at, known = n + 1, end, inner
    return n, True


def test_automaton_is_greedy_matching():
    rng = random.Random(3)
    for _ in range(300):
        body = ["".join(rng.choices("abc", k=rng.randrange(1, 6))) for _ in range(rng.randrange(1, 14))]
        starts = {x.encode() for x in body[: len(body) // 2 + 1]}
        inner = {x.encode() for x in body[len(body) // 2:]}
        marked = token_counts.Automaton([*starts, *(b"##" + x for x in inner)], b"##")
        single = token_counts.Automaton([*starts])
        for _ in range(30):
            word = "".join(rng.choices("abcd", k=rng.randrange(0, 14), weights=[5, 5, 5, 1])).encode()
            assert marked.count(word) == greedy(word, starts, inner)
            assert single.count(word) == greedy(word, starts, starts)


def test_counts(spark, odd_docs, no_docs):
    entries = byte_bpe.read_ranks(_ranks())
    known = set(entries)

    def brute(rows):
        out = Counter()
        for doc_id, text in rows:
            words = regex.findall(public_tokenizers.PATTERN, text)
            counts = Counter(words)
            out[doc_id, len(text.encode()), len(words),
                sum(n * greedy_fast(w.encode(), known) for w, n in counts.items()), 0] += 1
        return out

    def greedy_fast(word, known, longest=max(map(len, entries))):
        n = at = 0
        while at < len(word):
            at = next(e for e in range(min(len(word), at + longest), at, -1) if word[at:e] in known)
            n += 1
        return n

    got = token_counts.token_counts(odd_docs, entries, public_tokenizers.PATTERN)
    assert Counter(map(tuple, got.collect())) == brute(plain(odd_docs))
    assert token_counts.token_counts(no_docs, entries, public_tokenizers.PATTERN).collect() == []
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert Counter(map(tuple, QUERIES["op10_token_counts"](spark, SF).collect())) == brute(plain(docs))
    few = token_counts.token_counts(odd_docs, [b"a", b"Same", b" text"], r"\S+| ", b"##")
    assert {r["doc_id"]: (r["n_words"], r["n_tokens"], r["n_unknown"]) for r in few.collect()}[4] == (5, 5, 4)
