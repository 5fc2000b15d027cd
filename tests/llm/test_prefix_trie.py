import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from catalens.llm import prefix_trie


def brute(rows, share):
    """All nodes of the trie as tuples, from (conv_id, turn, role, text) rows without tied turns."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(turns)] for c, turns in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4 if share else 0
        built[c] = own.get(c - int(math.fmod(c, 20)), [])[:h] + turns[h:]
    members = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = defaultdict(list)
    for node in members:
        if node:
            kids[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        leaves[node] = sum(leaves[k] for k in kids[node]) or 1
        saved[node] = (len(members[node]) - 1) * words + sum(saved[k] for k in kids[node])
    out = Counter()
    for node, convs in members.items():
        ends = ",".join(str(c) for c in sorted(convs) if len(built[c]) == len(node))
        out[min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), len(kids[node]), leaves[node],
            saved[node], hashlib.sha256(ends.encode()).hexdigest()] += 1
    return out


def rows_of(seed, n_convs, longest):
    rng = random.Random(seed)
    out = []
    for c in rng.sample(range(-30, 3 * n_convs), n_convs):
        for t in range(rng.randint(1, longest)):
            said = rng.choice(["yes", "no  no", "a\tb\x1cc", "", None, "été 東京"]) if t > 1 else "hello there"
            out.append((c, t if t else None, rng.choice(["user", None]) if t > 1 else "user", said))
    return out


def table(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], "conv_id long, turn long, role string, text string, depth string, n int")


@pytest.mark.parametrize("share", [False, True])
def test_brute(spark, share):
    rows = rows_of(3, 120, 9) + [(None, 0, "user", "nobody"), (5000, None, None, None), (7000, 3, "user", "alone")]
    rows += [(20 * 9, t, "user", f"long {t}") for t in range(90)]
    turns = prefix_trie.numbered_turns(table(spark, rows).repartition(3))
    found = prefix_trie.trie(*(prefix_trie.shared_heads if share else prefix_trie.own_turns)(turns), chunk=7)
    assert Counter(map(tuple, found.collect())) == brute(rows, share)


def test_turnless_conversation(spark):
    """Conversation c has only turns that it gives up, and the one that it borrows from does not exist."""
    c = next(c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4 == 3)
    rows = [(c, 0, "user", "gone"), (c, 1, "user", "gone too"), (c + 200, 0, "user", "x")]
    found = prefix_trie.trie(*prefix_trie.shared_heads(prefix_trie.numbered_turns(table(spark, rows))))
    assert Counter(map(tuple, found.collect())) == brute(rows, True)


def test_repeated_and_tied_rows(spark):
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, 0, "assistant", "b"), (2, 0, "assistant", "b"), (2, 0, "user", "a")]
    found = {(r["conv_id"], r["depth"]): r for r in prefix_trie.conversation_trie(table(spark, rows)).collect()}
    assert set(found) == {(1, 0), (1, 1), (1, 2), (1, 3)}
    assert found[1, 2]["n_convs"] == 2 and found[1, 3]["n_convs"] == 1
    assert found[1, 2]["ends_sha256"] == hashlib.sha256(b"2").hexdigest()


def test_empty(spark):
    none = table(spark, [(1, 0, "user", "a")]).limit(0)
    assert prefix_trie.conversation_trie(none).collect() == []


def test_many_ends_at_one_node(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE", 64)
    rows = [(c, 0, "user", "same") for c in range(900)] + [(c, 0, "user", f"own {c}") for c in range(1000, 1050)]
    found = prefix_trie.conversation_trie(table(spark, rows).repartition(5))
    assert Counter(map(tuple, found.collect())) == brute(rows, False)


def test_contraction_of_long_chains(spark):
    """A path, a star and a comb: sums over subtrees, in rounds that grow with the logarithm of the depth."""
    path = [(i, i - 1 if i else None, 1 if i < 299 else 0) for i in range(300)]
    star = [(1000, None, 200)] + [(1000 + i, 1000, 0) for i in range(1, 201)]
    comb = [(2000, None, 1)] + [(2000 + i, 2000 + i - 1, 2 if i < 60 else 0) for i in range(1, 61)]
    comb += [(3000 + i, 2000 + i, 0) for i in range(1, 60)]
    nodes = [(i, p, n, i % 7) for i, p, n in path + star + comb]
    found = prefix_trie.subtree_sums(spark.createDataFrame(nodes, "id long, parent long, n_children int, w int"), ["w"])
    want = {i: w for i, _, _, w in nodes}
    for i, p, _, _ in sorted(nodes, key=lambda x: (x[0] < 3000, -x[0])):
        if p is not None:
            want[p] += want[i]
    assert dict(map(tuple, found.select("id", F.col("w")).collect())) == want
