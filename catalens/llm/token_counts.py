"""Token counts by a linear longest-match automaton.

The vocabulary is a trie. Where the text leaves the trie, the state's failure link says where matching goes on, and a
number worked out beforehand says how many tokens greedy longest match has finished by then. So each byte of a word
is looked at once, nothing is scanned again, and no token is ever cut out of the word.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from catalens.llm.texts import by_rows, id_text

#: Words that a task remembers; the memo starts anew when it is full, which changes no result.
MEMO = 400_000
MEMO_CHARS = 64


class Automaton:
    """Greedy longest-match lengths over byte strings.

    ``entries`` may start a word or go on in it. With a ``mark`` (such as b"##"), entries that begin with it only go on and
    all others only start. A word that cannot be cut into entries counts as one unknown token.
    """

    def __init__(self, entries: list[bytes], mark: bytes = b""):
        self.go: dict[int, int] = {}  # state * 256 + byte → state
        self.inner = 1 if mark else 0
        ends, first, kids = set(), 1 + self.inner, [[] for _ in range(1 + self.inner)]
        for entry in entries:
            inside = bool(mark) and entry.startswith(mark)
            state = self.inner if inside else 0
            body = entry[len(mark):] if inside else entry
            for byte in body:
                step = state << 8 | byte
                if step not in self.go:
                    self.go[step] = first
                    kids[state].append((byte, first))
                    kids.append([])
                    first += 1
                state = self.go[step]
            if body:
                ends.add(state)
        # fail[v]: where v goes on after the tokens popped there; -1: nowhere. popped[v]: how many those are.
        self.fail, self.popped = [-1] * first, [0] * first
        layer = [0, 1][: 1 + self.inner]
        while layer:
            below = []
            for up in layer:
                for byte, v in kids[up]:
                    below.append(v)
                    if v in ends:
                        self.fail[v], self.popped[v] = self.inner, 1
                        continue
                    z, n = self.fail[up], self.popped[up]
                    while z >= 0 and (z << 8 | byte) not in self.go:
                        z, n = self.fail[z], n + self.popped[z]
                    if z >= 0:
                        self.fail[v], self.popped[v] = self.go[z << 8 | byte], n
            layer = below

    def count(self, word: bytes) -> tuple[int, bool]:
        """The number of tokens, and whether the word could be cut into entries."""
        go, fail, popped = self.go, self.fail, self.popped
        state, n = 0, 0
        for byte in word:
            while (to := go.get(state << 8 | byte)) is None:
                n += popped[state]
                state = fail[state]
                if state < 0:
                    return 1, False
            state = to
        while state and state != self.inner:
            n += popped[state]
            state = fail[state]
            if state < 0:
                return 1, False
        return n, True


def token_counts(docs: DataFrame, entries: list[bytes], pattern: str, mark: bytes = b"") -> DataFrame:
    """doc_id, n_bytes, n_words (matches of ``pattern``), n_tokens and n_unknown of every row.

    A null text is an empty one with zero counts. Rows are counted one by one, repeated ones too; null ids stay null;
    other columns are not read. ``entries`` is a tokenizer's vocabulary and is sent to the executors whole.
    """
    if sum(map(len, entries)) > 64 << 20:
        raise ValueError("a vocabulary of over 64 MB is not broadcast")
    sent = docs.sparkSession.sparkContext.broadcast((entries, mark))

    def start():
        import regex

        automaton, split = Automaton(*sent.value), regex.compile(pattern).findall
        memo: dict[str, int] = {}

        def learn(word: str) -> int:
            n, whole = automaton.count(word.encode())
            return n if whole else -n

        def work(ids, texts):
            nonlocal memo
            out = {"doc_id": ids, "n_bytes": [], "n_words": [], "n_tokens": [], "n_unknown": []}
            for text in texts:
                words = split(text)
                if len(memo) > MEMO:
                    memo = {}
                known = memo
                for word in {w for w in words if w not in memo}:
                    if len(word) > MEMO_CHARS and known is memo:
                        known = dict(memo)
                    known[word] = learn(word)
                    if len(word) <= MEMO_CHARS:
                        memo[word] = known[word]
                counts = [known[word] for word in words]
                unknown = sum(1 for n in counts if n < 0)
                out["n_bytes"].append(len(text.encode()))
                out["n_words"].append(len(words))
                out["n_tokens"].append(sum(counts) + 2 * unknown)  # an unknown word stands as -1
                out["n_unknown"].append(unknown)
            return out

        return work

    return by_rows(id_text(docs), None, "doc_id long, n_bytes long, n_words long, n_tokens long, n_unknown long", start)
