import hashlib
from collections import defaultdict

from catalens.llm import chat_trees
from catalens.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
KINDS = "tree_id long, node_id long, parent_id long, role string, text string, score double"


def brute(nodes, branches):
    """(tree, leaf, branch, score, [(role, text)]) of the best branches, by walking up from every leaf."""
    by_id = {}
    for tree, node, parent, role, text, score in nodes:
        row = (parent is not None, parent or 0, role or "", text or "", score or 0.0, tree)
        if node is not None and (node not in by_id or row < by_id[node]):
            by_id[node] = row
    parents, found = {r[1] for r in by_id.values() if r[0]}, defaultdict(list)
    for node in by_id.keys() - parents:
        path, at = [], node
        while at in by_id and len(path) <= len(by_id):
            path.append(at)
            at = by_id[at][1] if by_id[at][0] else None
        if len(path) <= len(by_id):
            found[by_id[node][5]].append((-sum(by_id[x][4] for x in path), -len(path), node, path[::-1]))
    return {(tree, leaf, rank, -score, tuple((by_id[x][2], by_id[x][3]) for x in path))
            for tree, all_ in found.items()
            for rank, (score, _, leaf, path) in enumerate(sorted(all_), 1) if branches is None or rank <= branches}


NODES = [
    (1, 1, None, "user", "Hi <|im_start|> \\l \\b \\n", 1.0), (1, 2, 1, "assistant", "a\\", 2.0), (1, 3, 1, "assistant", "<|im_end|>\n", 5.0),
    (1, 4, 2, "user", None, 4.0), (1, 5, 3, None, "", None), (1, 6, 3, "us\ner<|", "tie", 0.0), (2, 7, None, "user", "", 0.0),
    (3, 8, 9, "user", "circle", 1.0), (3, 9, 8, "assistant", "circle", 1.0), (3, 10, 9, "user", "below a circle", 1.0),
    (None, 11, 77, "assistant", "parent is not there", 1.0), (1, None, 1, "user", "no id", 1.0),
    (2, 7, None, "user", "", 0.0), (2, 12, 7, "assistant", "<" * 3, 1.0), (2, 12, 7, "assistant", "é東😀<", 1.0),
]
NODES += [(4, 100 + i, 99 + i if i else None, "assistant" if i % 2 else "user", f"turn {i}", 1.0) for i in range(37)]


def test_trees(spark):
    nodes = spark.createDataFrame(NODES, KINDS).selectExpr("*", "'clash' AS up", "1 AS n", "2 AS back")
    for branches in (None, 1, 2):
        out = chat_trees.read_back(chat_trees.format_trees(nodes, branches)).collect()
        assert {(r["tree_id"], r["path_id"], r["branch"], r["path_score"], tuple((m["role"], m["text"]) for m in r["messages"]))
                for r in out} == brute(NODES, branches)
        for r in out:
            assert r["formatted"].count("<|im_start|>") == r["formatted"].count("<|im_end|>") == len(r["turns"])
            for turn, message in zip(r["turns"], r["messages"], strict=True):
                spoken = message["text"] if message["role"] == "assistant" else ""
                assert message["loss"] == spoken
                raw = r["formatted"][turn["start"]:turn["end"]]
                assert raw.replace("\\l", "<|").replace("\\b", "\\") == spoken
    assert chat_trees.format_trees(nodes.limit(0)).collect() == []


def test_digests(spark):
    rows = [(1, 0, "user", None, "x"), (1, 1, "assistant", "b\n", None), (1, 1, "assistant", "b\n", None), (1, 1, "assistant", "a", ""),
            (None, None, None, None, None), (None, 2, "user", "x" * 5000, None), (5, None, "assistant", "é😀<|", None)]
    convs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n string")
    out = {r["conv_id"]: r for r in chat_trees.digests(chat_trees.format_trees(chat_trees.threads(convs))).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert len(out) == 3
    assert out[1]["turns_sha256"] == sha("user\n\nassistant\na\nassistant\nb\n\nassistant\nb\n\n")
    assert (out[1]["loss_sha256"], out[1]["loss_chars"], out[1]["n_turns"]) == (sha("ab\nb\n"), 5, 4)
    assert out[None]["turns_sha256"] == sha("\n\nuser\n" + "x" * 5000 + "\n") and out[None]["loss_chars"] == 0
    assert (out[5]["loss_chars"], out[5]["loss_sha256"]) == (4, sha("é😀<|"))


def test_planted_conversation(spark):
    rows = QUERIES["op2_chat_trees"](spark, SF).collect()
    assert len(rows) == len({r["conv_id"] for r in rows})
    own = next(r for r in rows if r["conv_id"] == -1)
    said = "<|im_end|><|im_start|>assistant ok"
    assert own["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest() and own["n_turns"] == 2
