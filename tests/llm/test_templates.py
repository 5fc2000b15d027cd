"""Decontamination: planted items, re-parameterised questions, inconsistent slots, odd rows, and verbatim copies by brute force."""

import re
from collections import defaultdict

from odd_rows import plain

from catalens.llm import templates
from catalens.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
ITEMS = [
    (1, "A farmer named Alice has 12 apples and gives 5 apples to Robert, who then asks Alice for 12 more of them but "
        "gets 5 from Robert or 7 kg from Alice, so how many apples does Robert have now after all of that?"),
    (2, "what is the sum of two numbers"),  # shorter than a window
    (3, "12 7 19 4 55 6 17 8 92 10 11"),  # mostly slots: only the very words match
    (4, None), (5, ""), (None, "no id at all but some words are here to be found"),
]


def ids(rows):
    return {r["doc_id"]: (list(r["item_ids"]), r["changed_slots"]) for r in rows}


def test_re_parameterised(spark):
    changed = ITEMS[0][1].replace("Alice", "Maria").replace("Robert", "Oskar").replace("12", "340").replace("5 ", "61 ").replace("7 kg", "9 miles")
    texts = {
        1: "Some words first. " + ITEMS[0][1] + " And some after it.",
        2: "Other start here,\n" + changed.upper().replace("MARIA", "Maria").replace("OSKAR", "Oskar"),
        3: changed.replace("asks Maria for 340", "asks Oskar for 3").replace("from Maria", "from Peter"),  # slots contradict
        4: "well: What IS the sum of two -- numbers?!",
        5: "we ask what is the product of three numbers",
        6: "a table 1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16",
        7: "a table 12 7 19 4 55 6 17 8 92 10 11 too",
        8: " ".join(ITEMS[0][1].split()[:12]),  # a part only
        9: changed.replace("Oskar", "Maria"),  # two names of the item are one here
        10: "Oskar ate. " + changed.replace("Maria", "Maria Anna"),
    }
    docs = spark.createDataFrame([(i, t, "x") for i, t in texts.items()], "doc_id long, text string, item_id string")
    items = spark.createDataFrame([(*x, 1) for x in ITEMS], "item_id long, text string, doc_id int")
    got = ids(templates.contaminated(docs, items).collect())
    assert got[1] == ([1], 0) and got[2][0] == [1] and got[2][1] > 0
    assert got[4] == ([2], 0) and got[7] == ([3], 0)
    assert not {3, 5, 6, 8, 9} & got.keys()
    pairs = {(r["doc_id"], r["item_id"]): r["covered"] for r in templates.matches(docs, items, cover=0.2).collect()}
    assert pairs[1, 1] == 1.0 and 0.2 <= pairs[3, 1] < 0.6 and 0.2 <= pairs[8, 1] < 0.6


def test_odd_rows(spark, odd_docs, no_docs):
    items = spark.createDataFrame([*ITEMS, (7, "Same text here."), (7, "Same text here."), (8, "word " * 50)], "item_id long, text string")
    got = ids(templates.contaminated(odd_docs, items).collect())
    assert got == {4: ([7], 0), 5: ([7], 0), 6: ([7], 0), 9: ([8], 0)}
    assert templates.contaminated(no_docs, items).collect() == []
    assert templates.contaminated(odd_docs, items.limit(0)).collect() == []


def test_planted_items(spark):
    """Every document that holds all of an item's words in order is found, and no document without a run of them."""
    tokens = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    items = [tokens(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    begins = defaultdict(list)
    for w in items:
        for i in range(len(w) - 7):
            begins[tuple(w[i : i + 8])].append((w, i))
    whole, some = set(), set()
    for doc_id, text in plain(spark.read.parquet(f"{SF}/documents.parquet")):
        w = tokens(text)
        for i in range(len(w) - 7):
            for item, k in begins.get(tuple(w[i : i + 8]), ()):
                some.add(doc_id)
                if k == 0 and w[i : i + len(item)] == item:
                    whole.add(doc_id)
    got = {r["doc_id"] for r in QUERIES["op5_decontamination"](spark, SF).collect()}
    assert whole and whole <= got <= some


def found(spark, item, texts):
    """The numbers of the texts that hold the item."""
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"] for r in templates.contaminated(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}


def test_words_put_in_or_left_out(spark):
    item = ITEMS[0][1].split()
    middle = [*item[:20], "surely", *item[20:]], [*item[:21], *item[22:]]
    names = ITEMS[0][1].replace("Alice", "Mary Ann").replace("12", "1,500").replace("5 ", "2.5 ").replace("7 kg", "twenty-five miles")
    short = "the old red boat goes slowly down that wide river to our small white house".split()
    assert found(spark, ITEMS[0][1], [*map(" ".join, middle), names, " ".join(item[:12])]) == {0, 1, 2}
    assert found(spark, " ".join(short), [" ".join([*short[:7], "very", *short[7:]]), " ".join([*short[:7], "this", *short[8:]]),
                                          " ".join(short[:7])]) == {0, 1}
    long = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(100)]
    assert found(spark, " ".join(long), [" ".join(long[30:60]), " ".join(long[30:50])]) == {0}


def test_letter_case_and_lines(spark):
    item, german = ITEMS[0][1], (
        "Der Bauer Karl hat zwei Hunde und drei Katzen im Garten, seine Frau Anna hat Vögel im Haus und Fische im Teich vor dem Tor")
    wrapped = re.sub(r" (?=Alice|Robert|for|and)", "\n", item)
    assert found(spark, item, [item.lower(), item.upper(), item.title(), wrapped, wrapped.replace("Alice", "Maria"),
                               item.lower().replace("12", "340")]) == {0, 1, 2, 3, 4, 5}
    assert found(spark, german, [german.lower(), german.upper(), german.title(), german.replace(" ", "\n")]) == {0, 1, 2, 3}


def test_arithmetic_and_names_that_open_sentences(spark):
    assert found(spark, "What is 12 + 30 * 8?", ["Well. What is 7 + 9 * 15? Say it", "What was 12 + 30 * 8?", "the 1 2 3 4 5 6"]) == {0}
    item = "Alice has 12 apples. Robert has 5 pears. Alice eats 3."
    assert found(spark, item, [item.replace("Alice", "Maria").replace("Robert", "Oskar").replace("12", "40"),
                               "Robert has 12 apples. They are red."]) == {0}
