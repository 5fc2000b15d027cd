"""Benchmark decontamination by template canonicalisation.

Words become a template: numbers, names and units turn into typed slots, all else into lower-case words. Windows of a fixed
number of template words are hash-joined between documents and benchmark items, so a question is found whatever
numbers and names it was re-parameterised with. The windows that an item and a document share on one alignment are a match
only if the slots are consistent: wherever the item repeats a value, the document repeats one, and wherever the item has
different values of a type, so has the document. Windows on neighbouring alignments are united in order of place, so that words
put in or left out do not split the evidence. A number of several tokens (1,500 or twenty-five) is one word, and so is a run of
names.

Documents send only windows whose hash is in a bitmap of the benchmark's windows, of a size fixed in advance. It spares
shuffling windows that cannot match; with a benchmark of any size the join after it gives the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from catalens.llm.texts import STEP_ROWS, id_text
from catalens.llm.words import ALPHANUMERIC, mix, powers, slices, words
from catalens.session import materialize

#: Template words in a window.
WINDOW = 8
#: Share of an item's words that consistent windows have to cover.
COVER = 0.6
#: So many words of an item in a row, none of them changed, are a match whatever their share.
RUN = 24
#: Bits of the bitmap that documents are checked with first: 4 MB, whatever the benchmark.
BITS = 25
SLICE = 1 << 18
_U = np.uint64

# Unit words; a unit counts as one only after a number.
UNITS = """
mm cm m km inch inches ft foot feet yard yards mile miles mg g kg gram grams kilogram kilograms lb lbs pound pounds oz ounce
ounces ton tons ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days
week weeks month months year years percent dollar dollars cent cents euro euros degree degrees
""".split()
# Numbers in words.
NUMBER_WORDS = """
zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen
nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion
""".split()
#: Unchanged words that an item of mostly slots must have to be found with other slots, and with another word opening a sentence.
LEAST_PLAIN = 2, 3
#: OPENER is a capitalised word that opens a sentence: a name or not.
WORD, NUMBER, NAME, UNIT, OPENER = range(5)
_CAPITAL = np.zeros(256, bool)
_CAPITAL[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_POINT = np.zeros(256, bool)
_POINT[[44, 46]] = True
#: Bytes that end a sentence, as a blank line does; the word after them may be capitalised without being a name.
_STOP = np.zeros(256, bool)
_STOP[[33, 46, 58, 59, 63, 34, 40, 124]] = True
_LINE = np.zeros(256, bool)
_LINE[10] = True
#: Bytes other than blanks, line ends and hyphens; words with none between them may be one name or one number.
_BREAK = np.ones(256, bool)
_BREAK[[10, 13, 32, 45]] = False


def _hashes(of: list[str]) -> np.ndarray:
    return np.sort(words(of, ALPHANUMERIC).hash)


def _folded(value: np.ndarray, joined: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, value) of the runs that ``joined`` makes, true where a word belongs to the one before it."""
    first = np.flatnonzero(~joined)
    if not len(first):
        return first, value[:0]
    off = np.arange(len(value)) - np.repeat(first, np.diff(first, append=len(value)))
    return first, np.add.reduceat(np.where(joined, mix(value + off.astype(_U)), value), first)


class Template:
    """Words of a slice of texts, each number one word: value (hash of the word itself) and kind."""

    def __init__(self, texts: list[str]):
        data = [t.encode() for t in texts]
        low = words([t.lower() for t in texts], ALPHANUMERIC)
        raw = words(data, ALPHANUMERIC)
        if len(raw.hash) != len(low.hash):  # a letter that is lower-cased into several; take the text as it is
            low = raw
        flat = np.frombuffer(b" ".join([*data, b""]), np.uint8) if data else np.zeros(0, np.uint8)
        doc, value, start, end = raw.doc, low.hash, raw.start, raw.end
        digits, capitals, stops, lines, breaks = (
            np.concatenate([[0], np.cumsum(x[flat])]) for x in (_DIGIT, _CAPITAL, _STOP, _LINE, _BREAK))
        digit, spelled = digits[end] > digits[start], np.isin(value, _hashes(NUMBER_WORDS))
        number = digit | spelled
        before = np.concatenate([[0], end[:-1]])[: len(start)]
        same = np.concatenate([[False], doc[1:] == doc[:-1]])[: len(start)]
        opens = ~same | (stops[start] > stops[before]) | (lines[start] - lines[before] > 1)
        # A capital, then small letters, inside a sentence. An all-capital word is just emphasis.
        capital = _CAPITAL[flat[start]] & (capitals[end] - capitals[start] < end - start) & ~number
        near = ~opens & (breaks[start] == breaks[before])
        last = lambda x: np.concatenate([[False], x[:-1]])[: len(x)]
        point = same & (start - before == 1) & digit & last(digit) & _POINT[flat[before]] if len(start) else same
        first, self.value = _folded(value, point | (near & spelled & last(number)))
        self.doc, number, self.near = doc[first], number[first], near[first]
        unit = same[first] & last(number) & np.isin(self.value, _hashes(UNITS))
        name, self.opener = (capital & ~opens)[first], (capital & opens)[first]
        self.kind = np.where(number, NUMBER, np.where(unit, UNIT, np.where(name, NAME, WORD))).astype(np.int8)
        self.first = np.searchsorted(self.doc, np.arange(len(texts) + 1))

    def forms(self) -> Iterator[tuple[int, Form]]:
        """The ways in which words are read, each with its number; the lower one is preferred."""
        yield 0, Form(self, self.kind, self.kind, None)
        # Names by their very words, lower-cased: copies in another letter case.
        yield 1, Form(self, self.kind, np.where(self.kind == NAME, WORD, self.kind), NAME)
        # Words that open a sentence as names.
        opener = self.opener & (self.kind == WORD)
        yield 2, Form(self, np.where(opener, OPENER, self.kind).astype(np.int8), np.where(opener, NAME, self.kind), OPENER)


class Form:
    """Template words of one reading: the place and value of each, its kind, and prefix sums of what is hashed.

    Of kind ``only``, if given, a window must hold one; without, the reading is another's.
    """

    def __init__(self, of: Template, kind: np.ndarray, slots: np.ndarray, only: int | None):
        name = slots == NAME
        self.at, self.value = _folded(of.value, name & np.concatenate([[False], name[:-1]])[: len(name)] & of.near)
        self.doc, self.kind, slots = of.doc[self.at], kind[self.at], slots[self.at]
        self.stop = np.append(self.at, len(of.value))
        self.first = np.searchsorted(self.doc, np.arange(len(of.first)))
        canonical = np.where(slots == WORD, self.value, mix(slots.astype(_U)))
        power, self.inverse = powers(len(self.at) + 1)
        self.sums, self.exact = (
            np.concatenate([np.zeros(1, _U), np.cumsum(x * power[:-1], dtype=_U)]) for x in (canonical, mix(self.value)))
        self.plain = np.concatenate([[0], np.cumsum(slots == WORD)])
        self.wanted = None if only is None else np.concatenate([[0], np.cumsum(self.kind == only)])

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(start, hash) of all windows of n template words inside one text.

        A window of slots alone says nothing as a template (a table of numbers would match any other), so it is hashed by
        its very words.
        """
        total = len(self.doc) - n + 1
        if total < 1:
            return np.zeros(0, np.int64), np.zeros(0, _U)
        own = self.doc[:total] == self.doc[n - 1 :]
        start = np.flatnonzero(own if self.wanted is None else own & (self.wanted[n:] > self.wanted[:-n]))
        h, exact = ((x[start + n] - x[start]) * self.inverse[start] for x in (self.sums, self.exact))
        h = np.where(self.plain[start + n] > self.plain[start], h, exact ^ _U(1))
        return start, mix(mix(h) + _U(n))


def window_of(n_words: np.ndarray, most: int) -> np.ndarray:
    """Template words in a window of an item: a third of it, at least 4, at most ``most``; all of an item shorter than ``most``."""
    return np.where(n_words < most, n_words, np.clip(n_words // 3, min(4, most), most))


def _window_rows(ids, texts, most, sizes=None, bitmap=None):
    """For each wanted window: id, window hash, words, place and end, and the values, kinds and places of its words.

    Items have windows of their own size; documents have those of all ``sizes`` whose bit is set.
    """
    out = {k: [] for k in ("id", "window", "form", "place", "stop", "n_words", "values", "kinds", "at")}
    for a, b in slices([len(t) for t in texts], SLICE):
        made = Template(texts[a:b])
        n_words = np.diff(made.first)
        for number, form in made.forms():
            own = np.minimum(window_of(n_words, most), np.diff(form.first))
            for n in sizes if sizes is not None else np.unique(own[own > 0]).tolist():
                start, h = form.windows(n)
                if bitmap is not None:
                    bit = h >> _U(64 - BITS)
                    keep = (bitmap[(bit >> _U(3)).astype(np.int64)] >> (bit & _U(7)).astype(np.uint8)) & 1 > 0
                else:
                    keep = own[form.doc[start]] == n
                start, h = start[keep], h[keep]
                doc = form.doc[start]
                out["id"] += [ids[a + d] for d in doc.tolist()]
                out["window"].append(h.astype(np.int64))
                out["form"].append(np.full(len(start), number))
                out["place"].append(form.at[start] - made.first[doc])
                out["stop"].append(form.stop[start + n] - made.first[doc])
                out["n_words"].append(n_words[doc])
                value, begin = form.value.astype(np.int64), made.first[doc].tolist()
                out["values"] += [value[s : s + n].tobytes() for s in start.tolist()]
                out["kinds"] += [form.kind[s : s + n].tobytes() for s in start.tolist()]
                out["at"] += [(form.at[s : s + n] - f).astype(np.int64).tobytes() for s, f in zip(start.tolist(), begin, strict=True)]
    flat = lambda x: pa.array(np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64), pa.int64())
    kinds = {"id": lambda x: pa.array(x, pa.int64())} | dict.fromkeys(("values", "kinds", "at"), lambda x: pa.array(x, pa.binary()))
    return pa.RecordBatch.from_pydict({k: kinds.get(k, flat)(x) for k, x in out.items()})


ROW = "id long, window long, form long, place long, stop long, n_words long, values binary, kinds binary, at binary"


def windows(df: DataFrame, most: int, sizes: list[int] | None = None, bitmap=None) -> DataFrame:
    """Windows of ``df``, which has an id and a text column in this order; see ``_window_rows``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if bitmap is None else np.frombuffer(bitmap.value, np.uint8)
        for batch in batches:
            for at in range(0, batch.num_rows, STEP_ROWS):
                part = batch.slice(at, STEP_ROWS)
                yield _window_rows(part.column(0).to_pylist(), part.column(1).to_pylist(), most, sizes, bits)

    return df.mapInArrow(run, ROW)


def _bitmap(items: DataFrame):
    """The bitmap of all windows; its bytes are put together by Spark, at most 2^22 of them."""
    byte = F.shiftrightunsigned("window", 64 - BITS + 3)
    bit = F.expr(f"shiftleft(1, cast(shiftrightunsigned(window, {64 - BITS}) & 7 AS int))")
    rows = items.select(byte.alias("byte"), bit.alias("bit")).groupBy("byte").agg(F.bit_or("bit").alias("bits")).toPandas()
    out = np.zeros(1 << (BITS - 3), np.uint8)
    out[rows["byte"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64).astype(np.uint8)
    return items.sparkSession.sparkContext.broadcast(out.tobytes())


class Slots:
    """Words of an item and of a document side by side, as long as their slots are consistent.

    Of one type, equal item values have equal document values, and different ones different ones. A window in which only
    words that open sentences contradict is left out.
    """

    def __init__(self):
        self.there, self.back, self.words, self.taken = {}, {}, {}, 0

    def add(self, row: dict) -> bool:
        """Take the words of a window; False, and nothing taken, if they contradict those before."""
        there, back, left_out = dict(self.there), dict(self.back), False
        item, doc, kind, at = (np.frombuffer(row[x], t).tolist() for x, t in (
            ("item_values", np.int64), ("values", np.int64), ("item_kinds", np.int8), ("item_at", np.int64)))
        for a, b, k in zip(item, doc, kind, strict=True):
            own = NAME if k == OPENER else k
            if k and (there.setdefault((own, a), b) != b or back.setdefault((own, b), a) != a):
                if k != OPENER:
                    return False
                left_out = True
        if left_out:
            return True
        self.there, self.back = there, back
        for a, b, k, place, stop in zip(item, doc, kind, at, [*at[1:], row["item_stop"]], strict=True):
            self.words.update(dict.fromkeys(range(place, stop), (False, k)))
            self.words[place] = a != b, k
        self.taken += 1
        return True

    def found(self, n_words: int) -> tuple[int, int, int, int]:
        """(item words covered, most of them in a row and unchanged, changed slots, windows).

        Of mostly slots, only unchanged words count, unless the whole item is there with enough plain words.
        """
        row = most = 0
        for place in sorted(self.words):
            row = 0 if self.words[place][0] else row + 1 if place - 1 in self.words else 1
            most = max(most, row)
        covered, changed = len(self.words), sum(c for c, _ in self.words.values())
        plain = sum(not c and k in (WORD, OPENER) for c, k in self.words.values())
        least = LEAST_PLAIN[any(c and k == OPENER for c, k in self.words.values())]
        if 2 * plain < covered and not (covered == n_words and plain >= least):
            covered -= changed
        return covered, most, changed, self.taken


def _best_run(rows: list[dict]) -> tuple[int, int, int, int]:
    """The best run of consistent windows: the most words, then the longest row of unchanged ones."""
    best, now = (0, 0, 0, 0), Slots()
    for row in rows:
        if not now.add(row):
            best, now = max(best, now.found(row["item_words"]), key=lambda x: x[:2]), Slots()
            now.add(row)
    return max(best, now.found(rows[0]["item_words"]), key=lambda x: x[:2])


def _chain(place: np.ndarray, stop: np.ndarray, shift: np.ndarray) -> list[int]:
    """Windows in order of place, in the item and in the document, that cover most of the item with fewest changes of shift."""
    shifts, at = np.unique(shift, return_inverse=True)
    value, end, last = (np.full(len(shifts), -1, np.int64) for _ in range(3))
    tip, before = np.full(len(shifts), -1), np.full(len(place), -1)
    other = np.arange(len(shifts))
    for j in np.lexsort((shift, place)).tolist():
        lo, hi, s = place[j], stop[j], at[j]
        fits = (tip >= 0) & (last < lo) & (last + shifts < lo + shifts[s])
        gain = np.where(fits, value + (hi - np.maximum(end, lo)) * 1024 - (other != s), -1)
        k = int(gain.argmax())
        fresh = (hi - lo) * 1024
        before[j], value[s] = (tip[k], gain[k]) if gain[k] > fresh else (-1, fresh)
        end[s], last[s], tip[s] = max(hi, end[k]) if before[j] >= 0 else hi, lo, j
    out, j = [], int(tip[value.argmax()])
    while j >= 0:
        out.append(j)
        j = int(before[j])
    return out[::-1]


def _judge(part: pd.DataFrame) -> tuple[int, int, int, int]:
    """The best run on one alignment, or on neighbouring ones in order of place."""
    rows: dict[tuple[int, int], dict] = {}
    for row in sorted(part.to_dict("records"), key=lambda r: (r["item_place"], r["shift"], r["form"])):
        rows.setdefault((row["item_place"], row["shift"]), row)
    alignments: dict[int, list[dict]] = {}
    for (_, shift), row in rows.items():
        alignments.setdefault(shift, []).append(row)
    best, n_words, rows = (0, 0, 0, 0), row["item_words"], list(rows.values())
    for shift in sorted(alignments):
        best = max(best, _best_run(alignments[shift]), key=lambda x: x[:2])
        if best[1] == n_words:
            return best
    if len(alignments) > 1:
        chain = _chain(*(np.array([r[x] for r in rows], np.int64) for x in ("item_place", "item_stop", "shift")))
        best = max(best, _best_run([rows[i] for i in chain]), key=lambda x: x[:2])
    return best


#: Alignments that differ by at most so many words, or by half the item if that is more, are judged together.
SHIFTS = 16


def matches(docs: DataFrame, items: DataFrame, window: int = WINDOW, cover: float = COVER, run: int = RUN) -> DataFrame:
    """(doc_id, item_id, n_windows, covered, changed_slots) for every document and item that match.

    ``items`` has item_id and text. ``covered`` is the share of the item's words in its best run of consistent windows and
    at least ``cover``, unless ``run`` words in a row are unchanged. Items of under 3 * ``window`` words have shorter windows, and an
    item shorter than ``window`` is matched as a whole. Null and empty texts match nothing, nor do rows without an id.
    Repeated rows of an id give one row per item. Other columns are not read.
    """
    docs = id_text(docs).filter("doc_id IS NOT NULL")
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).filter(
        "item_id IS NOT NULL")
    own = windows(items, window).select(
        F.col("id").alias("item_id"), "window", F.col("place").alias("item_place"), F.col("stop").alias("item_stop"),
        F.col("n_words").alias("item_words"), F.col("values").alias("item_values"), F.col("kinds").alias("item_kinds"),
        F.col("at").alias("item_at"), (F.octet_length("kinds")).alias("n"))
    own = materialize(own, "item-windows")
    sizes = sorted(r["n"] for r in own.select("n").distinct().collect())  # at most ``window`` different lengths
    kind = "doc_id long, item_id long, n_windows long, covered double, row long, changed_slots long"
    half = F.greatest(F.lit(SHIFTS).cast("long"), F.expr("item_words div 2"))
    shift = F.col("place") - F.col("item_place")
    found = windows(docs, window, sizes, _bitmap(own)).drop("n_words", "kinds", "at").join(own, "window")
    found = found.select(F.col("id").alias("doc_id"), "item_id", "form", shift.alias("shift"), "item_place", "item_stop", "item_words",
                         "item_values", "values", "item_kinds", "item_at", F.floor(shift / half).alias("band"))
    # Bands n - 1 and n are judged together. A band without neighbours is judged once, not as a half of two equal groups.
    order = Window.partitionBy("doc_id", "item_id").orderBy("band")
    beside = F.count(F.lit(1)).over(order.rangeBetween(-1, 1)) > F.count(F.lit(1)).over(order.rangeBetween(0, 0))
    bands = F.when(beside, F.array("band", F.col("band") + 1)).otherwise(F.array("band"))
    found = found.withColumn("bands", bands).withColumn("band", F.explode("bands")).drop("bands")

    def judge(part: pd.DataFrame) -> pd.DataFrame:
        covered, in_row, changed, n_windows = _judge(part)
        row = part.iloc[0]
        return pd.DataFrame({"doc_id": [row["doc_id"]], "item_id": [row["item_id"]], "n_windows": [n_windows],
                             "covered": [covered / row["item_words"]], "row": [in_row], "changed_slots": [changed]})

    # A group is a band of alignments of one item in one document: at most the square of the item's words, however long the text.
    judged = found.groupBy("doc_id", "item_id", "band").applyInPandas(judge, kind)
    best = judged.filter((F.col("covered") >= cover) | (F.col("row") >= run)).groupBy("doc_id", "item_id").agg(
        F.max(F.struct("covered", "n_windows", (-F.col("changed_slots")).alias("less"))).alias("x"))
    return best.select("doc_id", "item_id", "x.n_windows", "x.covered", (-F.col("x.less")).alias("changed_slots"))


def contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, cover: float = COVER) -> DataFrame:
    """One row per document that holds an item: doc_id, item_ids (sorted), n_windows, covered and changed_slots at most."""
    return matches(docs, items, window, cover).groupBy("doc_id").agg(
        F.sort_array(F.collect_set("item_id")).alias("item_ids"), F.sum("n_windows").alias("n_windows"),
        F.max("covered").alias("covered"), F.max("changed_slots").alias("changed_slots"))
