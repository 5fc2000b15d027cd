"""Porter stemmer (M. F. Porter, "An algorithm for suffix stripping", 1980) with the usual toolkit extensions.

The extensions: a table of irregular forms, words of up to two letters untouched, "ies" -> "ie" in four-letter words,
"y" -> "i" only after a consonant, and the extra suffixes marked below.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Words in the memo of a task, and texts stemmed at a time.
MEMO_WORDS = 1 << 16
SLICE_ROWS = 256
# Irregular forms.
IRREGULAR = {
    "skies": "sky", "sky": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news",
    "innings": "inning", "inning": "inning", "outings": "outing", "outing": "outing", "cannings": "canning",
    "canning": "canning", "howe": "howe", "proceed": "proceed", "exceed": "exceed", "succeed": "succeed",
}
# Fixed values: (suffix, replacement) of step 2; "fulli" and "logi" are extensions, "bli" widens the paper's "abli".
STEP_2 = [
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"),
    ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"),
    ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"),
    ("iviti", "ive"), ("biliti", "ble"), ("fulli", "ful"),
]
# Step 3.
STEP_3 = [
    ("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""),
]
# Step 4.
STEP_4 = [
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "sion", "tion", "ou", "ism", "ate",
    "iti", "ous", "ive", "ize",
]


def _shape(word: str) -> str:
    """The word as c/v letters; "y" is a vowel after a consonant."""
    out = ""
    for ch in word:
        if ch in "aeiou":
            out += "v"
        elif ch == "y" and out.endswith("c"):
            out += "v"
        else:
            out += "c"
    return out


def _measure(stem: str) -> int:
    return _shape(stem).count("vc")


def _has_vowel(stem: str) -> bool:
    return "v" in _shape(stem)


def _double_end(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _short_end(word: str) -> bool:
    """Consonant-vowel-consonant at the end (last not w, x, y), or a two-letter vowel-consonant word."""
    shape = _shape(word)
    return (shape.endswith("cvc") and word[-1] not in "wxy") or shape == "vc"


def _swap(word: str, rules: list[tuple[str, str]]) -> str:
    """Apply the first rule whose suffix fits, if the rest has measure above 0."""
    for suffix, new in rules:
        if word.endswith(suffix):
            rest = word[: len(word) - len(suffix)]
            return rest + new if _measure(rest) > 0 else word
    return word


def _plural(word: str) -> str:
    if word.endswith("ies"):
        return word[:-1] if len(word) == 4 else word[:-2]
    if word.endswith("sses"):
        return word[:-2]
    return word[:-1] if word.endswith("s") and not word.endswith("ss") else word


def _past(word: str) -> str:
    if word.endswith("ied"):
        return word[:-1] if len(word) == 4 else word[:-2]
    if word.endswith("eed"):
        return word[:-1] if _measure(word[:-3]) > 0 else word
    for suffix in ("ed", "ing"):
        rest = word[: len(word) - len(suffix)]
        if word.endswith(suffix) and _has_vowel(rest):
            break
    else:
        return word
    if rest.endswith(("at", "bl", "iz")):
        return rest + "e"
    if _double_end(rest):
        return rest if rest[-1] in "lsz" else rest[:-1]
    return rest + "e" if _measure(rest) == 1 and _short_end(rest) else rest


def _final_y(word: str) -> str:
    if word.endswith("y") and len(word) > 2 and _shape(word[:-1])[-1] == "c":
        return word[:-1] + "i"
    return word


def _step_2(word: str) -> str:
    if word.endswith("alli") and _measure(word[:-4]) > 0:
        return _step_2(word[:-2])
    if word.endswith("logi"):
        return word[:-1] if _measure(word[:-3]) > 0 else word
    return _swap(word, STEP_2)


def _step_4(word: str) -> str:
    for suffix in STEP_4:
        if word.endswith(suffix):
            cut = 3 if suffix in ("sion", "tion") else len(suffix)
            rest = word[: len(word) - cut]
            return rest if _measure(rest) > 1 else word
    return word


def _final_e(word: str) -> str:
    if not word.endswith("e"):
        return word
    rest = word[:-1]
    m = _measure(rest)
    return rest if m > 1 or (m == 1 and not _short_end(rest)) else word


def stem_word(word: str) -> str:
    word = word.lower()
    if word in IRREGULAR:
        return IRREGULAR[word]
    if len(word) <= 2:
        return word
    word = _step_2(_final_y(_past(_plural(word))))
    word = _final_e(_step_4(_swap(word, STEP_3)))
    return word[:-1] if word.endswith("ll") and _measure(word[:-1]) > 1 else word


@F.arrow_udf(StringType())
def stem_text(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Stem every whitespace-separated word, punctuation still attached.

    Row-wise over Arrow batches, so it adds no shuffle: joining a corpus to a stem table would move every token, and
    move the most common ones to a single task. The memo makes a repeated word one dictionary look-up per task. Both the memo
    and the texts that are Python strings at a time are bounded.
    """
    stem = lru_cache(maxsize=MEMO_WORDS)(stem_word)
    for texts in batches:
        slices = (texts.slice(at, SLICE_ROWS).to_pylist() for at in range(0, len(texts), SLICE_ROWS))
        stemmed = [pa.array([None if t is None else " ".join(map(stem, t.split())) for t in part], pa.string()) for part in slices]
        yield pa.concat_arrays(stemmed) if stemmed else texts
