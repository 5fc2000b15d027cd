"""Text, number and list expressions. Null in gives null out everywhere; nothing raises on short or odd text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The runs of characters that separate words.
_SPACES = r"\s\x0B\x1C-\x1F\x85\p{Z}"
WHITESPACE = f"[{_SPACES}]+"
#: The same but for single spaces.
_ODD_SPACE = f"(?: [{_SPACES}]|[{_SPACES}&&[^ ]])[{_SPACES}]*"
NAME_LIST = "array<struct<id:int,name:string>>"
CREW_LIST = "array<struct<name:string,job:string>>"


def strip_literal(c: Column, *pieces: str) -> Column:
    """Remove literal (not regex) pieces, e.g. a unit suffix."""
    for piece in pieces:
        c = F.replace(c, F.lit(piece), F.lit(""))
    return c


def flag(c: Column, needle: str) -> Column:
    """1 when the text holds ``needle`` (case-sensitive), else 0."""
    return c.contains(needle).cast("int")


def split_once(c: Column, separator_regex: str) -> tuple[Column, Column]:
    """Both sides of the first separator; the second is null when there is none."""
    parts = F.split(c, separator_regex, 2)
    return F.get(parts, 0), F.get(parts, 1)


def first_number(c: Column) -> Column:
    """First number of two or more digits, thousands commas ignored; null when there is none."""
    return F.nullif(F.regexp_extract(strip_literal(c, ","), r"(\d+\.?\d+)", 1), F.lit(""))


def whole_number(c: Column, strict: bool = True) -> Column:
    """Text as an int; malformed text raises when ``strict``, else it is null."""
    return c.cast("int") if strict else c.try_cast("int")


def resolution(c: Column, strict: bool = True) -> tuple[Column, Column]:
    """Pixel columns and rows of a screen description such as ``Full HD 1920x1080``."""
    left, right = split_once(c, "x")
    return whole_number(first_number(left), strict), whole_number(right, strict)


def pixel_density(x: Column, y: Column, inches: Column) -> Column:
    x, y = x.cast("double"), y.cast("double")
    return F.sqrt(x * x + y * y) / inches


def storage_parts(memory: Column, fix_decimal_tb: bool = False) -> tuple[Column, Column]:
    """The two storage descriptions of text such as ``256GB SSD +  1TB HDD``, in gigabytes; the second may be "0".

    A terabyte counts as 1000. By default "1.0TB" becomes "1.0000", whose digits read as 10000; ``fix_decimal_tb`` drops
    the ".0" first.
    """
    if fix_decimal_tb:
        memory = F.replace(memory, F.lit(".0"), F.lit(""))
    plain = F.replace(strip_literal(memory, "GB"), F.lit("TB"), F.lit("000"))
    first, second = split_once(plain, r"\+")
    return first, F.when(memory.isNotNull(), F.coalesce(second, F.lit("0")))


def digits(c: Column, strict: bool = True) -> Column:
    """The digits of a text as one number; null when there is none, and if not ``strict`` also when they are too many."""
    return whole_number(F.nullif(F.regexp_replace(c, "[^0-9]", ""), F.lit("")), strict)


def storage_of_kind(first: Column, second: Column, kind: str, first_size: Column, second_size: Column) -> Column:
    return first_size * flag(first, kind) + second_size * flag(second, kind)


def words(c: Column) -> Column:
    """Non-empty whitespace-separated words."""
    return F.array_remove(F.split(c, WHITESPACE), "")


def spaced(c: Column) -> Column:
    """``words`` as one text with a space between them; what is spaced so already is only scanned."""
    return F.btrim(F.regexp_replace(c, _ODD_SPACE, " "))


def first_words(c: Column, n: int) -> Column:
    return F.array_join(F.slice(words(c), 1, n), " ")


def first_word(c: Column) -> Column:
    return F.get(words(c), 0)


# The processor and system names that the next two functions keep or map.
def cpu_brand(name: Column) -> Column:
    """Brand from the three-word processor name: the Core i7/i5/i3 names stay, the rest is grouped by maker."""
    return (
        F.when(name.isNull(), None)
        .when(name.isin("Intel Core i7", "Intel Core i5", "Intel Core i3"), name)
        .when(first_word(name) == "Intel", "Other Intel Processor")
        .otherwise("AMD Processor")
    )


def os_category(c: Column) -> Column:
    return (
        F.when(c.isNull(), None)
        .when(c.isin("Windows 10", "Windows 7", "Windows 10 S"), "Windows")
        .when(c.isin("macOS", "Mac OS X"), "Mac")
        .otherwise("Others/No OS/Linux")
    )


def whole_price(log_price: Column) -> Column:
    """Back from log price to whole currency units, cut off towards zero."""
    return F.exp(log_price).cast("long")


# A quoted text in either kind of quotes, or what stands between such texts.
_PIECE = r"""(?s)"[^"\\]*+(?:\\.[^"\\]*+)*+"|'[^'\\]*+(?:\\.[^'\\]*+)*+'|[^"']++"""
#: Stands for an escaped backslash while other escapes are rewritten; a private-use character.
_SLASH = "\uE000"


def python_to_json(c: Column) -> Column:
    """A list or dict in Python notation as JSON text; null when its quotes do not close. JSON comes out as it is.

    Outside of quotes None, True and False are renamed and commas before a closing bracket dropped; texts in single quotes get
    double ones, and the escapes that JSON lacks (of a single quote, or by two hex digits) are rewritten. Nothing within
    quotes is taken for a keyword.
    """

    def quoted(piece: Column) -> Column:
        inner = F.replace(F.substr(piece, F.lit(2), F.length(piece) - 2), F.lit("\\\\"), F.lit(_SLASH))
        inner = F.regexp_replace(F.replace(inner, F.lit("\\'"), F.lit("'")), r"\\x([0-9A-Fa-f]{2})", r"\\u00$1")
        inner = F.replace(F.replace(inner, F.lit('\\"'), F.lit('"')), F.lit('"'), F.lit('\\"'))
        return F.concat(F.lit('"'), F.replace(inner, F.lit(_SLASH), F.lit("\\\\")), F.lit('"'))

    def plain(piece: Column) -> Column:
        for word, name in (("None", "null"), ("True", "true"), ("False", "false")):
            piece = F.regexp_replace(piece, rf"\b{word}\b", name)
        return F.regexp_replace(piece, r",(\s*[\]}])", "$1")

    pieces = F.regexp_extract_all(c, F.lit(_PIECE), F.lit(0))
    made = F.transform(pieces, lambda x: F.when(F.substr(x, F.lit(1), F.lit(1)).isin("'", '"'), quoted(x)).otherwise(plain(x)))
    return F.when(F.array_join(pieces, "") == c, F.array_join(made, ""))


def objects(c: Column, kind: str) -> Column:
    """A list of objects in JSON or Python notation as ``kind``, an array of structs; null when the text is no such list.

    JSON is read directly. Only what that cannot read is rewritten and read as a variant, which takes each field by itself, so
    that a field of an odd type makes no other unreadable.
    """
    other = F.try_variant_get(F.try_parse_json(python_to_json(c)), "$", kind)
    other = F.when(~F.exists(other, lambda x: x.isNull()), other)
    return F.coalesce(F.from_json(c, kind), other)


def json_names(c: Column) -> Column:
    """Every ``name`` of a list of objects, in order; null when the text is not such a list."""
    return F.transform(objects(c, NAME_LIST), lambda x: x["name"])


def first_names(c: Column, n: int) -> Column:
    return F.slice(json_names(c), 1, n)


def names_with_job(c: Column, job: str, n: int) -> Column:
    """Names of the first ``n`` list entries with the given job."""
    hits = F.filter(objects(c, CREW_LIST), lambda x: x["job"] == job)
    return F.slice(F.transform(hits, lambda x: x["name"]), 1, n)


def close_up(names: Column) -> Column:
    """Remove the spaces inside each element, so that a full name is one word."""
    return F.transform(names, lambda x: F.replace(x, F.lit(" "), F.lit("")))


def tag_text(*lists: Column) -> Column:
    """All lists one after the other as one lower-case text."""
    return F.lower(F.array_join(F.concat(*lists), " "))
