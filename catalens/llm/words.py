"""Words of many texts at once, as arrays: where they are and a 64-bit hash of each."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)  # any odd number
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit numbers that spreads every bit over all others."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values, by one sort."""
    ranked = np.sort(x)
    new = np.ones(len(x), bool)
    np.not_equal(ranked[1:], ranked[:-1], out=new[1:])
    return ranked[new]


#: A number for each byte value.
BYTE_VALUES = mix((np.arange(256, dtype=_U) + _U(1)) * _BASE)
#: A-Z to a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Every byte but space and the controls 9 to 13.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False
#: ASCII letters and digits, and every byte of a longer character.
ALPHANUMERIC = np.zeros(256, bool)
ALPHANUMERIC[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


class Words(NamedTuple):
    doc: np.ndarray  # index of the text
    start: np.ndarray  # in the joined bytes
    end: np.ndarray
    hash: np.ndarray
    flat: np.ndarray  # the joined bytes, lower-cased
    first: np.ndarray  # where each text begins in them


_powers = np.ones(1, _U), np.ones(1, _U)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of the base modulo 2^64 and of its inverse."""
    global _powers
    if len(_powers[0]) < n:
        inverse = _U(pow(int(_BASE), -1, 1 << 64))
        size = max(n, 1 << 16)
        _powers = tuple(np.cumprod(np.concatenate([np.ones(1, _U), np.full(size, b, _U)])) for b in (_BASE, inverse))
    return _powers[0][:n], _powers[1][:n]


def prefix_hashes(flat: np.ndarray) -> np.ndarray:
    """h with len + 1 entries; the bytes s to e hash to (h[e] - h[s]) * inverse power s."""
    out = np.zeros(len(flat) + 1, _U)
    np.cumsum(BYTE_VALUES[flat] * powers(len(flat))[0], out=out[1:])
    return out


def words(texts: list[str] | list[bytes], is_word: np.ndarray) -> Words:
    """All maximal runs of word bytes; words of equal bytes, A-Z lower-cased, have equal hashes."""
    data = [t.encode() if isinstance(t, str) else t for t in texts]
    sizes = np.fromiter((len(d) + 1 for d in data), np.int64, len(data))
    first = np.concatenate([[0], np.cumsum(sizes)])
    flat = LOWER[np.frombuffer(b" ".join([*data, b""]), np.uint8)] if data else np.zeros(0, np.uint8)
    inside = np.zeros(len(flat) + 2, bool)
    inside[1:-1] = is_word[flat]
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[0::2], edge[1::2]
    h = prefix_hashes(flat)
    value = mix((h[end] - h[start]) * powers(len(flat) + 1)[1][start] + (end - start).astype(_U))
    return Words(np.searchsorted(first, start, "right") - 1, start, end, value, flat, first[:-1])


def slices(sizes: list[int], most: int):
    """Ranges of texts of at most ``most`` bytes together; a longer text is a range of its own."""
    begin = total = 0
    for i, size in enumerate(sizes):
        if i > begin and total + size > most:
            yield begin, i
            begin, total = i, 0
        total += size
    if begin < len(sizes):
        yield begin, len(sizes)
