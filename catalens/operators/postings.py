"""An inverted index over one block of sparse vectors, searched with bounds on what unread terms can still add."""

from __future__ import annotations

import numpy as np
import pandas as pd

#: Covers the rounding of bounds.
SLACK = 1e-9


class Postings:
    """Rows with ``terms`` (ascending numbers), ``weights`` (above zero) and ``norm2``; a row is known by its place.

    ``products`` counts the multiplications made, for tests and tuning.
    """

    def __init__(self, rows: pd.DataFrame):
        sizes = rows["terms"].map(len).to_numpy(np.int64)
        self.n = len(rows)
        self.norm2 = rows["norm2"].to_numpy(np.float64)
        self.terms_of = np.concatenate([np.zeros(0, np.int64), *rows["terms"]]).astype(np.int64)
        self.weight_of = np.concatenate([np.zeros(0), *rows["weights"]]).astype(np.float64)
        self.begin = np.concatenate([[0], np.cumsum(sizes)])
        row = np.repeat(np.arange(self.n), sizes)
        order = np.argsort(self.terms_of, kind="stable")
        self.row, self.weight = row[order], self.weight_of[order]
        self.terms, self.first = np.unique(self.terms_of[order], return_index=True)
        self.size = np.diff(self.first, append=len(order))
        unit = self.weight / np.sqrt(self.norm2[self.row])
        self.peak = np.maximum.reduceat(unit, self.first) if len(unit) else unit
        self.products = 0

    def _add(self, dots: np.ndarray, at: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """``dots`` with the postings of the terms ``at`` multiplied in."""
        size = self.size[at]
        total = int(size.sum())
        self.products += total
        if not total:
            return dots
        place = np.arange(total) + np.repeat(self.first[at] - np.concatenate([[0], np.cumsum(size)[:-1]]), size)
        return dots + np.bincount(self.row[place], self.weight[place] * np.repeat(weights, size), self.n)

    def best(self, terms: np.ndarray, weights: np.ndarray, norm2: float, keep: int, bar: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
        """(places, cosines) of the ``keep`` best rows by (cosine descending, place), of those above zero and not below ``bar``.

        Rare terms are read first. A row that shares none of the terms read so far can reach no more than what is left of
        the vector, counted by its own weights and by the heaviest ones in the block. Once that is below the bar, or below the
        ``keep``-th best of the sums so far, no new row matters, and those at hand are finished one by one if they are few.
        """
        terms = np.asarray(terms, np.int64)
        at = np.searchsorted(self.terms, terms)
        known = at < len(self.terms)
        known[known] = self.terms[at[known]] == terms[known]
        at, weights = at[known], np.asarray(weights, np.float64)[known]
        order = np.argsort(self.size[at], kind="stable")
        at, weights = at[order], weights[order]
        if not len(at):
            return np.zeros(0, np.int64), np.zeros(0)
        unit = weights / np.sqrt(norm2)
        rest = np.minimum(np.cumsum((unit * self.peak[at])[::-1])[::-1], np.sqrt(np.cumsum((unit * unit)[::-1])[::-1]))
        rest = np.append(rest, 0.0) + SLACK
        norms = np.sqrt(norm2 * self.norm2)
        read = np.cumsum(self.size[at])
        dots, done = np.zeros(self.n), 0
        while done < len(at) and (rest[done] >= bar):
            # So far as the bar asks for, but at most a quarter of what is unread at a time: meanwhile the bar may rise.
            need = int(np.searchsorted(-rest[:-1], -bar, "right"))
            before = read[done - 1] if done else 0
            upto = max(done + 1, min(need, int(np.searchsorted(read, before + (read[-1] - before) / 4)) + 1))
            dots = self._add(dots, at[done:upto], weights[done:upto])
            done = upto
            if self.n >= keep and done < len(at):
                bar = max(bar, float(np.partition(dots / norms, self.n - keep)[self.n - keep]) - SLACK)
        found = np.flatnonzero((dots > 0) & (dots / norms + rest[done] >= bar))
        if done < len(at):
            left = int((self.begin[found + 1] - self.begin[found]).sum())
            if left < read[-1] - read[done - 1]:
                dots = dots.copy()
                own = np.zeros(max(int(self.terms[-1]), int(terms[-1])) + 1)
                own[self.terms[at]] = weights
                sizes = self.begin[found + 1] - self.begin[found]
                place = np.arange(left) + np.repeat(self.begin[found] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)
                self.products += left
                if left:
                    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
                    dots[found] = np.add.reduceat(own[self.terms_of[place]] * self.weight_of[place], starts)
            else:
                dots = self._add(dots, at[done:], weights[done:])
        scores = dots[found] / np.sqrt(norm2 * self.norm2[found])
        fit = (scores > 0) & (scores >= bar)
        found, scores = found[fit], scores[fit]
        if len(found) > keep:
            cut = np.partition(scores, len(scores) - keep)[len(scores) - keep]
            found, scores = found[scores >= cut], scores[scores >= cut]
        first = np.lexsort((found, -scores))[:keep]
        return found[first], scores[first]


def best_of_block(left: pd.DataFrame, right: pd.DataFrame, keep: int) -> pd.DataFrame:
    """(no, near, score): the ``keep`` best right rows of every left row by (score descending, right ``no``), above zero.

    A column ``reach`` on the left, if there, says what score a row must have to matter.
    """
    right = right.sort_values("no", ignore_index=True)
    index, numbers = Postings(right), right["no"].to_numpy()
    bars = left["reach"] if "reach" in left else np.zeros(len(left))
    out = [index.best(*row, keep, bar) for row, bar in zip(zip(left["terms"], left["weights"], left["norm2"]), bars, strict=True)]
    many = [len(places) for places, _ in out]
    return pd.DataFrame({
        "no": np.repeat(left["no"].to_numpy(), many),
        "near": numbers[np.concatenate([np.zeros(0, np.int64), *(p for p, _ in out)])],
        "score": np.concatenate([np.zeros(0), *(s for _, s in out)]),
    })
