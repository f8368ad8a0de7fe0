"""Similarity of strings by their matching blocks: twice the letters in common blocks over all letters of both.

The longest common block is taken (of equally long ones the first on the left, then the first on the right), then the longest in
what stands before both and after both, and so on. If the right string has 200 letters or more, those that fill more than a
hundredth of it begin no block and only extend one. Many pairs are worked on at once: a round takes one block from every open
stretch of every pair, as the longest run on a diagonal among the places where letters agree.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Places where letters agree that are held at once.
CHUNK = 1 << 20
# From which length on frequent letters begin no block, and the share that makes them frequent.
LONG, FREQUENT = 200, 100


def _letters(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all strings and where each one begins."""
    size = np.array([len(s) for s in strings], np.int64)
    return np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64), np.concatenate([[0], np.cumsum(size)])


def _spread(many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each index as often as many says, and a count from 0 for each."""
    of = np.repeat(np.arange(len(many)), many)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)


class _Pairs:
    def __init__(self, left: list[str], right: list[str]):
        (self.a, self.a_at), (self.b, self.b_at) = _letters(left), _letters(right)
        size = np.diff(self.b_at)
        pair_b, pair_a = np.repeat(np.arange(len(right)), size), np.repeat(np.arange(len(left)), np.diff(self.a_at))
        key = pair_b << 21 | self.b
        order = np.argsort(key, kind="stable")
        kinds, count = np.unique(key, return_counts=True)
        of = kinds >> 21
        fine = (size[of] < LONG) | (count <= size[of] // FREQUENT + 1)
        group = np.repeat(np.arange(len(kinds)), count)
        order, group = order[fine[group]], group[fine[group]]
        self.width = len(self.b) + 1
        self.places, self.places_of = order, group * self.width + order  # right places by pair and letter
        mine = pair_a << 21 | self.a
        at = np.minimum(np.searchsorted(kinds, mine), max(len(kinds) - 1, 0))
        self.group = np.where((kinds[at] == mine) & fine[at], at, -1) if len(kinds) else np.full(len(mine), -1)
        self.extends = size >= LONG

    def _agreements(self, rows: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each left place the stretch of places that hold its letter on the right between lo and hi."""
        g = self.group[rows] * self.width
        first, last = np.searchsorted(self.places_of, g + lo), np.searchsorted(self.places_of, g + hi)
        return first, np.where(g < 0, 0, last - first)

    @staticmethod
    def _runs(of: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, ...]:
        """Runs along diagonals of places ordered by i: of, first i, first j, length."""
        diagonal = j - i
        order = np.lexsort((diagonal, of))  # stable, so by i within
        of, i, j, diagonal = of[order], i[order], j[order], diagonal[order]
        new = np.concatenate([[True], (of[1:] != of[:-1]) | (diagonal[1:] != diagonal[:-1]) | (i[1:] != i[:-1] + 1)]) if len(of) else np.zeros(0, bool)
        start = np.flatnonzero(new)
        return of[start], i[start], j[start], np.diff(np.append(start, len(of)))

    def longest(self, alo: np.ndarray, ahi: np.ndarray, blo: np.ndarray, bhi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """i, j and length of the longest run of each stretch; without any, its beginning and 0."""
        out = [alo.copy(), blo.copy(), np.zeros(len(alo), np.int64)]
        row_of, nth = _spread(ahi - alo)
        rows = alo[row_of] + nth
        first, many = self._agreements(rows, blo[row_of], bhi[row_of])
        ends = np.cumsum(many)
        at, carried = 0, None
        while at < len(rows):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHUNK, side="right")))
            part, k = _spread(many[at:to])
            of, i, j = row_of[at:to][part], rows[at:to][part], self.places[first[at:to][part] + k]
            of, i, j, n = self._runs(of, i, j)
            if carried is not None:  # runs of the part before that go on
                known = {d: size for d, size in zip(*carried, strict=True)}
                begins = np.flatnonzero((i == rows[at]) & (of == row_of[at]) & (row_of[at] == row_of[at - 1]))
                more = np.array([known.get(d, 0) for d in (j - i)[begins]], np.int64)
                i[begins], j[begins], n[begins] = i[begins] - more, j[begins] - more, n[begins] + more
            last = np.flatnonzero((of == row_of[to - 1]) & (i + n == rows[to - 1] + 1))
            carried = ((j - i)[last].tolist(), n[last].tolist())
            best = np.lexsort((j, i, -n, of))
            best = best[np.concatenate([[True], of[best][1:] != of[best][:-1]])] if len(best) else best
            better = n[best] > out[2][of[best]]
            for have, new in zip(out, (i, j, n), strict=True):
                have[of[best][better]] = new[best][better]
            at = to
        return tuple(out)

    def _further(self, i: np.ndarray, j: np.ndarray, most: np.ndarray, step: int) -> np.ndarray:
        """How many letters, at most so many, agree from i and j on."""
        done, open_, width = np.zeros(len(i), np.int64), np.flatnonzero(most > 0), 16
        while len(open_):
            k = done[open_][:, None] + np.arange(width)
            inside = k < most[open_][:, None]
            same = inside & (self.a[np.where(inside, i[open_][:, None] + step * k, 0)] == self.b[np.where(inside, j[open_][:, None] + step * k, 0)])
            n = np.where(same.all(axis=1), width, same.argmin(axis=1))
            done[open_] += n
            open_ = open_[(n == width) & (done[open_] < most[open_])]
            width = min(2 * width, max(16, CHUNK // max(1, len(open_))))
        return done

    def common(self) -> np.ndarray:
        """Letters in common blocks, of each pair."""
        total = np.zeros(len(self.a_at) - 1, np.int64)
        of, alo, ahi, blo, bhi = np.arange(len(total)), self.a_at[:-1], self.a_at[1:], self.b_at[:-1], self.b_at[1:]
        while True:
            open_ = (alo < ahi) & (blo < bhi)
            of, alo, ahi, blo, bhi = of[open_], alo[open_], ahi[open_], blo[open_], bhi[open_]
            if not len(of):
                return total
            i, j, n = self.longest(alo, ahi, blo, bhi)
            some = np.flatnonzero(self.extends[of])
            if len(some):
                before = self._further(i[some] - 1, j[some] - 1, np.minimum(i - alo, j - blo)[some], -1)
                i[some], j[some], n[some] = i[some] - before, j[some] - before, n[some] + before
                n[some] += self._further((i + n)[some], (j + n)[some], np.minimum(ahi - i - n, bhi - j - n)[some], 1)
            np.add.at(total, of, n)
            met = n > 0
            of, alo, ahi, blo, bhi, i, j, n = (x[met] for x in (of, alo, ahi, blo, bhi, i, j, n))
            of, alo, ahi, blo, bhi = np.tile(of, 2), np.concatenate([alo, i + n]), np.concatenate([i, ahi]), np.concatenate([blo, j + n]), np.concatenate([j, bhi])


def block_ratios(left: list[str], right: list[str], letters: int = 1 << 17) -> np.ndarray:
    """The similarity of each pair, in groups of pairs of about so many letters; two empty strings have 1."""
    out, at = np.ones(len(left)), 0
    sizes = np.array([len(a) + len(b) for a, b in zip(left, right, strict=True)], np.int64)
    todo = np.array([k for k in range(len(left)) if left[k] != right[k]], np.int64)
    upto = np.cumsum(sizes[todo])
    while at < len(todo):
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + letters, side="right")))
        some = todo[at:to]
        out[some] = 2 * _Pairs([left[k] for k in some], [right[k] for k in some]).common() / sizes[some]
        at = to
    return out


@F.pandas_udf(DoubleType())
def _measured(left: pd.Series, right: pd.Series) -> pd.Series:
    known = (left.notna() & right.notna()).to_numpy()
    out = np.full(len(left), np.nan)
    out[known] = block_ratios(left[known].tolist(), right[known].tolist())
    return pd.Series(out).where(pd.Series(known), None)


def block_ratio(a: Column, b: Column) -> Column:
    """The similarity by matching blocks; null if a side is null."""
    return F.when(a.isNotNull() & b.isNotNull(), _measured(a, b))


LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789 "


def bag(name: Column) -> Column:
    """How often each of LETTERS occurs in a normal form."""
    return F.array(*[(F.length(name) - F.length(F.replace(name, F.lit(c), F.lit("")))).cast("int") for c in LETTERS])


def bag_bound(a: Column, b: Column, size: Column) -> Column:
    """What the similarity of two normal forms of so many letters together can be at most, by their bags."""
    common = F.aggregate(F.zip_with(a, b, lambda x, y: F.least(x, y)), F.lit(0), lambda s, x: s + x)
    return F.when(size == 0, 1.0).otherwise(2.0 * common / size)
