"""Content-defined places of byte strings: every window of a text picks one place in it from its own bytes alone."""

from __future__ import annotations

import numpy as np

from .shingles import _BASE, _INVERSE, _VALUE, _powers, mix

_PLACE = np.uint64((1 << 24) - 1)
_RAW = np.random.default_rng(77).integers(1, 1 << 63, 256, dtype=np.uint64)
#: Window starts handled at once; longer texts are cut into overlapping parts.
SPAN = 1 << 22


def prefix_sums(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums from which the hash of any substring follows, and the inverse powers that make it independent of its place."""
    n = len(raw)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_RAW[raw] * _powers(_BASE, n), out=total[1:])
    return total, _powers(_INVERSE, n + 1)


def substring_hashes(sums: tuple[np.ndarray, np.ndarray], start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    total, inverse = sums
    return mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64) * _VALUE[seed])


def picks(sums: tuple[np.ndarray, np.ndarray], n: int, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a text of n bytes (n >= window): the picked places, the hashes of the gram bytes there, and the first and last start
    of the windows that pick each, in order of starts. A window picks its gram of smallest hash, the first of equal ones."""
    at = np.arange(n - gram + 1)
    total, inverse = sums
    hashes = mix((total[gram : n + 1] - total[: n - gram + 1]) * inverse[: n - gram + 1] + np.array([gram], dtype=np.uint64) * _VALUE[0])  # as substring_hashes
    low = (hashes & ~_PLACE) | at.astype(np.uint64)
    width, reach = window - gram + 1, 1
    while reach < width:  # low[i]: the least of so many grams from i on
        step = min(reach, width - reach)
        low = np.minimum(low[: len(low) - step], low[step:])
        reach += step
    new = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
    place = (low[new] & _PLACE).astype(np.int64)
    return place, hashes[place], new, np.concatenate([new[1:], [len(low)]]) - 1
