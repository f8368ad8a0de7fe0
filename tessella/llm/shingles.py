"""Words and shingles of texts as 64-bit hashes, computed over the bytes of whole batches with array operations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_rng = np.random.default_rng(20_240_607)
_fold = np.arange(256, dtype=np.uint8)
_fold[65:91] += 32
_VALUE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)[_fold]  # of each byte, A-Z as a-z
_WORD = np.zeros(256, dtype=bool)
_WORD[48:58] = _WORD[97:123] = _WORD[65:91] = _WORD[128:] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_COEFFICIENTS = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
#: Bytes handled at once; a longer text is a batch of its own.
CHUNK = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose results look random (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the words of UTF-8 bytes: runs of ASCII letters, digits and all bytes beyond ASCII."""
    raw = np.frombuffer(data, dtype=np.uint8)
    edge = np.diff(np.concatenate([[False], _WORD[raw], [False]]).view(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_VALUE[raw] * _powers(_BASE, len(raw)) if len(raw) else np.zeros(0, np.uint64), dtype=np.uint64)])
    inverse = _powers(_INVERSE, len(raw)) if len(raw) else np.zeros(0, np.uint64)
    return start, mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64) * _BASE)


def _of(words: np.ndarray, size: int) -> np.ndarray:
    n = len(words) - size + 1
    return mix(sum(words[k : k + n] * _COEFFICIENTS[k] for k in range(size)))


def text_shingles(texts: list[str | None], size: int = 5) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each text its distinct shingles of size words, sorted, and how often each occurs. A text of fewer words, but not
    none, has one shingle of all its words; a text without words has none."""
    at = 0
    while at < len(texts):
        parts, length = [], 0
        while at < len(texts) and (not parts or length < CHUNK):
            parts.append((texts[at] or "").encode())
            length += len(parts[-1]) + 1
            at += 1
        bounds = np.concatenate([[0], np.cumsum([len(p) + 1 for p in parts])])
        start, words = word_hashes(b"\n".join(parts))
        whole = _of(words, size) if len(words) >= size else np.zeros(0, np.uint64)
        cut = np.searchsorted(start, bounds)
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            if b - a >= size:
                own = np.sort(whole[a : b - size + 1])
                new = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
                yield own[new], np.diff(new, append=len(own))
            elif b > a:
                yield _of(words[a:b], b - a), np.ones(1, dtype=np.int64)
            else:
                yield np.zeros(0, np.uint64), np.zeros(0, np.int64)
