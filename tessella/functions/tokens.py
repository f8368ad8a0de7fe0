"""How many tokens of each line occur in a text, also inside its words, and which tokens of a line do not."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

#: Bits of the hash of three bytes.
BITS = 16
#: Bytes that are hashed together where a line's tokens are longer.
WIDTH = 5


def _threes(raw: bytes) -> np.ndarray:
    """The hashes of all three bytes that follow one another."""
    b = np.frombuffer(raw, np.uint8).astype(np.uint32)
    return ((b[:-2] * 961 + b[1:-1] * 31 + b[2:]) * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS) if len(b) > 2 else np.zeros(0, np.uint32)


class _Lines:
    """Tokens of lines, ready to be looked for: a text without one of a token's threes doesn't hold it."""

    def __init__(self, lines: str):
        self.lines = [[t for t in line.split(" ") if t] for line in lines.split("\n")]
        tokens = sorted({t for line in self.lines for t in line})
        threes = [_threes(t.encode()) for t in tokens]
        self.short = [t for t, h in zip(tokens, threes, strict=True) if not len(h)]
        self.tokens = [t for t, h in zip(tokens, threes, strict=True) if len(h)]
        size = np.array([len(h) for h in threes if len(h)], np.int64)
        self.threes, self.at = np.concatenate([*threes, np.zeros(0, np.uint32)]), np.cumsum(size) - size

    def counts(self, text: str, seen: np.ndarray) -> list[int]:
        seen[:] = False
        seen[_threes(text.encode("utf-8", "surrogatepass"))] = True
        can = np.flatnonzero(np.logical_and.reduceat(seen[self.threes], self.at)) if self.tokens else ()
        held = {t for t in (self.tokens[k] for k in can) if t in text}
        held.update(t for t in self.short if t in text)
        return [sum(t in held for t in line) for line in self.lines]


@F.pandas_udf(ArrayType(IntegerType()))
def _counted(texts: pd.Series, lines: pd.Series) -> pd.Series:
    seen, ready, out = np.zeros(1 << BITS, bool), {}, []
    for text, some in zip(texts, lines, strict=True):
        if some not in ready:
            if len(ready) >= 64:
                ready.clear()
            ready[some] = _Lines(some)
        out.append(ready[some].counts(text or "", seen))
    return pd.Series(out)


def tokens_found(text: Column, lines: Column) -> Column:
    """For each line of lines (tokens between spaces) how many of its tokens occur in the text, repeated ones each time."""
    return _counted(text, lines)


def _fives(raw: bytes) -> np.ndarray:
    """The hashes, of 32 bits, of all WIDTH bytes that follow one another."""
    b = np.frombuffer(raw, np.uint8).astype(np.uint32)
    n = len(b) - WIDTH + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    h = b[:n]
    for k in range(1, WIDTH):
        h = h * np.uint32(0x01000193) + b[k : n + k]
    return h * np.uint32(0x9E3779B1)


class _Line:
    """Tokens of one line, ready to be looked for: a text without one of a token's fives doesn't hold it, and one that has them
    is first compared where its first and its last five stand."""

    def __init__(self, line: str):
        raw = line.encode("utf-8", "surrogatepass")
        self.tokens = raw.split(b" ") if raw else []
        ends = np.append(np.flatnonzero(np.frombuffer(raw, np.uint8) == 32), len(raw))
        starts = np.append(0, ends[:-1] + 1)
        size = np.maximum(ends - starts - WIDTH + 1, 0)
        self.long, self.short = np.flatnonzero(size), np.flatnonzero(size == 0).tolist() if raw else []
        self.size = size[self.long]
        self.at = np.cumsum(self.size) - self.size
        self.fives = _fives(raw)[np.repeat(starts[self.long] - self.at, self.size) + np.arange(self.size.sum())]

    def absent(self, text: str) -> np.ndarray:
        raw, gone = text.encode("utf-8", "surrogatepass"), np.ones(len(self.tokens), bool)
        held = [k for k in self.short if self.tokens[k] in raw]
        if len(self.long):
            fives = _fives(raw)
            bits = min(max(16, (16 * len(fives)).bit_length()), 22)  # so that a long text doesn't fill its table
            shift = np.uint32(32 - bits)
            place = np.zeros(1 << bits, np.int32)  # from 1
            place[fives >> shift] = np.arange(1, len(fives) + 1, dtype=np.int32)
            found = place[self.fives >> shift]
            can = np.flatnonzero(np.logical_and.reduceat(found > 0, self.at))
            first, last = found[self.at[can]] - 1, found[self.at[can] + self.size[can] - 1] - self.size[can]
            for k, i, j in zip(self.long[can].tolist(), first.tolist(), last.tolist(), strict=True):
                token = self.tokens[k]
                if raw.startswith(token, i) or (j >= 0 and raw.startswith(token, j)) or token in raw:
                    held.append(k)
        gone[held] = False
        return np.flatnonzero(gone).astype(np.int32)


@F.pandas_udf(ArrayType(IntegerType()))
def _absent(texts: pd.Series, lines: pd.Series) -> pd.Series:
    last, line, out = None, None, []
    for text, some in zip(texts, lines, strict=True):
        if line is None or some != last:
            last, line = some, _Line(some or "")
        out.append(line.absent(text or ""))
    return pd.Series(out, dtype=object)


def tokens_absent(text: Column, line: Column) -> Column:
    """The places, from 0, of the tokens of line (each between two spaces) that do not occur in the text. Rows of the same line
    that follow one another share its preparation."""
    return _absent(text, line)
