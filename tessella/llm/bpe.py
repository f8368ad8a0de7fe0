"""Operator 4, BPE encoding and decoding.

Encoder: an Aho-Corasick automaton over all token strings gives the longest token at each place of a piece; going left to
right, a token is kept if it may follow the one before it, else the next shorter prefix token is tried, else one step is
taken back over a place that is then closed. Whether two tokens may stand side by side - no merge would have crossed their
border earlier - is read from a pair table that is filled on demand by undoing merges. The result is exactly that of applying
merges by rank, in time linear in the piece. Decoder: one string of all token texts with a table of offsets.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Iterator
from itertools import accumulate

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, kept, lean, table
from .pieces import LETTERS, Cache, Splitter
from .token_counts import vocabulary_text


class Codec:
    """Encoder and decoder of a tokenizers JSON file with word-end suffixes and merges numbered in rank order."""

    def __init__(self, vocabulary: str, cache_bytes: int = 1 << 25):
        file = json.loads(vocabulary)
        vocab, suffix = file["model"]["vocab"], file["model"]["end_of_word_suffix"]
        self.splitter = Splitter(vocabulary)
        self.special = self.splitter.special
        # Symbols: one character a byte; the last byte of a piece has a symbol of its own.
        self.inner = [chr(0x100 + b) for b in range(256)]
        self.last = [chr(0x200 + b) for b in range(256)]
        count = 1 + max(*vocab.values(), *self.special.values())
        # By token: the two that were merged, its length, the next shorter token that begins it (-1: none). By pair: the merge.
        self.left, self.right, self.size, self.shorter = (array("i", [-1]) * count for _ in range(4))
        self.merged: dict[int, int] = {}
        names: dict[int, str] = {}
        for b, letter in enumerate(LETTERS):
            names[vocab[letter]], names[vocab[letter + suffix]] = self.inner[b], self.last[b]
        before = max(names)
        for pair in file["model"]["merges"]:
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            a, b, c = vocab[left], vocab[right], vocab[left + right]
            if c <= before:
                raise ValueError("token ids do not follow the order of merges")
            before = c
            names[c], self.left[c], self.right[c], self.merged[a << 32 | b] = names[a] + names[b], a, b, c
        ids = {x: t for t, x in names.items()}
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for t, x in names.items():
            self.size[t] = len(x)
            self.shorter[t] = next((ids[x[:n]] for n in range(len(x) - 1, 0, -1) if x[:n] in ids), -1)
            self.automaton.add_word(x, t)
        self.automaton.make_automaton()
        self.cache = Cache(cache_bytes)  # of the pieces met lately, for digests
        self.fits: dict[int, bool] = {}
        # The decoder's text and offsets: token i is buffer[offsets[i]:offsets[i + 1]].
        spelled = {i: x for x, i in vocab.items()} | {i: x for x, i in self.special.items()}
        parts = [spelled.get(i, "") for i in range(count)]
        self.offsets, self.buffer = array("i", accumulate(map(len, parts), initial=0)), "".join(parts)

    def _beside(self, left: int, right: int) -> bool:
        """May the tokens stand side by side? Both are undone, the later merge first, to see whether what meets at the border
        would have merged before the merge that hides it."""
        merged, first, second = self.merged, self.left, self.right
        bound = None  # merges from this id on come too late to matter
        while True:
            both = merged.get(left << 32 | right)
            if both is not None and (bound is None or both < bound):
                return False
            if left > right and second[left] >= 0:
                bound, left = left, second[left]
            elif first[right] >= 0:
                bound, right = right + 1, first[right]
            elif second[left] >= 0:
                bound, left = left, second[left]
            else:
                return True

    def piece(self, piece: str) -> list[int]:
        """The tokens of one piece."""
        if piece in self.special:
            return [self.special[piece]]
        data = piece.encode()
        text = "".join([self.inner[b] for b in data[:-1]]) + self.last[data[-1]]
        n = len(text)
        longest, length, size, shorter = [-1] * n, [0] * n, self.size, self.shorter
        for end, token in self.automaton.iter(text):
            start = end - size[token] + 1
            if size[token] > length[start]:
                length[start], longest[start] = size[token], token
        if length[0] == n:
            return [longest[0]]
        closed, out, at, fits = bytearray(n + 1), [], 0, self.fits
        token = longest[0]
        while at < n:
            before = out[-1] if out else -1
            while token >= 0:
                end = at + size[token]
                if not closed[end]:
                    if before < 0:
                        break
                    good = fits.get(before << 32 | token)
                    if good is None:
                        if len(fits) > 100_000:
                            fits.clear()
                        good = fits[before << 32 | token] = self._beside(before, token)
                    if good:
                        break
                token = shorter[token]
            if token < 0:
                closed[at] = 1
                token = out.pop()
                at -= size[token]
                token = shorter[token] if closed[at + size[token]] else token
            else:
                out.append(token)
                at = end
                token = longest[at] if at < n else -1
        return out

    def encode(self, text: str | None) -> list[int]:
        return [t for piece in self.splitter(text) for t in self.piece(piece)]

    def decode(self, ids: list[int]) -> str:
        """The tokens' own texts with a space between, as the library does where the file names no decoder."""
        at = self.offsets
        return " ".join([self.buffer[at[i] : at[i + 1]] for i in ids])


def codec(vocabulary: str, cache_bytes: int = 1 << 25) -> Codec:
    """This worker's codec, made once a vocabulary."""
    return kept((Codec, hash(vocabulary), cache_bytes), lambda: Codec(vocabulary, cache_bytes))


def _digested(made: Codec, text: str | None) -> list[tuple[str, str, int]]:
    """Of each piece: its ids as text, its decoded text, its number of tokens."""
    pieces, cache = made.splitter(text), made.cache
    out = list(map(cache.new.get, pieces))
    if None in out:
        for k, got in enumerate(out):
            if got is None:
                piece = pieces[k]
                got = cache.new.get(piece)
                if got is None:
                    got = cache.old.get(piece)
                    if got is None:
                        ids = made.piece(piece)
                        got = " ".join(map(str, ids)), made.decode(ids), len(ids)
                    cache.put(piece, got, len(got[0]) + len(got[1]))
                out[k] = got
    return out


def encode(docs: DataFrame, vocabulary: str, *, text: str = "text") -> DataFrame:
    """docs with ids (array of int) added; null and empty texts get an empty array."""
    words = bounded_batches(docs).sparkSession.sparkContext.broadcast(vocabulary)

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        made = codec(words.value)
        for batch in lean(batches, keeps=True):
            yield pd.Series([made.encode(x) for x in batch], dtype=object)

    return docs.withColumn("ids", ids(F.col(f"`{text}`")))


def decode(encoded: DataFrame, vocabulary: str, *, ids: str = "ids") -> DataFrame:
    """encoded with decoded (string) added; null and empty arrays give an empty text."""
    words = encoded.sparkSession.sparkContext.broadcast(vocabulary)

    @F.pandas_udf("string")
    def texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        made = codec(words.value)
        for batch in lean(batches, keeps=True):
            yield pd.Series([made.decode([] if x is None else list(x)) for x in batch], dtype=object)

    return encoded.withColumn("decoded", texts(F.col(f"`{ids}`")))


def bpe_digests(docs: DataFrame, vocabulary: str, *, cache_bytes: int = 1 << 25, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: key, n_tokens, ids_sha256 (decimal ids joined by a space), decoded_sha256 (the decoded text).

    Whole texts are encoded; null and empty texts have no tokens and the digests of the empty text. The work is per row, so
    nothing is shuffled and repeated rows give repeated results."""
    words = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = codec(words.value, cache_bytes)
        for batch in lean(batches, keeps=True):
            rows = []
            for x in batch.column(1).to_pylist():
                got = _digested(made, x)
                rows.append((sum([g[2] for g in got]), hashlib.sha256(" ".join([g[0] for g in got]).encode()).hexdigest(), hashlib.sha256(" ".join([g[1] for g in got]).encode()).hexdigest()))
            n, ids, texts = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())], names=[key, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[key].dataType.simpleString()
    pairs = bounded_batches(docs).select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    return pairs.mapInArrow(digests, f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(table(spark, sf_dir, "documents"), vocabulary_text())
