"""Cutting a text into the pieces that a lower-casing word-end BPE vocabulary encodes one by one.

The file's own pipeline is followed: the strings of special tokens are cut out of the raw text first, the rest is
normalised (NFC, white space, lower case per character) and split into contractions, letter runs, single numerals and runs
of other characters; white space is dropped.
"""

from __future__ import annotations

import json
import re

# In Latin-1 the classes of letters and numerals can be written out and NFC changes nothing; the standard library's engine
# is then several times faster than the vocabulary library, whose Unicode tables decide for all other texts.
_SPACE = r"\t-\r \x85\xa0"
_L = r"a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
_N = r"0-9\xb2\xb3\xb9\xbc-\xbe"
_LATIN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^{_SPACE}{_L}{_N}]+")


def byte_letters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 bytes stand for themselves, the
    others take the code points from 256 on, in order."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


LETTERS = byte_letters()
_BYTES = {ord(x): b for b, x in enumerate(LETTERS)}


class Splitter:
    """Splits texts, with the vocabulary file's special tokens cut out first."""

    def __init__(self, vocabulary: str, *, with_model: bool = False):
        from tokenizers import Tokenizer

        whole = Tokenizer.from_str(vocabulary)
        self.model = whole.model if with_model else None
        self._normalizer, self._cutter = whole.normalizer, whole.pre_tokenizer
        self.special = {t["content"]: t["id"] for t in json.loads(vocabulary)["added_tokens"]}
        self._special = re.compile("(" + "|".join(re.escape(x) for x in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self._starts = {x[:2] for x in self.special}

    def plain(self, text: str) -> list[str]:
        """The pieces of a text without special tokens."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            pieces = self._cutter.pre_tokenize_str(self._normalizer.normalize_str(text))
            return [x.translate(_BYTES).encode("latin-1").decode() for x, _ in pieces]
        return _LATIN.findall(text.lower())

    def __call__(self, text: str | None) -> list[str]:
        """Pieces in order; a special token is a piece of its own, spelled as in the file."""
        if not text:
            return []
        if self._special is None or not any(x in text for x in self._starts):
            return self.plain(text)
        out: list[str] = []
        for part in self._special.split(text):
            if part in self.special:
                out.append(part)
            elif part:
                out += self.plain(part)
        return out


class Cache:
    """Values of strings, of at most about limit bytes: two generations, of which the older one goes when the newer is full.
    Values are strings or tuples of them; strings of over 256 letters are not kept."""

    def __init__(self, limit: int):
        self.limit, self.size, self.new, self.old = limit // 2, 0, {}, {}

    def put(self, key: str, value, size: int) -> None:
        if len(key) <= 256:
            if self.size > self.limit:
                self.new, self.old, self.size = {}, self.new, 0
            self.new[key] = value
            self.size += 300 + 2 * len(key) + size
