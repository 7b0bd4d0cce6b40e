"""Words, word pairs and hashes of texts, shared by the operators of this subpackage."""

from __future__ import annotations

import hashlib
import re
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np

WORD = re.compile(r"[^\W_]+")

#: Characters that show nothing and only steer layout: category Cf, the grapheme joiner and the variation selectors.
INVISIBLE = frozenset(chr(c) for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Cf" or c == 0x34F or 0xFE00 <= c <= 0xFE0F)


#: The first 256 characters as bytes, all but letters and digits as blanks.
BLANKED = bytes(c if WORD.match(chr(c)) else 32 for c in range(256))


def folded_runs(low: str) -> list[str]:
    """Maximal runs of letters or digits; texts of one byte a character need no regular expression."""
    try:
        return low.encode("latin-1").translate(BLANKED).decode("latin-1").split()
    except UnicodeEncodeError:
        return WORD.findall(low)


def words(text: str | None) -> list[str]:
    """Maximal runs of letters or digits, case ignored."""
    return folded_runs(text.casefold()) if text else []


def shown(text: str) -> str:
    return text if INVISIBLE.isdisjoint(text) else "".join(c for c in text if c not in INVISIBLE)


def blocks(texts: list[str | None], chars: int) -> Iterator[tuple[int, int]]:
    """Slices of a list of texts with about `chars` characters each, at least one text."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t) if t else 0
        if size >= chars:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def folded_words(text: str | None) -> list[str]:
    """Words after compatibility folding and removal of invisible format characters."""
    if not text:
        return []
    if not text.isascii():
        text = shown(unicodedata.normalize("NFKC", shown(text)))
    return folded_runs(text.casefold())


def word_pairs(turns: list[str | None] | None) -> set[tuple[str, str]]:
    """The adjacent word pairs inside each turn."""
    out: set[tuple[str, str]] = set()
    for t in () if turns is None else turns:
        w = words(t)
        out.update(zip(w, w[1:]))
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (splitmix64)."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def digest64(data: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)


class Codes(dict):
    """64-bit codes of words, kept by each worker for as many as 2^16 words."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 1 << 16:
            self.clear()
        self[word] = code = digest64(word.encode("utf-8", "surrogatepass")) & (1 << 64) - 1
        return code


CODES = Codes()
