"""Words of texts as hash arrays, without a Python step per word.

A text is cut into words at separator bytes; a word's hash is a polynomial in its bytes modulo
2**64, mixed at the end, so hashes of any parts of words come from the same running sums.  All steps
are array operations over pieces of some hundred kilobytes that end between words (a longer word
makes a longer piece), so memory stays bounded for texts of any length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_PIECE = 1 << 18
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class _Powers:
    """Powers of the base and of its inverse, as many as the longest piece so far needs."""

    up = _powers(_BASE, _PIECE)
    down = _powers(_INVERSE, _PIECE)

    @classmethod
    def grow(cls, n: int) -> None:
        if n >= len(cls.up):
            cls.up, cls.down = _powers(_BASE, 2 * n), _powers(_INVERSE, 2 * n)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit hashes (the finaliser of splitmix64)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def byte_table(separators: str, lower: bool = True) -> np.ndarray:
    """256 hash values of bytes; separators are 0, A-Z may count as a-z."""
    values = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE)) | np.uint64(1)
    if lower:
        values[65:91] = values[97:123]
    values[np.frombuffer(separators.encode("latin-1"), np.uint8)] = 0
    return values


#: Words between ASCII white space, and words of letters only (every byte over 127 is a letter).
SPACED = byte_table(" \t\n\v\f\r")
LETTERS = byte_table("".join(chr(c) for c in range(128) if not chr(c).isalpha()))


class Piece:
    """A part of a text that ends between words; starts and ends of its words, from ``offset``."""

    def __init__(self, data: np.ndarray, table: np.ndarray, offset: int = 0) -> None:
        _Powers.grow(len(data))
        values = table[data]
        edge = np.flatnonzero(np.diff((values != 0).view(np.int8), prepend=0, append=0))
        self.offset, self.starts, self.ends = offset, edge[::2], edge[1::2]
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(values * _Powers.up[: len(data)], out=self.sums[1:])

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self.sums[ends] - self.sums[starts]) * _Powers.down[starts])

    def words(self) -> np.ndarray:
        return self.hashes(self.starts, self.ends)


def pieces(text: str | bytes | None, table: np.ndarray) -> Iterator[Piece]:
    raw = b"" if text is None else text.encode() if isinstance(text, str) else text
    data = np.frombuffer(raw, np.uint8)
    at = 0
    while at < len(data):
        end = min(at + _PIECE, len(data))
        if end < len(data):
            gaps = np.flatnonzero(table[data[at:end]] == 0)
            if len(gaps):
                end = at + int(gaps[-1]) + 1
            else:
                while end < len(data) and table[data[end]]:
                    more = np.flatnonzero(table[data[end : end + _PIECE]] == 0)
                    end = end + int(more[0]) if len(more) else min(end + _PIECE, len(data))
        yield Piece(data[at:end], table, at)
        at = end


def word_hashes(text: str | bytes | None, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and end byte of each word, in order."""
    parts = [(p.words(), p.starts + p.offset, p.ends + p.offset) for p in pieces(text, table)]
    if len(parts) == 1:
        return parts[0]
    none = (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    return tuple(np.concatenate(x) for x in zip(none, *parts))
