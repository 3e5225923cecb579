"""Words of UTF-8 buffers as 64-bit fingerprints, computed for many texts at once."""

from __future__ import annotations

import numpy as np

_RANDOM = np.random.Generator(np.random.PCG64(20240917))
_BYTE = _RANDOM.integers(0, 2**64, 256, dtype=np.uint64)
_PLACE = _RANDOM.integers(0, 2**64, 1024, dtype=np.uint64) | np.uint64(1)
_COEF = _RANDOM.integers(0, 2**64, 4096, dtype=np.uint64) | np.uint64(1)
_FAR = np.uint64(0x9E3779B97F4A7C15)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Word bytes when words are split at ASCII white space: [^\x20\x09-\x0D]
SPACED = np.ones(256, dtype=bool)
SPACED[[32, *range(9, 14)]] = False
#: Word bytes when words are ASCII letters, digits and everything beyond ASCII: [^\x00-\x2F\x3A-\x60\x7B-\x7F]
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words in which every output bit depends on every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def coefficients(n: int, family: int = 0) -> np.ndarray:
    """n fixed odd multipliers; families are independent of each other."""
    return mix(_COEF[:n] + np.full(1, family, dtype=np.uint64) * _FAR) | np.uint64(1)


class Words:
    """Words of the texts in a buffer: byte ranges, fingerprints, and the first word of each text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, kind: np.ndarray, lower: bool = False):
        data = LOWER[data] if lower else data
        inside = kind[data]
        before = np.empty_like(inside)
        before[:1], before[1:] = False, inside[:-1]
        after = np.empty_like(inside)
        after[-1:], after[:-1] = False, inside[1:]
        edges = offsets[1:-1]
        before[edges[edges < len(data)]] = False
        after[edges[edges > 0] - 1] = False
        self.data = data
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        #: place of the first word of each text, and the number of all words at last
        self.first = np.searchsorted(self.start, offsets)
        length = self.end - self.start
        self.length = length
        if not len(length):
            self.hash = np.zeros(0, dtype=np.uint64)
            return
        at = np.cumsum(length) - length
        place = np.arange(at[-1] + length[-1]) - np.repeat(at, length)
        worth = _PLACE[place & 1023]
        if length.max() > 1024:  # bytes further on get multipliers of their own; those of all other words stay as they are
            far = np.flatnonzero(place > 1023)
            worth[far] = mix(worth[far] + (place[far] >> 10).astype(np.uint64) * _FAR) | np.uint64(1)
        worth *= _BYTE[data[inside]]
        self.hash = mix(np.add.reduceat(worth, at) + length.astype(np.uint64) * _FAR)

    def __len__(self) -> int:
        return len(self.start)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def texts(self) -> np.ndarray:
        """The text that each word belongs to."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def grams(h: np.ndarray, n: int, family: int = 0) -> np.ndarray:
    """Fingerprints of all runs of n consecutive words (those across two texts are the caller's to leave out)."""
    c = coefficients(n, family)
    size = max(0, len(h) - n + 1)
    out = np.zeros(size, dtype=np.uint64)
    for i in range(n):
        out += h[i:i + size] * c[i]
    return mix(out)


def run_hash(h: np.ndarray, start: np.ndarray, length: np.ndarray, family: int = 0) -> np.ndarray:
    """Fingerprint of `length` words from `start`, for runs of different lengths."""
    out = length.astype(np.uint64) * _FAR
    if len(start):
        c = coefficients(int(length.max(initial=0)), family)
        for i in range(len(c)):
            has = np.flatnonzero(length > i)
            out[has] += h[start[has] + i] * c[i]
    return mix(out)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def unsigned(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x, dtype=np.int64).view(np.uint64)


def joined(words: Words, keep: np.ndarray, a: int, b: int) -> bytes:
    """Kept words of [a, b), joined by one space."""
    data, start, end = words.data, words.start, words.end
    if keep[a:b].all():
        return b" ".join(data[start[a]:end[b - 1]].tobytes().split()) if b > a else b""
    kept = np.flatnonzero(keep[a:b]) + a
    if not len(kept):
        return b""
    jump = np.flatnonzero(np.diff(kept) != 1)
    heads, tails = kept[np.r_[0, jump + 1]], kept[np.r_[jump, len(kept) - 1]]
    return b" ".join(b" ".join(data[start[x]:end[y]].tobytes().split()) for x, y in zip(heads, tails))
