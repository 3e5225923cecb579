"""Substring dedup by recompression.

In each round, equal neighbouring symbols become one symbol (a run), then a symbol of the left class and one of the
right class that follow each other become one (a pair); classes are told by the symbols' names. A name is a 64-bit
fingerprint of what the symbol stands for, so every task gives equal runs and pairs the same name without exchanging
a dictionary, and equal substrings are cut into the same symbols but for a few at their ends. For each symbol the
words that its cut depends on are tracked; a symbol whose cut depends on words outside the core around it may differ
between two copies and is not used; what stands outside the slice of texts at hand is unknown, so a symbol that depends on it is
not used either. Windows take the place of the highest-level symbol in them (of equals, the lowest
name); where a window holds no certain symbol, words stand for themselves. The Spark rounds in `repeats` then compare
shared symbols by core and extent, and verify windows word run by word run.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from lectern.llm.repeats import Scheme, remove_repeats
from lectern.llm.words import mix

WINDOW = 20
#: Words before and behind the start of a symbol that its cut may depend on.
BEFORE, AFTER = 1, 5
#: In place of words outside the slice.
_UNKNOWN_LOW, _UNKNOWN_HIGH = -(2**62), 2**62
_RUN, _LEFT, _RIGHT, _CLASS = (np.uint64(x) for x in (
    0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3))


class _Symbols:
    """Symbols of one level: name, first word, and the words [low, high) that their cut depends on."""

    def __init__(self, name, start, low, high, made):
        self.name, self.start, self.low, self.high, self.made = name, start, low, high, made

    def runs(self) -> "_Symbols":
        name = self.name
        if len(name) < 2:
            return self
        heads = np.flatnonzero(np.r_[True, name[1:] != name[:-1]])
        tails = np.r_[heads[1:], len(name)] - 1
        length = tails - heads + 1
        return _Symbols(np.where(length > 1, mix(name[heads] * _RUN + length.astype(np.uint64)), name[heads]),
                        self.start[heads], np.r_[_UNKNOWN_LOW, self.low][heads],
                        np.r_[self.high, _UNKNOWN_HIGH][tails + 1], length > 1)

    def pairs(self) -> "_Symbols":
        name = self.name
        if len(name) < 2:
            return self
        left = (mix(name ^ _CLASS) & np.uint64(1)) == 0
        opens = np.r_[left[:-1] & ~left[1:], False]
        stays = np.r_[True, ~opens[:-1]]
        at = np.flatnonzero(stays)
        paired = opens[at]
        second = np.minimum(at + 1, len(name) - 1)
        return _Symbols(np.where(paired, mix(name[at] * _LEFT + mix(name[second] * _RIGHT)), name[at]), self.start[at],
                        np.where(paired, self.low[at], np.minimum(self.low[at], np.r_[_UNKNOWN_LOW, self.low][at])),
                        np.maximum(self.high[at], np.r_[self.high, _UNKNOWN_HIGH][at + 1]), paired | self.made[at])


def symbol_ranks(h: np.ndarray) -> np.ndarray:
    """Rank of each word as a place: second-level symbols first, then first-level ones, then plain words."""
    at = np.arange(len(h))
    rank = (h >> np.uint64(2)) | (np.uint64(2) << np.uint64(62))
    level = _Symbols(h, at, at, at + 1, np.zeros(len(h), dtype=bool)).runs().pairs()
    for top in (1, 0):
        sure = level.made & (level.low >= level.start - BEFORE) & (level.high <= level.start + AFTER)
        rank[level.start[sure]] = (level.name[sure] >> np.uint64(2)) | (np.uint64(top) << np.uint64(62))
        level = level.pairs()
    return rank


def substring_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """Removes each word covered by a window of `window` words whose sequence also starts earlier.

    See `repeats.remove_repeats` for the columns, and for null, empty and repeated rows.
    """
    return remove_repeats(docs, Scheme(window, BEFORE, AFTER, symbol_ranks), key, text)
