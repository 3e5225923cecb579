"""Dedup of long repeats over content-selected minimiser positions.

Of each window of words, the position whose first words have the lowest fingerprint is kept. The kept positions of all
documents are sorted over the cluster by fingerprints, of their first words and then of all that their windows cover;
equal neighbours are repeats, and neighbours that share only their first words are compared window by window. There is
no order of suffixes by their words.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from lectern.llm.repeats import Scheme, remove_repeats
from lectern.llm.words import grams

#: Least length of a repeat in words, and words that a minimiser is chosen by.
WINDOW, HEAD = 50, 8


def minimiser_ranks(h: np.ndarray) -> np.ndarray:
    ranks = np.full(len(h), 2**64 - 1, dtype=np.uint64)
    found = grams(h, HEAD)
    ranks[:len(found)] = found
    return ranks


def suffix_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """Removes each word inside a repeat of `window` words or more that also stands earlier.

    See `repeats.remove_repeats` for the columns, and for null, empty and repeated rows.
    """
    return remove_repeats(docs, Scheme(window, 0, HEAD, minimiser_ranks), key, text)
