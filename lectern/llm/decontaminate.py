"""Benchmark decontamination: suffix arrays over shards of the training texts, searched for every test suffix.

A shard is a slice of documents. Its suffixes are sorted by their words; each test suffix is found in them by binary
search, which gives all places where at least a window of it stands. Suffixes whose first words begin no test window
cannot be found and are left out before sorting. Neighbouring windows on one diagonal form the longest match.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.arrow import bounded_batches, text_buffer, with_columns
from lectern.llm.words import ALNUM, Words, mix

WINDOW = 10
#: Test windows that are broadcast at once (80 bytes each); a larger benchmark is searched in several blocks.
BLOCK_WINDOWS = 200_000
_FILTER_BITS = 22


def _keys(h: np.ndarray, start: np.ndarray, end: np.ndarray, fill: int) -> np.ndarray:
    """The next WINDOW words from each start as one sortable byte string; what lies behind the end is filled."""
    place = start[:, None] + np.arange(WINDOW)
    inside = place < end[:, None]
    words = np.where(inside, h[np.minimum(place, max(0, len(h) - 1))] | np.uint64(1), np.uint64(0))
    raw = np.ascontiguousarray(words.astype(">u8")).view(np.uint8).reshape(len(start), WINDOW * 8)
    if fill:
        raw[np.repeat(~inside, 8, axis=1)] = fill
    return raw.view(f"S{WINDOW * 8}").ravel()


class TestSuffixes:
    """Windows of the benchmark items of one block, ready to be searched for."""

    def __init__(self, items: list[str], texts: list[str]):
        data, offsets = text_buffer(pa.array(texts, pa.string()))
        words = Words(data, offsets, ALNUM, lower=True)
        first, count = words.first[:-1], words.counts
        size = np.minimum(count, WINDOW)
        windows = np.where(count > 0, count - size + 1, 0)
        self.items = items
        self.item = np.repeat(np.arange(len(items)), windows)
        self.offset = np.arange(len(self.item)) - np.repeat(np.cumsum(windows) - windows, windows)
        start = first[self.item] + self.offset
        self.size = size[self.item]
        self.low = _keys(words.hash, start, start + self.size, 0)
        self.high = _keys(words.hash, start, start + self.size, 255)
        h = words.hash
        self.one, self.two = np.zeros(1 << _FILTER_BITS, bool), np.zeros(1 << _FILTER_BITS, bool)
        if len(start):
            single = self.size == 1
            self.one[h[start[single]] & np.uint64(self.one.size - 1)] = True
            pairs = start[~single]
            self.two[_pair(h[pairs], h[pairs + 1]) & np.uint64(self.two.size - 1)] = True

    def search(self, words: Words) -> list[list[dict]]:
        """For each text of a shard, its matches: item, place in the item, place in the text, words."""
        h, bounds = words.hash, words.first
        found: list[list[dict]] = [[] for _ in range(len(bounds) - 1)]
        if not len(h) or not len(self.low):
            return found
        wanted = self.one[h & np.uint64(self.one.size - 1)]
        wanted[:-1] |= self.two[_pair(h[:-1], h[1:]) & np.uint64(self.two.size - 1)]
        suffix = np.flatnonzero(wanted)
        end = bounds[np.searchsorted(bounds, suffix, side="right")]
        keys = _keys(h, suffix, end, 0)
        order = np.argsort(keys, kind="stable")  # the suffix array of the shard
        keys, suffix = keys[order], suffix[order]
        low, high = np.searchsorted(keys, self.low, "left"), np.searchsorted(keys, self.high, "right")
        hits = high - low
        test = np.repeat(np.arange(len(hits)), hits)
        at = suffix[np.repeat(low - np.cumsum(hits) + hits, hits) + np.arange(hits.sum())]
        if not len(at):
            return found
        item, offset, size = self.item[test], self.offset[test], self.size[test]
        text = np.searchsorted(bounds, at, side="right") - 1
        order = np.lexsort((at, at - offset, item, text))
        item, offset, size, at, text = (x[order] for x in (item, offset, size, at, text))
        new = np.r_[True, (text[1:] != text[:-1]) | (item[1:] != item[:-1]) | (np.diff(at - offset) != 0) | (np.diff(at) != 1)]
        heads = np.flatnonzero(new)
        tails = np.r_[heads[1:], len(new)] - 1
        for a, b in zip(heads, tails):
            found[text[a]].append({"item": self.items[item[a]], "item_word": int(offset[a]),
                                   "word": int(at[a] - bounds[text[a]]), "words": int(at[b] - at[a] + size[b])})
        return found


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * np.uint64(3) + b)


_MATCH = T.ArrayType(T.StructType([T.StructField("item", T.StringType()), T.StructField("item_word", T.IntegerType()),
                                   T.StructField("word", T.IntegerType()), T.StructField("words", T.IntegerType())]))
_ARROW = pa.list_(pa.struct([("item", pa.string()), ("item_word", pa.int32()), ("word", pa.int32()), ("words", pa.int32())]))


def _blocks(benchmark: DataFrame, item: str, text: str) -> list[TestSuffixes]:
    """The benchmark in blocks; it streams through the driver once, a partition at a time."""
    blocks, items, texts, size = [], [], [], 0
    rows = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("null")).alias("i"), F.col(text).alias("t"))
    for r in rows.orderBy("i", "t").toLocalIterator():
        items.append(r["i"])
        texts.append(r["t"] or "")
        size += len(texts[-1]) // 2 + 1  # at most so many words
        if size >= BLOCK_WINDOWS:
            blocks.append(TestSuffixes(items, texts))
            items, texts, size = [], [], 0
    if items or not blocks:
        blocks.append(TestSuffixes(items, texts))
    return blocks


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id",
                  item_text: str = "text") -> DataFrame:
    """Adds n_words, n_hit (words inside any match), items (sorted different item ids) and matches to each document.

    Null and empty texts have no words and no match; items without words match nothing; a null item id counts as
    "null"; items of one id count once. Repeated documents get the same result each.
    """
    shared = [docs.sparkSession.sparkContext.broadcast(b) for b in _blocks(benchmark, item, item_text)]

    def step(texts: pa.Array) -> list[pa.Array]:
        words = Words(*text_buffer(texts), ALNUM, lower=True)
        found = shared[0].value.search(words)
        for more in shared[1:]:
            found = [x + y for x, y in zip(found, more.value.search(words))]
        hit, items = [], []
        for matches in found:
            covered, last = 0, 0
            for m in sorted(matches, key=lambda m: m["word"]):
                end = m["word"] + m["words"]
                covered += max(0, end - max(last, m["word"]))
                last = max(last, end)
            hit.append(covered)
            items.append(sorted({m["item"] for m in matches}))
        return [pa.array(words.counts, pa.int64()), pa.array(hit, pa.int64()), pa.array(items, pa.list_(pa.string())),
                pa.array(found, _ARROW)]

    outputs = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()),
                            T.StructField("items", T.ArrayType(T.StringType())), T.StructField("matches", _MATCH)])
    return with_columns(bounded_batches(docs), [text], outputs, step)


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """Documents without a word inside a match; columns as they were."""
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.col(text).alias("__text"))
    return contamination(own, benchmark, "__text").where("n_hit = 0").select("__row.*")
