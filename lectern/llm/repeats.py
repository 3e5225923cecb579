"""Word windows that stand earlier in the corpus, found from places that the words themselves select.

Shared by substring dedup and suffix-array dedup, which differ in how they select places. Each window holds exactly
one selected place, told by the window's own words; the neighbouring windows of one place form a row with two
fingerprints: the core (words that all these windows share) and the extent (all words of these windows).

1. Rows are sorted over the cluster by core, extent, document and place. Equal neighbours are equal in all their
   windows, so all but the first are repeats. A row whose core has one extent only, once, is new.
2. The first rows of cores with several extents are compared window by window.

Sorting is by ranges of the whole key, so that a frequent core spreads over tasks; classes at the edge of a task are
compared window by window too, which makes the result independent of the partitioning. Equal rows of one slice of
documents meet before the shuffle. Nothing is collected.

Documents are told apart by id and text: rows equal in both are one document and get equal results, that of one of
them alone; among equal ids, a 64-bit fingerprint of the text (mark) orders them; a null id comes first. Null and empty
texts have no words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.arrow import bounded_batches, importable, shared_folder, slices, text_buffer
from lectern.llm.words import SPACED, Words, grams, joined, mix, run_hash, signed, unsigned

_NULL_ID = -(2**63)


class Scheme:
    """How windows of `window` words select a place: `rank` gives each word a rank that depends on the words from
    `before` before it to `after` behind it only; a window takes its lowest rank, the leftmost of equals."""

    def __init__(self, window: int, before: int, after: int, rank: Callable[[np.ndarray], np.ndarray]):
        if window < before + after:
            raise ValueError("a window must hold the words that a rank depends on")
        self.window, self.before, self.after, self.rank = window, before, after, rank

    def rows(self, words: Words) -> tuple[np.ndarray, ...]:
        """Text, first window, number of windows, core and extent of each selected place."""
        h, first = words.hash, words.first
        ends = np.repeat(first[1:], words.counts)
        start = np.flatnonzero(np.arange(len(h)) + self.window <= ends)
        if not len(start):
            none = np.zeros(0, dtype=np.int64)
            return none, none, none, none.view(np.uint64), none.view(np.uint64)
        low = _lowest(self.rank(h), self.window - self.after - self.before + 1)
        place = low[start + self.before]
        new = np.r_[True, (np.diff(place) != 0) | (np.diff(start) != 1)]
        heads = np.flatnonzero(new)
        windows = np.diff(np.r_[heads, len(start)])
        start, place = start[heads], place[heads]
        core = grams(h, self.before + self.after, 1)[place - self.before]
        extent = run_hash(h, start, windows + self.window - 1, 2)
        return (np.searchsorted(first, start, side="right") - 1, start, windows, core,
                mix(extent + (place - start).astype(np.uint64)))


def _lowest(rank: np.ndarray, width: int) -> np.ndarray:
    """Place of the lowest rank among `width` words from each word, the leftmost of equals."""
    at, span = np.arange(len(rank)), 1
    while span < width:
        step = min(span, width - span)
        left, right = at[:-step], at[step:]
        at = np.where(rank[left] <= rank[right], left, right)
        span += step
    return at


_ROWS = T.StructType([T.StructField(n, T.LongType()) for n in ("core", "extent", "doc", "mark")]
                     + [T.StructField("at", T.IntegerType()), T.StructField("windows", T.IntegerType())])
_FOUND = T.StructType([T.StructField("doc", T.LongType()), T.StructField("mark", T.LongType()),
                       T.StructField("start", T.IntegerType()), T.StructField("windows", T.IntegerType()),
                       T.StructField("settled", T.BooleanType())])
_WINDOWS = T.StructType([T.StructField(n, T.LongType()) for n in ("w1", "w2", "doc", "mark")]
                        + [T.StructField("at", T.IntegerType()), T.StructField("settled", T.BooleanType())])


def _batch(schema: T.StructType, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=schema.fieldNames())


def _classes(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted rows: those that open a class of equals in the first two keys, and those equal to that one in all keys
    (the same place of the same document, again)."""
    opens = np.ones(len(keys[0]), dtype=bool)
    opens[1:] = (keys[0][1:] != keys[0][:-1]) | (keys[1][1:] != keys[1][:-1])
    head = np.maximum.accumulate(np.where(opens, np.arange(len(opens)), 0))
    again = ~opens
    for k in keys[2:]:
        again &= k == k[head]
    return opens, again


def _not_first(*keys: np.ndarray) -> np.ndarray:
    """Rows that equal an earlier one of another place in the first two keys, where order is by all keys."""
    order = np.lexsort(keys[::-1])
    opens, again = _classes(*[k[order] for k in keys])
    out = np.zeros(len(order), dtype=bool)
    out[order] = ~opens & ~again
    return out


def _own_key(doc: np.ndarray, mark: np.ndarray, at: np.ndarray) -> np.ndarray:
    return mix(unsigned(doc) + mix(unsigned(mark) + mix(unsigned(at))))


def _places(scheme: Scheme):
    def run(batches):
        for batch in batches:
            texts, doc, mark = batch.column(0), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            data, offsets = text_buffer(texts)
            for a, b in slices(np.diff(offsets)):
                words = Words(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], SPACED)
                text, start, windows, core, extent = scheme.rows(words)
                at = (start - words.first[text]).astype(np.int32)
                doc_of, mark_of = doc[a:b][text], mark[a:b][text]
                repeat = _not_first(signed(core), signed(extent), doc_of, mark_of, at)
                # a repeat found here needs no partner: it travels under a key of its own, with its windows negative
                core = np.where(repeat, _own_key(doc_of, mark_of, at), core)
                yield _batch(_ROWS, signed(core), signed(extent), doc_of, mark_of, at,
                             np.where(repeat, -windows, windows).astype(np.int32))
    return run


def _neighbours(batches) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by core, extent, doc, mark and at: repeats (settled), and firsts to be compared window by window."""
    held, held_shares = None, True  # the first row of the last class, and whether it shares its core with the one before

    def out(doc, mark, at, windows, settled):
        return _batch(_FOUND, doc, mark, at, np.abs(windows).astype(np.int32), settled)

    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(i).to_numpy() for i in range(6)]
        if held is not None:
            columns = [np.concatenate([[x], c]).astype(c.dtype) for x, c in zip(held, columns)]
        core, extent, doc, mark, at, windows = columns
        opens, again = _classes(*columns[:5])
        heads = np.flatnonzero(opens)
        shared = core[heads[1:]] == core[heads[:-1]]
        shares = np.r_[held_shares, shared]  # with the class before
        compare = shares.copy()
        compare[:-1] |= shared  # or with the next one
        settled = ~opens & ~again | (windows < 0)
        keep = settled.copy()
        keep[heads[compare]] = True
        last = heads[-1]
        held, held_shares = [c[last] for c in columns], bool(shares[-1])
        keep[last] = False
        yield out(doc[keep], mark[keep], at[keep], windows[keep], settled[keep])
    if held is not None:
        doc, mark, at, windows = (np.array([x]) for x in held[2:])
        yield out(doc, mark, at, windows, windows < 0)


def _pack(batches) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        packed = [pa.compress(t.encode(), "zstd", asbytes=True) for t in batch.column(0).to_pylist()]
        sizes = np.diff(text_buffer(batch.column(0))[1]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(packed, pa.binary()), pa.array(sizes), *batch.columns[1:]],
                                         names=["packed", "size", "doc", "mark"])


def _unpacked(batch: pa.RecordBatch) -> Iterator[tuple[int, int, Words]]:
    sizes = batch.column("size").to_numpy()
    packed = batch.column("packed")
    for a, b in slices(sizes):
        data = b"".join(pa.decompress(packed[i].as_py(), int(sizes[i]), "zstd", asbytes=True) if sizes[i] else b"" for i in range(a, b))
        offsets = np.r_[0, np.cumsum(sizes[a:b], dtype=np.int64)]
        yield a, b, Words(np.frombuffer(data, dtype=np.uint8), offsets, SPACED)


def _list(column: pa.Array, a: int, b: int) -> tuple[np.ndarray, pa.Array]:
    """Row number of each entry of a list column, and the entries; null lists are empty."""
    part = column.slice(a, b - a)
    entries = part.flatten()
    counts = np.array([0 if n is None else n for n in part.value_lengths().to_pylist()], dtype=np.int64)
    return np.repeat(np.arange(b - a), counts), entries


def _spread(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    return np.repeat(start - np.cumsum(count) + count, count) + np.arange(count.sum())


def _window_rows(size: int):
    def run(batches):
        for batch in batches:
            doc, mark = batch.column("doc").to_numpy(), batch.column("mark").to_numpy()
            for a, b, words in _unpacked(batch):
                row, zones = _list(batch.column("open"), a, b)
                count = zones.field("windows").to_numpy()
                start = _spread(zones.field("start").to_numpy().astype(np.int64), count)
                row = np.repeat(row, count)
                place = words.first[row] + start
                w1, w2 = (signed(grams(words.hash, size, f)[place]) if len(place) else np.zeros(0, np.int64) for f in (3, 4))
                doc_of, mark_of, at = doc[a:b][row], mark[a:b][row], start.astype(np.int32)
                repeat = _not_first(w1, w2, doc_of, mark_of, at)
                w1 = np.where(repeat, signed(_own_key(doc_of, mark_of, at)), w1)
                yield _batch(_WINDOWS, w1, w2, doc_of, mark_of, at, repeat)
    return run


def _apply(size: int):
    def run(batches):
        for batch in batches:
            for a, b, words in _unpacked(batch):
                change = np.zeros(len(words) + 1, dtype=np.int64)
                row, zones = _list(batch.column("closed"), a, b)
                start = words.first[row] + zones.field("start").to_numpy()
                np.add.at(change, start, 1)
                np.add.at(change, start + zones.field("windows").to_numpy() + size - 1, -1)
                row, single = _list(batch.column("single"), a, b)
                start = words.first[row] + single.to_numpy()
                np.add.at(change, start, 1)
                np.add.at(change, start + size, -1)
                keep = np.cumsum(change[:-1]) == 0
                first = words.first
                kept = [joined(words, keep, first[i], first[i + 1]) for i in range(b - a)]
                removed = np.concatenate([[0], np.cumsum(~keep)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc").slice(a, b - a), batch.column("mark").slice(a, b - a), pa.array(words.counts, pa.int64()),
                     pa.array(np.diff(removed[first]), pa.int64()), pa.array([k.decode() for k in kept], pa.string())],
                    names=["doc", "mark", "n_words", "n_removed", "kept"])
    return run


def remove_repeats(docs: DataFrame, scheme: Scheme, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: its key, n_words, n_removed, and kept (the words that stay, joined by one space)."""
    shared_folder(docs.sparkSession)
    numbered = bounded_batches(importable(docs)).select(
        F.coalesce(F.col(text), F.lit("")).alias("text"),
        F.coalesce(F.col(key).cast("long"), F.lit(_NULL_ID)).alias("doc"),
        F.xxhash64(text).alias("mark"))
    rows = numbered.mapInArrow(_places(scheme), _ROWS)
    ordered = ["core", "extent", "doc", "mark", "at"]
    found = (rows.repartitionByRange(*ordered).sortWithinPartitions(*ordered).mapInArrow(_neighbours, _FOUND)
             .groupBy("doc", "mark").agg(
                 F.collect_list(F.when(F.col("settled"), F.struct("start", "windows"))).alias("closed"),
                 F.collect_list(F.when(~F.col("settled"), F.struct("start", "windows"))).alias("open")))
    found = found.checkpoint()
    packed = numbered.mapInArrow(_pack, T.StructType([
        T.StructField("packed", T.BinaryType()), T.StructField("size", T.IntegerType()),
        T.StructField("doc", T.LongType()), T.StructField("mark", T.LongType())]))
    opened = packed.join(found.where(F.size("open") > 0).select("doc", "mark", "open"), ["doc", "mark"])
    ranked = Window.partitionBy("w1", "w2").orderBy("doc", "mark", "at")  # rows of one document have one rank
    single = (opened.mapInArrow(_window_rows(scheme.window), _WINDOWS)
              .withColumn("n", F.rank().over(ranked)).where("settled or n > 1")
              .groupBy("doc", "mark").agg(F.collect_set("at").alias("single")))
    both = packed.join(found.select("doc", "mark", "closed"), ["doc", "mark"], "left").join(single, ["doc", "mark"], "left")
    kept = both.mapInArrow(_apply(scheme.window), T.StructType([
        T.StructField("doc", T.LongType()), T.StructField("mark", T.LongType()), T.StructField("n_words", T.LongType()),
        T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())]))
    return kept.select(F.when(F.col("doc") != _NULL_ID, F.col("doc")).alias(key), "n_words", "n_removed", "kept")
