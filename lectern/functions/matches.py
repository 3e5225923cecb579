"""Places of dictionary words in texts, row by row inside Spark tasks.

A text is cut into units before each time mark and after each line end; a match stands in one unit.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from lectern.llm.arrow import byte_lengths, importable, slices

NO_MARK, CONTEXT = "--:--", 20
_MARK = re.compile(r"\[([0-9]{1,2}:[0-9]{2})\]")
#: Bits of the filter of word beginnings and words, and characters of a beginning at most.
FILTER_BITS, HEAD = 20, 3
#: Characters of a text that are hashed at once.
BLOCK = 1 << 20
_BASE, _MIX = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def units(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, nearest time mark to the left) of each unit."""
    cuts = {m.start() for m in _MARK.finditer(text)} | {m.end() for m in re.finditer("\n", text)}
    at, ts = 0, NO_MARK
    for cut in sorted(cuts | {len(text)}):
        if cut > at:
            mark = _MARK.match(text, at)
            ts = mark[1] if mark else ts
            yield at, cut, ts
            at = cut


def _context(text: str, a: int, b: int) -> str:
    return f"{text[max(0, a - CONTEXT):a]}【{text[a:b]}】{text[b:b + CONTEXT]}".replace("\r", " ").replace("\n", " ")


def _found(rows: DataFrame, fields: str, prepare: Callable[[], Callable[[str, str], Iterator[tuple]]]) -> DataFrame:
    """Rows ``(key, text, folded text)`` opened to the key and the ``fields`` of each tuple of the function that ``prepare`` makes in a task."""
    schema = T.StructType([rows.schema.fields[0], *T.StructType.fromDDL(fields).fields])
    types = [pa.int32() if f.dataType == T.IntegerType() else pa.string() for f in schema.fields[1:]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = prepare()
        for batch in batches:
            for a, b in slices(byte_lengths(batch.column(1))):
                part = batch.slice(a, b - a)
                at, hits = [], []
                for i, (text, low) in enumerate(zip(part.column(1).to_pylist(), part.column(2).to_pylist())):
                    for hit in one(text, low) if text is not None else ():
                        at.append(i)
                        hits.append(hit)
                if at:
                    columns = [pa.array(c, t) for c, t in zip(zip(*hits), types)]
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at, pa.int32())), *columns], names=schema.names)

    return importable(rows).mapInArrow(run, schema)


def pattern_matches(rows: DataFrame, pattern: str) -> DataFrame:
    """Matches of the pattern in the folded text, unit by unit from left to right."""
    def prepare():
        search = re.compile(pattern).finditer

        def one(text: str, low: str) -> Iterator[tuple]:
            for no, (start, end, ts) in enumerate(units(text)):
                for k, m in enumerate(search(low, start, end), 1):
                    a, b = m.span()
                    yield no, k, ts, text[a:b], _context(text, a, b), m[0]

        return one

    return _found(rows, "unit_no int, hit_no int, ts string, wrong string, context string, _key string", prepare)


def replace_matches(rows: DataFrame, pattern: str, right: dict[str, str]) -> DataFrame:
    """``(key, text)`` with the matches in the folded text that have a replacement replaced in the text."""
    schema = T.StructType(rows.schema.fields[:2])

    def one(text: str | None, low: str) -> str | None:
        if text is None:
            return None
        out, at = [], 0
        for m in re.compile(pattern).finditer(low):
            if (new := right.get(m[0])) is not None:
                out += text[at:m.start()], new
                at = m.end()
        return "".join(out) + text[at:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(byte_lengths(batch.column(1))):
                part = batch.slice(a, b - a)
                texts = [one(*t) for t in zip(part.column(1).to_pylist(), part.column(2).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], names=schema.names)

    return importable(rows).mapInArrow(run, schema)


def _powers(size: int, base: int) -> np.ndarray:
    out = np.full(size, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)


def _bits(sums: np.ndarray, size: int) -> np.ndarray:
    """Place in the filter of character sequences of one size, by their weighted sums."""
    mixed = (sums ^ np.uint64(size)) * np.uint64(_MIX)
    return ((mixed ^ (mixed >> np.uint64(29))) * np.uint64(_BASE)) >> np.uint64(64 - FILTER_BITS)


def word_filter(keys: DataFrame, head: int) -> bytes:
    """Bit array, of fixed size whatever the dictionary, of its words and of their first ``head`` characters."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = []
            for word in batch.column(0).to_pylist():
                codes = _codes(word)
                sums = np.cumsum(codes * _powers(len(codes), _BASE))
                for n in {head, len(codes)}:
                    bits += _bits(sums[n - 1:n] if n else np.zeros(1, np.uint64), n).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(bits, pa.int64())], names=["b"])

    marked = importable(keys.select("key")).mapInArrow(run, "b long")
    slots = marked.groupBy(F.expr("b div 32").alias("slot")).agg(F.expr("bit_or(shiftleft(1L, cast(b % 32 AS int)))").alias("bits"))
    words = np.zeros((1 << FILTER_BITS) // 32, "<u4")
    for r in slots.collect():
        words[r.slot] = r.bits
    return words.tobytes()


def word_places(rows: DataFrame, sizes: Sequence[int], head: int, table: bytes, around: bool) -> DataFrame:
    """Grams of the given sizes, each in one unit of its text, that the filter of the dictionary lets through; with what is ``around`` them."""
    longest = max(sizes)

    def prepare():
        there = np.unpackbits(np.frombuffer(table, np.uint8), bitorder="little").view(bool)

        def one(text: str, low: str) -> Iterator[tuple]:
            parts = list(units(text))
            ends = np.array([end for _, end, _ in parts], np.int64)
            for first in range(0, len(low), BLOCK):
                codes = _codes(low[first:first + BLOCK + longest])
                powers, back = _powers(len(codes) + 1, _BASE), _powers(len(codes) + 1, pow(_BASE, -1, 1 << 64))
                sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(codes * powers[:-1])))
                at = np.arange(min(BLOCK, len(codes) - head + 1))
                at = at[there[_bits((sums[at + head] - sums[at]) * back[at], head)]]
                unit = np.searchsorted(ends, at + first, "right")
                for n in sizes:
                    inside = at + n + first <= ends[np.minimum(unit, len(ends) - 1)]
                    a, u = at[inside], unit[inside]
                    hit = there[_bits((sums[a + n] - sums[a]) * back[a], n)]
                    for i, no in zip((a[hit] + first).tolist(), u[hit].tolist()):
                        start, _, ts = parts[no]
                        shown = (ts, text[i:i + n], _context(text, i, i + n)) if around else ()
                        yield no, i - start + 1, n, low[i:i + n], *shown

        return one

    return _found(rows, "unit_no int, pos int, n int, key string" + (", ts string, wrong string, context string" if around else ""), prepare)
