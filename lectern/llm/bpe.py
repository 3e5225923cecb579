"""Byte-level BPE encoding and decoding with a given vocabulary.

Bytes are mapped to Latin-1 so that one automaton finds every vocabulary entry in a piece. A piece is covered from
the left by longest matches; a match stands only if it is compatible with the token before it (the merges of both
together give just these two), else a shorter one is tried and, when none is left, the token before is taken back.
Positions that failed are remembered, so the work is linear. Compatibility is memoised per pair of tokens.
"""

from __future__ import annotations

import base64
import hashlib
from pathlib import Path

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lectern.llm.arrow import bounded_batches, with_columns

#: Entries of the per-worker memories; they are emptied when full, which changes no result.
MEMORY = 300_000
#: Longer pieces are encoded anew each time.
REMEMBERED_CHARS = 40
#: A vocabulary beyond this many entries is refused: it is broadcast whole.
LARGEST_VOCABULARY = 2_000_000


def read_ranks(path: str) -> list[bytes]:
    """Vocabulary entries by rank from a file with a base64 entry and its rank on each line."""
    ranks = {}
    for line in Path(path).read_bytes().splitlines():
        if line.strip():
            entry, rank = line.split()
            ranks[int(rank)] = base64.b64decode(entry)
    if len(ranks) > LARGEST_VOCABULARY:
        raise ValueError(f"vocabulary of {len(ranks)} entries; at most {LARGEST_VOCABULARY} are broadcast")
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError("ranks must be 0, 1, 2 ... without gaps")
    return [ranks[i] for i in range(len(ranks))]


class Codec:
    """Encodes texts to ids packed as little-endian unsigned 32-bit integers, and back to bytes."""

    def __init__(self, entries: list[bytes], pattern: str):
        self.entries = entries
        self.rank = {e: i for i, e in enumerate(entries)}
        if len(self.rank) != len(entries):
            raise ValueError("the vocabulary holds an entry twice")
        if any(bytes([b]) not in self.rank for b in range(256)):
            raise ValueError("the vocabulary must hold every single byte")
        self.packed = [i.to_bytes(4, "little") for i in range(len(entries))]
        self.automaton = ahocorasick.Automaton()
        for i, e in enumerate(entries):
            self.automaton.add_word(e.decode("latin-1"), (len(e) - 1, i))
        self.automaton.make_automaton()
        self.pieces = regex.compile(pattern).findall
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        self.shorter: dict[int, int] = {}
        self.halves: dict[int, tuple[int, int]] = {}

    def halves_of(self, token: int) -> tuple[int, int]:
        """The two tokens whose merge makes an entry of two bytes or more."""
        if (found := self.halves.get(token)) is None:
            e = self.entries[token]
            parts = [e[i:i + 1] for i in range(len(e))]
            while len(parts) > 2:
                ranked = [self.rank.get(a + b, token) for a, b in zip(parts, parts[1:])]
                if (best := min(ranked)) >= token:
                    raise ValueError(f"entry {token} cannot be made by merges of smaller rank")
                i = ranked.index(best)
                parts[i:i + 2] = [parts[i] + parts[i + 1]]
            found = self.halves[token] = (self.rank[parts[0]], self.rank[parts[1]])
        return found

    def compatible(self, left: int, right: int) -> bool:
        """Whether two tokens stay as they are side by side.

        Their merges are undone, the latest first; a merge across the border that would have come before the one
        just undone (or as early, but further left) shows that they do not.
        """
        key = (left, right)
        if (found := self.fits.get(key)) is not None:
            return found
        if len(self.fits) >= MEMORY:
            self.fits.clear()
        entries, limit = self.entries, len(self.entries)
        found = True
        while True:
            across = self.rank.get(entries[left] + entries[right])
            if across is not None and across < limit:
                found = False
                break
            made_left = left if len(entries[left]) > 1 else -1
            made_right = right if len(entries[right]) > 1 else -1
            if made_left > made_right:
                limit, left = left, self.halves_of(left)[1]
            elif made_right >= 0:
                limit, right = right + 1, self.halves_of(right)[0]
            else:
                break
        self.fits[key] = found
        return found

    def prefix_of(self, token: int) -> int:
        """The longest entry that is a proper prefix of an entry; -1 if there is none."""
        if (found := self.shorter.get(token)) is None:
            e = self.entries[token]
            found = self.shorter[token] = next((self.rank[e[:n]] for n in range(len(e) - 1, 0, -1) if e[:n] in self.rank), -1)
        return found

    def encode_piece(self, piece: str) -> bytes:
        data = piece.encode()
        if (whole := self.rank.get(data)) is not None:
            return self.packed[whole]
        longest = [0] * len(data)
        for end, (reach, token) in self.automaton.iter(data.decode("latin-1")):
            longest[end - reach] = token  # ends ascend, so the last match of a start is its longest
        tokens: list[int] = []
        failed, pos, token = bytearray(len(data) + 1), 0, longest[0]
        while pos < len(data):
            while token >= 0:
                end = pos + len(self.entries[token])
                if not failed[end] and (not tokens or self.compatible(tokens[-1], token)):
                    break
                token = self.prefix_of(token)
            if token >= 0:
                tokens.append(token)
                pos = end
                token = longest[pos] if pos < len(data) else -1
            else:
                failed[pos] = 1
                token = tokens.pop()
                pos -= len(self.entries[token])
                token = self.prefix_of(token)
        return b"".join([self.packed[t] for t in tokens])

    def encode(self, text: str) -> bytes:
        pieces = self.pieces(text)
        ids = list(map(self.known.get, pieces))
        if None in ids:
            for i, found in enumerate(ids):
                if found is None:
                    ids[i] = self.known.get(pieces[i]) or self.remember(pieces[i])
        return b"".join(ids)

    def remember(self, piece: str) -> bytes:
        made = self.older.get(piece) or self.encode_piece(piece)
        if len(piece) <= REMEMBERED_CHARS:
            if len(self.known) >= MEMORY:
                self.known, self.older = {}, self.known
            self.known[piece] = made
        return made

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.entries.__getitem__, memoryview(ids).cast("I")))


_CODECS: dict[str, Codec] = {}


def _codec(key: str, shared, pattern: str) -> Codec:
    """One codec per worker process and vocabulary, known by the digest that the driver made of it."""
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(shared.value, pattern)
    return _CODECS[key]


def _shared(df: DataFrame, entries: list[bytes], pattern: str):
    digest = hashlib.sha256(pattern.encode())
    for e in entries:
        digest.update(len(e).to_bytes(4, "little") + e)
    return digest.hexdigest(), df.sparkSession.sparkContext.broadcast(entries)


def encode(df: DataFrame, entries: list[bytes], pattern: str, text: str = "text", ids: str = "ids",
           count: str = "n_tokens") -> DataFrame:
    """Adds the ids of each text (packed little-endian unsigned 32-bit integers) and their number.

    Each match of the pattern is encoded by itself, without special tokens. Null and empty texts get no ids and 0.
    Rows stay as they are, repeated ones too; columns named like the two outputs are replaced. A vocabulary with an
    entry that merges of smaller rank cannot make raises an error in the task that first meets it.
    """
    key, shared = _shared(df, entries, pattern)

    def step(texts: pa.Array) -> list[pa.Array]:
        codec = _codec(key, shared, pattern)
        made = [codec.encode(t) if t else b"" for t in texts.to_pylist()]
        return [pa.array(made, pa.binary()), pa.array([len(m) // 4 for m in made], pa.int64())]

    fields = T.StructType([T.StructField(ids, T.BinaryType()), T.StructField(count, T.LongType())])
    return with_columns(bounded_batches(df), [text], fields, step)


def decode(df: DataFrame, entries: list[bytes], pattern: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Adds the bytes that packed ids stand for; null ids give empty bytes. An id outside the vocabulary is an error."""
    key, shared = _shared(df, entries, pattern)

    def step(packed: pa.Array) -> list[pa.Array]:
        codec = _codec(key, shared, pattern)
        return [pa.array([codec.decode(x) if x else b"" for x in packed.to_pylist()], pa.binary())]

    return with_columns(df, [ids], T.StructType([T.StructField(decoded, T.BinaryType())]), step)
