"""Encoding and decoding with a merge-type piece model (BPE over characters, byte fallback), exactly as its library does.

White space becomes a mark, a mark is put in front, and pieces are found by backtracking: an automaton gives the
longest piece at each character; a piece stands only if it is compatible with the one before it, that is if merging the
characters of both again gives just these two; else a shorter one is tried and, when none is left, the piece before is
taken back. A bitfield holds the positions that failed, so the work is linear. Characters that no piece holds become
one id per byte. Texts are cut where no piece of the model runs on (as between letters and the mark of the next word), the
words between the cuts are encoded one by one and remembered; a model without such places gets whole texts.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Callable, Iterator
from pathlib import Path

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.arrow import byte_lengths, importable, slices

MARK = "▁"
LOWEST = float("-inf")
#: Kinds of pieces in a model file.
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
#: Entries of the per-worker memories; they are emptied when full, which changes no result.
MEMORY = 200_000
#: Longer words are encoded anew each time.
REMEMBERED_CHARS = 40
#: A model file beyond this many bytes is refused: it is broadcast whole.
LARGEST_MODEL = 64_000_000


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of the fields of one protocol-buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        field, kind = divmod(number(), 8)
        if kind == 0:
            yield field, number()
            continue
        size = {1: 8, 5: 4}.get(kind) or number()
        yield field, data[at:at + size]
        at += size


def read_model(path: str) -> bytes:
    """The bytes of a model file, after a check that its settings are those that this module follows."""
    data = Path(path).read_bytes()
    if len(data) > LARGEST_MODEL:
        raise ValueError(f"model of {len(data)} bytes; at most {LARGEST_MODEL} are broadcast")
    PieceModel(data)
    return data


class PieceModel:
    """Pieces and settings of a model; turns ids back to text."""

    def __init__(self, model: bytes):
        self.pieces: list[str] = []
        self.kinds: list[int] = []
        scores: list[float] = []
        trainer: dict = {}
        normalizer: dict = {}
        for field, value in _fields(model):
            if field == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece[1].decode())
                scores.append(struct.unpack("<f", piece.get(2, bytes(4)))[0])
                self.kinds.append(piece.get(3, NORMAL))
            elif field == 2:
                trainer = dict(_fields(value))
            elif field == 3:
                normalizer = dict(_fields(value))
        if trainer.get(3, 1) != 2 or trainer.get(24, 0) or not trainer.get(35, 0):
            raise ValueError("only merge models with byte fallback and leading white-space marks are supported")
        if normalizer.get(2) or normalizer.get(4, 1) or not normalizer.get(5, 1):
            raise ValueError("only models that keep characters and white space as they are are supported")
        if set(self.kinds) - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("pieces defined by users and unused pieces are not supported")
        self.front = MARK if normalizer.get(3, 1) else ""
        self.id = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == NORMAL}
        self.scores = scores
        self.bytes = {int(p[1:-1], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == BYTE}
        if len(self.bytes) != 256:
            raise ValueError("the model must hold a piece for every byte")
        self.end_id = self.pieces.index("</s>")
        unknown = trainer.get(44, " ⁇ ".encode())
        self.surface = [{CONTROL: b"", UNKNOWN: unknown}.get(k, p.replace(MARK, " ").encode())
                        for p, k in zip(self.pieces, self.kinds)]
        for byte, i in self.bytes.items():
            self.surface[i] = bytes([byte])

    def decode(self, ids: list[int]) -> str:
        data = b"".join(map(self.surface.__getitem__, ids))
        try:
            text = data.decode()
        except UnicodeDecodeError:
            text = self.decode_broken(ids)
        if self.front and text.startswith(" "):
            first = next(i for i in ids if self.kinds[i] != CONTROL)
            if self.kinds[first] == NORMAL:
                return text[1:]
        return text

    def decode_broken(self, ids: list[int]) -> str:
        """Each byte of a run of byte pieces that begins no character becomes the replacement character."""
        out: list[str] = []
        run = b""
        for i in [*ids, -1]:
            if i >= 0 and self.kinds[i] == BYTE:
                run += self.surface[i]
                continue
            while run:
                for n in range(1, 5):
                    try:
                        out.append(run[:n].decode())
                        break
                    except UnicodeDecodeError:
                        pass
                else:
                    n = 1
                    out.append("�")
                run = run[n:]
            if i >= 0:
                out.append(self.surface[i].decode())
        return "".join(out)


class PieceCodec(PieceModel):
    """Encodes texts to ids packed as little-endian signed 32-bit integers, too."""

    def __init__(self, model: bytes):
        super().__init__(model)
        self.score = {p: self.scores[i] for p, i in self.id.items()}
        self.packed = {p: struct.pack("<i", i) for p, i in self.id.items()}
        #: characters that pieces hold but that are no pieces: merges may start from them
        self.tokens = set(self.id) | {c for p in self.id for c in p}
        self.automaton = ahocorasick.Automaton()
        for p in self.tokens:
            if len(p) > 1:  # single characters need no search
                self.automaton.add_word(p, (len(p) - 1, p))
        self.automaton.make_automaton()
        self.words = self.parts()
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.fits: dict[tuple[str, str], bool] = {}
        self.made: dict[str, tuple[list[tuple[float, str]], list[tuple[float, str]]] | None] = {}
        self.shorter: dict[str, str] = {}

    def parts(self) -> Callable[[str], list[str]]:
        """Cuts a text where no piece of the model runs on, so that nothing is ever merged across a cut.

        Characters that stand beside each other in pieces belong together; cuts are before marks (after any other
        character) and between the largest such set, as a rule the letters, and the others of more than one.
        """
        if any(MARK in p.lstrip(MARK) for p in self.id):
            return lambda text: [text]
        group: dict[str, set[str]] = {}
        for p in self.id:
            for a, b in zip(p.lstrip(MARK), p.lstrip(MARK)[1:]):
                one, two = group.setdefault(a, {a}), group.setdefault(b, {b})
                if one is not two:
                    one, two = sorted((one, two), key=len)
                    two |= one
                    group.update(dict.fromkeys(one, two))
        largest = max(group.values(), key=len, default=set())
        others = "".join(re.escape(c) for c in sorted(group) if group[c] is not largest)
        if not others:
            return re.compile(f"{MARK}*[^{MARK}]+|{MARK}+").findall
        return re.compile(f"{MARK}*(?:[^{MARK}{others}]+|[{others}]+)|{MARK}+").findall

    def merges(self, token: str) -> tuple[list[tuple[float, str]], list[tuple[float, str]]] | None:
        """How a token is made of its characters, the best score first and among equal ones the leftmost.

        For each merge, its score and what then stands at the token's left end, and the same for its right end; None
        if merging does not end with the token.
        """
        if token in self.made:
            return self.made[token]
        score, parts, left, right = self.score, list(token), [], []
        while len(parts) > 1:
            scores = [score.get(a + b, LOWEST) for a, b in zip(parts, parts[1:])]
            if (best := max(scores)) == LOWEST:
                break
            at = scores.index(best)
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
            left.append((best, parts[0]))
            right.append((best, parts[-1]))
        found = self.made[token] = (left, right) if len(parts) == 1 else None
        return found

    def compatible(self, left: str, right: str) -> bool:
        """Whether merging the characters of both gives these two pieces (an empty left one: whether right is made at all).

        Both are merged again side by side, in the order that the whole would take; a merge across their border whose
        turn comes shows that they do not stay.
        """
        made_right = self.merges(right)
        if made_right is None or not left:
            self.fits[left, right] = made_right is not None
            return made_right is not None
        if len(self.fits) >= MEMORY:
            self.fits.clear()
        found = self.fits[left, right] = self.stays(self.merges(left)[1], made_right[0], left[-1], right[0])
        return found

    def stays(self, lefts: list[tuple[float, str]], rights: list[tuple[float, str]], edge: str, start: str) -> bool:
        score, i, j = self.score, 0, 0
        while True:
            next_left = lefts[i][0] if i < len(lefts) else LOWEST
            next_right = rights[j][0] if j < len(rights) else LOWEST
            across = score.get(edge + start)
            # among equal scores the leftmost merge comes first
            if across is not None and across > next_left and across >= next_right:
                return False
            if next_left == LOWEST and next_right == LOWEST:
                return True
            if next_left >= next_right:
                edge = lefts[i][1]
                i += 1
            else:
                start = rights[j][1]
                j += 1

    def prefix_of(self, token: str) -> str:
        """The longest token that is a proper prefix of a token; empty if there is none."""
        if (found := self.shorter.get(token)) is None:
            found = self.shorter[token] = next((token[:n] for n in range(len(token) - 1, 0, -1) if token[:n] in self.tokens), "")
        return found

    def split(self, word: str) -> list[str]:
        """The pieces of a word; a character that no piece holds stands by itself."""
        longest = [c if c in self.tokens else "" for c in word]
        for end, (reach, token) in self.automaton.iter(word):
            longest[end - reach] = token  # ends ascend, so the last match of a start is its longest
        fits, shorter = self.fits, self.shorter
        out: list[str] = []
        before, at, token = "", 0, longest[0]
        failed = None
        while True:
            while token:
                if (stands := fits.get((before, token))) is None:
                    stands = self.compatible(before, token)
                if stands and not (failed and failed[(at + len(token)) >> 3] >> ((at + len(token)) & 7) & 1):
                    break
                if (token := shorter.get(found := token)) is None:
                    token = self.prefix_of(found)
            if token:
                out.append(token)
                at += len(token)
                before = token
            elif not longest[at]:  # merges with nothing
                out.append(word[at])
                at += 1
                before = ""
            else:
                failed = failed or bytearray(len(word) // 8 + 1)
                failed[at >> 3] |= 1 << (at & 7)
                token = out.pop()
                at -= len(token)
                before = out[-1] if out and out[-1] in self.tokens else ""
                token = self.prefix_of(token)
                continue
            if at == len(word):
                return out
            token = longest[at]

    def encode_word(self, word: str) -> bytes:
        packed = self.packed
        if word in packed and self.compatible("", word):
            return packed[word]
        return b"".join([packed.get(p) or self.packed_bytes(p) for p in self.split(word)])

    def packed_bytes(self, character: str) -> bytes:
        return b"".join([struct.pack("<i", self.bytes[b]) for b in character.encode()])

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        words = self.words(self.front + text.replace(" ", MARK))
        ids = list(map(self.known.get, words))
        if None in ids:
            for i, found in enumerate(ids):
                if found is None:
                    ids[i] = self.known.get(words[i]) or self.remember(words[i])
        return b"".join(ids)

    def remember(self, word: str) -> bytes:
        made = self.older.get(word) or self.encode_word(word)
        if len(word) <= REMEMBERED_CHARS:
            if len(self.known) >= MEMORY:
                self.known, self.older = {}, self.known
            self.known[word] = made
        return made


_MADE: dict[tuple[type, str], PieceModel] = {}


def _made(kind: type, key: str, shared) -> PieceModel:
    """The model or codec of a worker process, by a digest of the model file that the driver made."""
    if (kind, key) not in _MADE:
        _MADE.clear()
        _MADE[kind, key] = kind(shared.value)
    return _MADE[kind, key]


def _shared(df: DataFrame, model: bytes):
    return hashlib.sha256(model).hexdigest(), importable(df).sparkSession.sparkContext.broadcast(model)


def encode(df: DataFrame, model: bytes, text: str = "text", ids: str = "ids", end: bool = True) -> DataFrame:
    """Adds the ids of each text as an array, followed by the end id if `end`; null and empty texts have no other id.

    Rows stay as they are, repeated ones too, and only the new column comes back from Python; a column named like the
    output is replaced. Very long words and texts are encoded whole.
    """
    key, shared = _shared(df, model)

    @F.arrow_udf("array<int>")
    def step(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            codec = _made(PieceCodec, key, shared)
            last = struct.pack("<i", codec.end_id) if end else b""
            values, counts = [np.zeros(0, dtype="<i4")], []
            for a, b in slices(byte_lengths(texts)):
                packed = [codec.encode(t or "") + last for t in texts.slice(a, b - a).to_pylist()]
                counts += [len(p) // 4 for p in packed]
                values.append(np.frombuffer(b"".join(packed), dtype="<i4"))
            offsets = pa.array(np.cumsum([0, *counts]), pa.int32())
            yield pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(values)))

    return df.withColumn(ids, step.asNondeterministic()(_named(df, text)))


def decode(df: DataFrame, model: bytes, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Adds the text that the ids of each row stand for; null ids and no ids give an empty text. Unknown ids are an error."""
    key, shared = _shared(df, model)

    @F.arrow_udf("string")
    def step(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for rows in batches:
            model, made = _made(PieceModel, key, shared), [pa.array([], pa.string())]
            for a, b in slices(np.asarray(pc.list_value_length(rows).fill_null(0)) * 4):
                texts = [model.decode(r) if r else "" for r in rows.slice(a, b - a).to_pylist()]
                made.append(pa.array(texts, pa.string()))
            yield pa.concat_arrays(made)

    return df.withColumn(decoded, step.asNondeterministic()(_named(df, ids)))


def _named(df: DataFrame, name: str) -> Column:
    return df[f"`{name}`"]
