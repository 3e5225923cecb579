"""Phrase collocations by set-oriented mining: sorted occurrence relations, extended by one word at a time.

Texts become a relation of word occurrences sorted by piece and position, stored as a table: one row per block of a
document, in it the words in order and for each the step from the place of the word before. Places count on by one inside a piece
and skip a number between pieces, so that neighbouring places are adjacent positions of one piece. Each level joins
the relation of phrases of k words with itself on piece and adjacent position (a merge of sorted places), counts groups,
keeps the frequent ones, and semi-joins the relation with them before the next level.

The semi-join is a filter of fixed largest size over fingerprints of the frequent phrases; what it lets through by
chance is counted at the next level and has too low a count there, so it changes no result. Counts are exact. Words are
64-bit fingerprints until the end, when their texts are joined to the phrases that are returned.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.arrow import arrow_rows, byte_lengths, importable, remove_table, shared_folder, slices, text_buffer
from lectern.llm.words import Words, coefficients, mix, signed, unsigned

#: Bytes that end a piece, and bytes that only part words.
BREAKS = np.zeros(256, dtype=bool)
BREAKS[[*b".,;:!?", *range(10, 14)]] = True
WORD_BYTES = ~BREAKS
WORD_BYTES[[9, 32]] = False
#: Longest phrases; texts are cut to blocks of so many words, each followed by the words that its last phrases need.
LONGEST, BLOCK = 4, 1 << 17
#: Groups that a task counts together before it hands them on, and bytes of text that it works on at once.
TALLY, TEXT_BYTES = 250_000, 1_000_000
#: Texts or blocks that go to a Python worker at once.
BATCH_ROWS = 500
#: Bits of the largest filter (32 MB), and bits for each phrase in a smaller one.
LARGEST_FILTER, BITS_EACH = 1 << 28, 12
#: Counters of each half of a sketch of phrases, and counters in a row of it; a phrase has a counter in either half.
SLOTS, CHUNK = 1 << 22, 1 << 12
UNKNOWN_LANG = "und"


def _lang_codes(langs: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Number of the language of each row, and the fingerprint and name of each number."""
    encoded = langs.cast(pa.string()).dictionary_encode()
    names = encoded.dictionary.to_pylist()
    marks = [int.from_bytes(hashlib.blake2b(n.encode(), digest_size=8).digest(), "little") for n in names]
    return np.asarray(encoded.indices), np.array(marks, dtype=np.uint64), names


def _keys(lang: np.ndarray, words: list[np.ndarray]) -> np.ndarray:
    """Fingerprints of (language, words)."""
    c = coefficients(len(words) + 1, 13 + len(words))
    out = lang * c[-1]
    for w, x in zip(words, c):
        out += w * x
    return mix(out)


def _probes(keys: np.ndarray, bits: int) -> list[np.ndarray]:
    mask, far = np.uint64(bits - 1), mix(keys + np.uint64(bits))
    return [keys & mask, (keys >> np.uint64(32)) & mask, far & mask]


class PhraseFilter:
    """Membership test that never denies a member."""

    def __init__(self, slots: np.ndarray):
        self.slots, self.bits = slots, len(slots) * 64

    def holds(self, keys: np.ndarray) -> np.ndarray:
        found = np.ones(len(keys), dtype=bool)
        for p in _probes(keys, self.bits):
            found &= (self.slots[p >> np.uint64(6)] >> (p & np.uint64(63)) & np.uint64(1)).astype(bool)
        return found


def phrase_filter(frequent: DataFrame, size: int) -> PhraseFilter:
    """The filter over (lang, w1 .. w<size>); only its slots, of a bounded number, come to the driver."""
    names = [f"w{i}" for i in range(1, size + 1)]
    bits = max(1 << 16, min(LARGEST_FILTER, 1 << (frequent.count() * BITS_EACH).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, marks, _ = _lang_codes(batch.column("lang"))
            keys = _keys(marks[codes], [unsigned(batch.column(n).to_numpy()) for n in names])
            at = np.concatenate(_probes(keys, bits))
            bit = np.uint64(1) << (at & np.uint64(63))
            yield pa.RecordBatch.from_arrays([pa.array(signed(at >> np.uint64(6))), pa.array(signed(bit))], ["slot", "bits"])

    made = importable(frequent.select("lang", *names)).mapInArrow(run, "slot long, bits long").groupBy("slot").agg(F.bit_or("bits").alias("bits"))
    found = made.toArrow()
    slots = np.zeros(bits // 64, dtype=np.uint64)
    slots[found.column("slot").to_numpy()] = unsigned(found.column("bits").to_numpy())
    return PhraseFilter(slots)


class Tally:
    """Counts of groups in a task: equal groups are put together until too many different ones are held."""

    def __init__(self, size: int, word_texts: bool = False):
        self.names = ["lang", *[f"w{i}" for i in range(1, size + 1)], "a", *(["word"] if word_texts else [])]
        self.parts: list[list[np.ndarray | pa.Array]] = []
        self.held = 0

    def add(self, keys: np.ndarray, counts: np.ndarray, lang: np.ndarray, columns: list[np.ndarray | pa.Array]) -> Iterator[pa.RecordBatch]:
        self.parts.append([keys, counts, lang, *columns])
        self.held += len(keys)
        if self.held > 2 * TALLY:
            self.merge()
            if self.held > TALLY:
                yield from self.flush()

    def merge(self) -> None:
        columns = [pa.concat_arrays(c) if isinstance(c[0], pa.Array) else np.concatenate(c) for c in zip(*self.parts)]
        first, counts = grouped(columns[0], columns[1])
        self.parts = [[columns[0][first], counts, *[c.take(pa.array(first)) if isinstance(c, pa.Array) else c[first] for c in columns[2:]]]]
        self.held = len(first)

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.parts:
            self.merge()
            _, counts, lang, *rest = self.parts[0]
            texts = [c for c in rest if isinstance(c, pa.Array)]
            arrays = [pa.array(lang, pa.string()), *[pa.array(signed(c)) for c in rest[:len(rest) - len(texts)]], pa.array(counts), *texts]
            whole = pa.RecordBatch.from_arrays(arrays, self.names)
            for a in range(0, whole.num_rows, 50_000):
                yield whole.slice(a, 50_000)
        self.parts, self.held = [], 0


def grouped(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Index of one row of each group of equal keys, and the sum of its counts (number of rows without counts)."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    head = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]]) if len(keys) else np.zeros(0, dtype=np.int64)
    sums = np.diff(np.r_[head, len(keys)]) if counts is None else np.add.reduceat(counts[order], head) if len(head) else head
    return order[head], sums.astype(np.int64)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Words, np.ndarray, np.ndarray, np.ndarray, list[str]]]:
    """Bounded slices of texts: words, whether each begins a piece, and language codes, fingerprints and names."""
    for batch in batches:
        texts, langs = batch.column("text"), batch.column("lang")
        for a, b in slices(byte_lengths(texts), TEXT_BYTES):
            data, offsets = text_buffer(texts.slice(a, b - a))
            words = Words(data, offsets, WORD_BYTES, lower=True)
            breaks = np.cumsum(BREAKS[data], dtype=np.int32)[words.start]
            opens = np.ones(len(words), dtype=bool)
            opens[1:] = breaks[1:] != breaks[:-1]
            opens[words.first[:-1][words.first[:-1] < len(words)]] = True
            codes, marks, names = _lang_codes(langs.slice(a, b - a))
            yield words, opens, np.repeat(codes, words.counts), marks, names


def spelt(words: Words, at: np.ndarray) -> pa.Array:
    """Texts of some words, gathered from the buffer without a Python string for each."""
    length = words.length[at]
    offsets = np.r_[0, np.cumsum(length)]
    data = words.data[np.repeat(words.start[at] - offsets[:-1], length) + np.arange(offsets[-1])]
    return pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data))


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, w1, a, word): occurrences of every word by language; with null w1 and word, those of all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally(1, word_texts=True)
        totals: dict[str, int] = {}
        for words, _, codes, marks, names in _texts(batches):
            for i, n in enumerate(np.bincount(codes, minlength=len(names)).tolist()):
                totals[names[i]] = totals.get(names[i], 0) + n
            keys = _keys(marks[codes], [words.hash])
            first, counts = grouped(keys)
            yield from tally.add(keys[first], counts, np.array(names, dtype=object)[codes[first]], [words.hash[first], spelt(words, first)])
        yield from tally.flush()
        yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.string()), pa.nulls(len(totals), pa.int64()),
                                          pa.array(list(totals.values()), pa.int64()), pa.nulls(len(totals), pa.string())], tally.names)

    made = importable(docs).mapInArrow(run, "lang string, w1 long, a long, word string")
    return made.groupBy("lang", "w1", "word").agg(F.sum("a").alias("a")).select("lang", "w1", "a", "word")


def _schema(size: int) -> str:
    return "lang string, own int, step array<int>, " + ", ".join(f"w{i} array<long>" for i in range(1, size + 1))


def _relation(lang: pa.Array, blocks: np.ndarray, place: np.ndarray, mine: np.ndarray, columns: list[np.ndarray], n_blocks: int) -> pa.RecordBatch:
    """Rows of an occurrence relation: entries with their block (ascending) and place; blocks without an entry are left out."""
    step = np.diff(place, prepend=0).astype(np.int32)
    counts = np.bincount(blocks, minlength=n_blocks)
    offsets = np.r_[0, np.cumsum(counts)]
    step[offsets[:-1][counts > 0]] = 0
    own = np.bincount(blocks[mine], minlength=n_blocks).astype(np.int32)
    filled = np.flatnonzero(counts)
    at = pa.array(np.r_[offsets[filled], offsets[-1]], pa.int32())
    lists = [pa.ListArray.from_arrays(at, pa.array(v)) for v in (step, *[signed(c) for c in columns])]
    names = ["lang", "own", "step", *[f"w{i}" for i in range(1, len(columns) + 1)]]
    return pa.RecordBatch.from_arrays([lang.take(pa.array(filled)), pa.array(own[filled]), *lists], names)


def word_occurrences(docs: DataFrame, frequent: PhraseFilter) -> DataFrame:
    """The relation of occurrences of frequent words."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent.slots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = PhraseFilter(shared.value)
        for words, opens, codes, marks, names in _texts(batches):
            place = np.cumsum(opens.astype(np.int64) + 1)
            kept = keep.holds(_keys(marks[codes], [words.hash]))
            text = words.texts()
            inside = np.arange(len(words)) - words.first[:-1][text] if len(words) else np.zeros(0, dtype=np.int64)
            part = inside // BLOCK
            _, block = np.unique(text * (1 << 32) + part, return_inverse=True)
            if not len(block):
                continue
            langs = pa.array(np.array(names, dtype=object)[codes[np.r_[0, np.flatnonzero(np.diff(block)) + 1]]], pa.string())
            # the first words of a later block also end the block before it
            tail = np.flatnonzero((part > 0) & (inside % BLOCK < LONGEST - 1))
            at = np.r_[np.arange(len(words)), tail]
            belongs = np.r_[block, block[tail] - 1]
            mine = np.r_[np.ones(len(words), dtype=bool), np.zeros(len(tail), dtype=bool)]
            if len(tail):
                order = np.lexsort((at, belongs))
                at, belongs, mine = at[order], belongs[order], mine[order]
            hit = kept[at]
            yield _relation(langs, belongs[hit], place[at[hit]], mine[hit], [words.hash[at[hit]]], len(langs))

    return importable(docs).mapInArrow(run, _schema(1))


def _joined(batch: pa.RecordBatch, size: int):
    """Merge-join of a relation with itself on piece and adjacent position: phrases of one more word."""
    lists = batch.column("step")
    offsets = np.asarray(lists.offsets).astype(np.int64)
    columns = [unsigned(batch.column(f"w{i}").flatten().to_numpy(zero_copy_only=False)) for i in range(1, size + 1)]
    step = np.asarray(lists.flatten())
    counts = np.diff(offsets)
    block = np.repeat(np.arange(len(counts)), counts)
    mine = np.arange(len(step)) - np.repeat(offsets[:-1] - offsets[0], counts) < np.repeat(np.asarray(batch.column("own")), counts)
    at = np.flatnonzero((step[1:] == 1) & (block[1:] == block[:-1])) if len(step) else np.zeros(0, dtype=np.int64)
    phrases = [c[at] for c in columns] + [columns[-1][at + 1]]
    codes, marks, names = _lang_codes(batch.column("lang"))
    return at, phrases, block[at], mine[at], np.cumsum(step, dtype=np.int64)[at], codes[block[at]], marks, names


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for a, b in slices(np.asarray(pc.list_value_length(batch.column("step"))) * 8):
        yield batch.slice(a, b - a)


def _slots(keys: np.ndarray, slots: int) -> list[np.ndarray]:
    mask = np.uint64(slots - 1)
    return [keys & mask, ((keys >> np.uint64(32)) & mask) + np.uint64(slots)]


def likely_phrases(relation: DataFrame, size: int, least: int) -> np.ndarray:
    """One bit for each slot of phrase fingerprints: whether its phrases of one more word occur `least` times or more.

    Phrases of one slot are counted together, so that no frequent phrase is missed; a rare one is let through only if
    it shares a slot with others in both halves. Counts stop at `least` in each
    task; a row of the sketch is added up over the tasks, and only the bits come to the driver.
    """
    kind = np.uint8 if least < 256 else np.int32
    half, chunk = SLOTS, CHUNK
    slots = 2 * half

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(slots, dtype=kind)
        for batch in batches:
            for part in _parts(batch):
                _, phrases, _, mine, _, codes, marks, _ = _joined(part, size)
                keys = _keys(marks[codes[mine]], [p[mine] for p in phrases])
                at, counts = np.unique(np.concatenate(_slots(keys, half)).astype(np.int64), return_counts=True)
                held[at] = np.minimum(held[at] + counts, least)
        for c in np.unique(np.flatnonzero(held) // chunk).tolist():
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([held[c * chunk:(c + 1) * chunk].tobytes()])], ["chunk", "counts"])

    def add(rows: pa.Table) -> pa.Table:
        total = np.zeros(min(chunk, slots), dtype=np.int64)
        for counts in rows.column("counts"):
            total += np.frombuffer(counts.as_py(), dtype=kind)
        bits = np.packbits(total >= least, bitorder="little").tobytes()
        return pa.table({"chunk": rows.column("chunk").slice(0, 1), "bits": pa.array([bits], pa.binary())})

    made = importable(relation).mapInArrow(run, "chunk int, counts binary").groupBy("chunk").applyInArrow(add, "chunk int, bits binary").toArrow()
    out = np.zeros(slots // 8, dtype=np.uint8)
    for c, bits in zip(made.column("chunk").to_pylist(), made.column("bits").to_pylist()):
        out[c * chunk // 8:c * chunk // 8 + len(bits)] = np.frombuffer(bits, dtype=np.uint8)
    return out


def phrase_counts(relation: DataFrame, size: int, likely: np.ndarray | None = None) -> DataFrame:
    """(lang, w1 .., a): occurrences of the phrases of one more word than the relation has; with `likely`, of those in its slots."""
    shared = None if likely is None else relation.sparkSession.sparkContext.broadcast(likely)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally(size + 1)
        for batch in batches:
            for part in _parts(batch):
                _, phrases, _, mine, _, codes, marks, names = _joined(part, size)
                phrases, codes = [p[mine] for p in phrases], codes[mine]
                keys = _keys(marks[codes], phrases)
                if shared is not None:
                    hit = np.ones(len(keys), dtype=bool)
                    for slot in _slots(keys, len(shared.value) * 4):
                        hit &= (shared.value[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
                    keys, phrases, codes = keys[hit], [p[hit] for p in phrases], codes[hit]
                first, counts = grouped(keys)
                yield from tally.add(keys[first], counts, np.array(names, dtype=object)[codes[first]], [p[first] for p in phrases])
        yield from tally.flush()

    names = [f"w{i}" for i in range(1, size + 2)]
    if likely is not None:
        # a task ends with a row for nearly every likely phrase: with a task for each core, rows grow with the phrases, not with phrases times tasks
        relation = relation.coalesce(relation.sparkSession.sparkContext.defaultParallelism)
    made = importable(relation).mapInArrow(run, "lang string, " + ", ".join(f"{n} long" for n in names) + ", a long")
    return made.groupBy("lang", *names).agg(F.sum("a").alias("a"))


def extended(relation: DataFrame, size: int, frequent: PhraseFilter) -> DataFrame:
    """The relation of occurrences of frequent phrases of one more word."""
    shared = relation.sparkSession.sparkContext.broadcast(frequent.slots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = PhraseFilter(shared.value)
        for batch in batches:
            for part in _parts(batch):
                _, phrases, block, mine, place, codes, marks, _ = _joined(part, size)
                hit = keep.holds(_keys(marks[codes], phrases))
                yield _relation(part.column("lang"), block[hit], place[hit], mine[hit], [p[hit] for p in phrases], part.num_rows)

    return importable(relation).mapInArrow(run, _schema(size + 1))


def _phrases(counts: DataFrame, size: int) -> DataFrame:
    return counts.select("lang", F.array(*[f"w{i}" for i in range(1, size + 1)]).alias("ws"), "a")


def frequent_phrases(docs: DataFrame, least: int = 30) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lang, n) words by language, (lang, w1, a, word) frequent words, (lang, ws, a) frequent phrases of 1 to 4 words."""
    spark = docs.sparkSession
    folder = f"{shared_folder(spark)}/collocations-{uuid.uuid4().hex}"

    def stored(df: DataFrame, name: str) -> DataFrame:
        with arrow_rows(spark, BATCH_ROWS):  # rows hold whole texts, or the words of whole texts
            df.write.parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN_LANG)).alias("lang"), F.col("text").cast("string").alias("text"))
    kept = stored(word_counts(texts).where(F.col("w1").isNull() | (F.col("a") >= least)), "c1")
    words = kept.where("w1 is not null")
    relation = stored(word_occurrences(texts, phrase_filter(words, 1)), "r1")
    found = [_phrases(words, 1)]
    for size in range(1, LONGEST):
        # most phrases of frequent parts are rare: a sketch leaves out those that cannot be frequent before any is shuffled
        likely = likely_phrases(relation, size, least) if size > 1 else None
        counts = stored(phrase_counts(relation, size, likely).where(F.col("a") >= least), f"c{size + 1}")
        found.append(_phrases(counts, size + 1))
        if size + 1 < LONGEST:
            # relations shrink from level to level: without partitions of full size, partial counts would stay apart
            relation = stored(extended(relation, size, phrase_filter(counts, size + 1)).hint("rebalance"), f"r{size + 1}")
    for size in range(1, LONGEST):
        remove_table(spark, f"{folder}/r{size}")
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    return kept.where("w1 is null").select("lang", F.col("a").alias("n")), words, every


def _wide(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(20,0)")


def scored(phrases: DataFrame, share: int = 80) -> DataFrame:
    """(lang, ws, a, l, r, score) of phrases of two words or more that no longer one stands for.

    A phrase goes if a longer frequent one holds it with at least `share` per cent of its occurrences. The score is that
    of the lowest-scoring cut, the earliest among equal ones; products are computed in decimals.
    """
    candidates = phrases.where("size(ws) >= 2")
    inner = F.expr("""flatten(transform(sequence(2, size(ws) - 1), k -> transform(sequence(1, size(ws) - k + 1), i -> slice(ws, i, k))))""")
    covered = candidates.where("size(ws) >= 3").select("lang", F.explode(inner).alias("ws"), "a").groupBy("lang", "ws").agg(F.max("a").alias("cover"))
    open_ = candidates.join(covered, ["lang", "ws"], "left").where(
        F.col("cover").isNull() | (_wide("cover") * 100 < _wide("a") * share)).drop("cover")
    cuts = open_.select("*", F.explode(F.expr("sequence(1, size(ws) - 1)")).alias("k"))
    cuts = cuts.withColumn("first", F.expr("slice(ws, 1, k)")).withColumn("rest", F.expr("slice(ws, k + 1, size(ws))"))
    left = phrases.select("lang", F.col("ws").alias("first"), F.col("a").alias("l"))
    right = phrases.select("lang", F.col("ws").alias("rest"), F.col("a").alias("r"))
    both = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"])
    score = F.expr("cast(cast(2000000 as decimal(8,0)) * cast(a as decimal(20,0)) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0))) as long)")
    best = both.groupBy("lang", "ws", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    return best.select("lang", "ws", "a", "cut.l", "cut.r", "cut.score")


def collocations(docs: DataFrame, top: int = 2000, least: int = 30, share: int = 80) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the `top` phrases of each language, by score, occurrences and phrase.

    Needs text and lang; other columns take no part. Null texts are empty, a null language counts as `und`; repeated rows count each time;
    ties go to the phrase that is less in UTF-8 byte order. An empty table gives no rows, as do languages without a
    phrase of `least` occurrences. Texts of any length are read whole.
    """
    totals, words, phrases = frequent_phrases(docs, least)
    order = [F.col("score").desc(), F.col("a").desc()]
    # ranks with ties, so that only phrases that can be returned get their texts
    best = scored(phrases, share).withColumn("rank", F.rank().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    spelt = best.select("*", F.posexplode("ws").alias("at", "w1")).join(words.select("lang", "w1", "word"), ["lang", "w1"])
    named = spelt.groupBy("lang", "ws", "a", "l", "r", "score").agg(
        F.array_join(F.expr("transform(array_sort(collect_list(struct(at, word))), x -> x.word)"), " ").alias("phrase"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order, "phrase")).cast("long")
    return named.withColumn("rank", rank).where(F.col("rank") <= top).join(totals, "lang").select(
        "lang", "rank", "phrase", "a", "l", "r", "n", "score")
