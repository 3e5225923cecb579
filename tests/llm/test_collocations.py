"""Collocations against a plain count in Python, and on odd rows."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lectern.llm import collocations as C

SCHEMA = "doc_id long, text string, lang string"


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text)


def plain(rows, top, least, share=80):
    total, counts = Counter(), {}
    for _, text, lang in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    counts.setdefault(lang, Counter())[tuple(words[i:i + k])] += 1
    out = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if 2 <= len(p) and a >= least}
        cover = {}
        for p, a in candidates.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    cover[p[i:i + k]] = max(cover.get(p[i:i + k], 0), a)
        best = []
        for p, a in candidates.items():
            if p not in cover or 100 * cover[p] < share * a:
                score, _, l, r = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                best.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(best)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, total[lang], -score))
    return sorted(out)


def check(spark, rows, top=50, least=3):
    docs = spark.createDataFrame(rows, SCHEMA)
    docs = docs.withColumn("n", F.lit("x")).withColumn("word", F.lit(1)).withColumn("w1", F.lit(2)).repartition(3)
    got = C.collocations(docs, top, least)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in got.collect()) == plain(rows, top, least)


def texts(rng, n):
    words = ["the", "The", "of", "ba", "é", "日本", "x\xa0y", "new", "york", "city", "a", "b"]
    for i in range(n):
        yield (i, "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".\n", "?"]) for _ in range(rng.randint(0, 60))),
               rng.choice(["en", "fr", None, "und"]))


def test_random_texts(spark):
    check(spark, list(texts(random.Random(5), 120)))


def test_ties_repeats_and_odd_rows(spark):
    rows = [(1, "p q r s t. " * 4, "en")] * 3 + [(2, "s t u v; q r " * 3, "en"), (3, "", "en"), (None, None, None), (4, "w" * 100_000 + " end", "de"),
            (5, "z " * 3000, "fr"), (6, "one", "es"), (7, " \t\n", "es"), (8, "A B\x0bA B\x0cA B\rA B\nA B", "")]
    check(spark, [r for r in rows if r[2] != ""])
    check(spark, list(texts(random.Random(6), 60)), top=5, least=2)


def test_blocks_and_a_full_filter(spark, monkeypatch):
    """Blocks of a few words lose no phrase and count none twice, even if the filter lets everything through."""
    rows = list(texts(random.Random(8), 40)) + [(99, "a b c d e f g " * 300, "en")]
    monkeypatch.setattr(C, "BLOCK", 5)
    batches = [pa_batch(rows)]
    keep = C.PhraseFilter(np.full(1, 2**64 - 1, dtype=np.uint64))

    found = Counter()
    for words, opens, codes, marks, names in C._texts(iter(batches)):
        assert len(words) == len(opens) == len(codes)
    relation = run_local(monkeypatch, C.word_occurrences, keep, batches)
    for size in (1, 2, 3):
        for b in relation:
            _, phrases, _, mine, _, codes, _, names = C._joined(b, size)
            for i in mine.nonzero()[0]:
                found[(names[codes[i]], *[int(p[i]) for p in phrases])] += 1
        relation = run_local(monkeypatch, lambda d, f: C.extended(d, size, f), keep, relation)
    plain_counts = Counter()
    for _, text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            for k in (2, 3, 4):
                for i in range(len(words) - k + 1):
                    plain_counts[(lang or "und", *words[i:i + k])] += 1
    assert sorted(found.values()) == sorted(plain_counts.values())


def pa_batch(rows):
    return pa.RecordBatch.from_arrays([pa.array([r[2] or "und" for r in rows]), pa.array([r[1] for r in rows], pa.string())], ["lang", "text"])


def run_local(monkeypatch, operator, keep, batches):
    """Runs the Arrow step of an operator on batches, without a session."""
    class Frame:
        sparkSession = property(lambda self: self)
        sparkContext = property(lambda self: self)
        value = keep.slots

        def broadcast(self, _):
            return self

        def mapInArrow(self, run, _):
            return [b for b in run(iter(batches)) if b.num_rows]

    monkeypatch.setattr(C, "importable", lambda df: df)
    return operator(Frame(), keep)


def test_no_texts(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert C.collocations(empty).collect() == []


def test_a_sketch_leaves_out_rare_phrases_only(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(" ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(60)) + " x y", rng.choice(["en", "fr"])) for _ in range(40)]
    texts = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    relation = C.word_occurrences(texts, C.PhraseFilter(np.full(1024, 2**64 - 1, dtype=np.uint64))).cache()
    every = {tuple(r)[:-1]: r.a for r in C.phrase_counts(relation, 1).collect()}
    frequent = {k: a for k, a in every.items() if a >= 6}
    assert 10 < len(frequent) < len(every) / 2
    for slots in (1 << 16, 1 << 6):
        monkeypatch.setattr(C, "SLOTS", slots)
        found = {tuple(r)[:-1]: r.a for r in C.phrase_counts(relation, 1, C.likely_phrases(relation, 1, 6)).collect()}
        assert frequent.items() <= found.items() <= every.items()
        assert slots == 1 << 6 or len(found) < len(frequent) * 1.2
    relation.unpersist()


def test_a_full_sketch_lets_few_rare_phrases_through(spark, monkeypatch):
    """Two counters for each phrase: with as many phrases as counters, one alone would let about every third through."""
    from lectern.llm import collocations as C

    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 60, 400)) for _ in range(20)] + ["a b c"] * 12
    docs = spark.createDataFrame([("en", t) for t in texts], "lang string, text string").repartition(3)
    relation = C.word_occurrences(docs, C.phrase_filter(C.word_counts(docs).where("w1 is not null"), 1)).cache()
    every = {tuple(r)[:-1]: r.a for r in C.phrase_counts(relation, 1).collect()}
    frequent = {k: a for k, a in every.items() if a >= 8}
    monkeypatch.setattr(C, "SLOTS", 1 << 12)
    found = {tuple(r)[:-1]: r.a for r in C.phrase_counts(relation, 1, C.likely_phrases(relation, 1, 8)).collect()}
    assert frequent.items() <= found.items() <= every.items()
    one = {}
    for (lang, *words), a in every.items():
        slot = int(C._keys(C._lang_codes(pa.array([lang]))[1], [np.array([w], dtype=np.int64).view(np.uint64) for w in words])[0]) % (1 << 12)
        one.setdefault(slot, []).append(a)
    single = sum(len(v) for v in one.values() if sum(v) >= 8)
    assert len(found) - len(frequent) < (single - len(frequent)) / 2
    relation.unpersist()


def test_likely_phrases_are_counted_in_a_task_for_each_core(spark, capsys):
    from lectern.llm import collocations as C

    docs = spark.createDataFrame([("en", f"a b c d{i % 3}") for i in range(400)], "lang string, text string")
    relation = C.word_occurrences(docs, C.phrase_filter(C.word_counts(docs).where("w1 is not null"), 1)).repartition(64).cache()
    counts = C.phrase_counts(relation, 1, C.likely_phrases(relation, 1, 30))
    counts.explain()
    assert f"Coalesce {spark.sparkContext.defaultParallelism}" in capsys.readouterr().out
    assert sorted(r.a for r in counts.collect()) == [133, 133, 134, 400, 400]
    relation.unpersist()
