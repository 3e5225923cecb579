import random
import re

import numpy as np
import pyarrow as pa
import pytest

from lectern.llm.jaccard_join import _shared_postings, bitmap, components, may_link, similarity_join
from lectern.llm.repeats import Scheme
from lectern.llm.substring_dedup import AFTER, BEFORE, WINDOW, substring_dedup, symbol_ranks
from lectern.llm.suffix_dedup import suffix_dedup
from lectern.llm.words import SPACED, Words

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def plain_removal(rows, size):
    first, of = {}, {}
    for key, text in sorted(rows, key=lambda r: r[0]):
        of[key] = words(text)
        for s in range(len(of[key]) - size + 1):
            first.setdefault(tuple(of[key][s:s + size]), (key, s))
    out = {}
    for key, w in of.items():
        gone = [False] * len(w)
        for s in range(len(w) - size + 1):
            if first[tuple(w[s:s + size])] != (key, s):
                gone[s:s + size] = [True] * size
        out[key] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g))
    return out


def repeated_rows(seed):
    rng, rows = random.Random(seed), []
    for d in range(200):
        kinds = rng.choice([1, 2, 3, 50])
        text = [f"w{rng.randint(0, kinds)}" for _ in range(rng.choice([0, 5, 19, 20, 21, 49, 50, 60, 200]))]
        if d > 5 and rng.random() < 0.7:
            other = words(rng.choice(rows)[1])
            a = rng.randint(0, max(0, len(other) - 1))
            at = rng.randint(0, len(text))
            text[at:at] = other[a:a + rng.randint(10, 90)]
        rows.append((d * 7 % 307, rng.choice([" ", "\n", "  "]).join(text) if rng.random() > 0.02 else None))
    return rows


@pytest.mark.parametrize("operator,size", [(substring_dedup, 20), (suffix_dedup, 50)])
def test_removal_equals_brute_force(spark, operator, size):
    rows = repeated_rows(size)
    found = operator(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in found} == plain_removal(rows, size)
    assert sum(r.n_removed for r in found) > 100


@pytest.fixture
def one_row_batches(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, 1)
    yield
    spark.conf.set(name, before)


@pytest.mark.parametrize("seed", [20, 21])
def test_substrings_at_the_edges_of_slices(spark, one_row_batches, seed):
    rows = repeated_rows(seed)
    found = substring_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in found} == plain_removal(rows, 20)


def test_places_do_not_depend_on_the_slice():
    scheme = Scheme(WINDOW, BEFORE, AFTER, symbol_ranks)

    def places(texts):
        data = "".join(texts).encode()
        found = Words(np.frombuffer(data, dtype=np.uint8), np.cumsum([0, *map(len, texts)]), SPACED)
        text, start, *rest = scheme.rows(found)
        return [list(zip(*(x[text == i].tolist() for x in (start - found.first[text], *rest)))) for i in range(len(texts))]

    rng = random.Random(5)
    texts = [" ".join(f"w{rng.randint(0, k)}" for _ in range(40)) for k in [1, 2, 3, 50] * 100]
    assert places(texts) == [places([t])[0] for t in texts]


def test_removal_on_odd_rows(odd_docs, clashing, no_docs):
    found = substring_dedup(odd_docs).collect()
    assert len(found) == 10
    of = {r.doc_id: r for r in found}
    assert of[3].n_words == of[2].n_words == 0 and of[3].kept == ""
    assert of[4].n_removed == 2999 and of[5].n_removed == 0 and of[6].kept == "é 日本語 😀 mixed spaces"
    assert of[None].n_words == 7
    key = lambda r: (str(r.doc_id), r.kept)
    assert sorted(substring_dedup(clashing).collect(), key=key) == sorted(found, key=key)
    assert substring_dedup(no_docs).count() == 0


@pytest.mark.parametrize("operator,size", [(substring_dedup, 20), (suffix_dedup, 50)])
@pytest.mark.parametrize("parts", [1, 40])
def test_rows_equal_in_id_and_text_are_one_document(spark, operator, size, parts):
    rng = random.Random(size)
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(1, long)] * 2 + [(2, "a b " + long + " c")] * 2 + [(d + 1000, t) for d, t in repeated_rows(size + 1)[:60]]
    again = rows + rng.choices(rows[2:], k=30)
    found = operator(spark.createDataFrame(again, "doc_id long, text string").repartition(parts)).collect()
    want = plain_removal(rows, size)
    assert want[1] == (60, 0, long) and want[2] == (63, 60, "a b c")
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept) for r in found) == sorted((d, *want[d]) for d, _ in again)


def test_many_texts_without_an_id(spark):
    texts = [" ".join(f"v{i}x{j}" for j in range(21)) for i in range(5000)]
    rows = [(None, t) for text in texts for t in (text, "new " + text)]
    found = substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    kept = [r.kept for r in found if r.kept not in ("", "new")]
    assert len(found) == 10_000 and sorted(k.removeprefix("new ") for k in kept) == sorted(texts)


def test_pipeline_keeps_other_texts_of_one_id(spark):
    import corpus_pipeline

    one, two = (" ".join(f"{x}{i}" for i in range(30)) for x in "ab")
    rows = [(1, one), (7, one), (7, two), (7, two), (8, two + " end"), (9, ""), (9, ""), (9, "short"), (None, two)]
    made = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert sorted(map(tuple, made.where("doc_id is not null").collect())) == [(1, one), (7, two), (9, ""), (9, "short")]
    assert made.where("doc_id is null").count() == 1


def plain_components(rows):
    sets = []
    for _, text in rows:
        w = words((text or "").translate(LOWER))
        sets.append({tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= 75 * (len(a) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), key), key)
    return {key: (len(sets[i]), least[find(i)]) for i, (key, _) in enumerate(rows)}


def near_rows(seed):
    rng, rows, bases = random.Random(seed), [], []
    for d in range(300):
        if not bases or rng.random() < 0.3:
            text = [f"w{rng.randint(0, 3000)}" for _ in range(rng.choice([0, 1, 3, 5, 8, 40, 90]))]
            bases.append(text)
        else:
            text = list(rng.choice(bases[:4] if rng.random() < 0.6 else bases))
            for _ in range(rng.choice([0, 0, 1, 2, 3, 4])):
                if text:
                    text[rng.randrange(len(text))] = f"z{rng.randint(0, 10**6)}"
        rows.append((rng.randrange(10**6) * 1000 + d, " ".join(x.upper() if rng.random() < 0.1 else x for x in text)))
    return rows


def test_similarity_join_equals_brute_force(spark):
    rows = near_rows(9)
    found = similarity_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    want = plain_components(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == want
    assert sum(k != c for k, (_, c) in want.items()) > 50


@pytest.mark.parametrize("rest,met", [([90, 80, 86], {1: 90, 3: 86}), ([90, 80, 85], {}), ([100, 99, 98], {1: 100, 2: 99, 3: 98})])
def test_a_shingle_too_far_behind_starts_no_pair(rest, met):
    """Three sets of 100 shingles: a link needs 86 in common, so the shared shingle and those behind it must be as many."""
    columns = [[7] * 3, [0] * 3, [1, 2, 3], [100] * 3, rest]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32()]
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["token", "salt", "id", "n", "rest"])
    found = [r for b in _shared_postings(iter([batch])) for r in b.to_pylist()]
    assert {r["id"]: r["rest"] for r in found} == met


def test_similarity_join_on_odd_rows(odd_docs, clashing, no_docs):
    found = similarity_join(odd_docs).collect()
    assert len(found) == 10
    of = {r.doc_id: r for r in found}
    assert of[7].component_id == of[8].component_id == 1 and of[2].component_id == 2 and of[3].n_shingles == 0
    assert of[4].n_shingles == 1 and of[None].component_id is None
    key = lambda r: (str(r.doc_id), str(r))
    assert sorted(similarity_join(clashing).collect(), key=key) == sorted(found, key=key)
    assert similarity_join(no_docs).count() == 0


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (5, 5)], "a long, b long")
    assert {r.node: r.root for r in components(links).collect()} == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100}


def test_bitmaps_leave_out_no_link_and_most_others():
    rng = np.random.default_rng(5)
    kept = others = 0
    for _ in range(3000):
        n, common = int(rng.integers(1, 600)), 0
        a = rng.integers(0, 2**64, n, dtype=np.uint64)
        common = int(rng.integers(0, n + 1))
        b = np.r_[a[:common], rng.integers(0, 2**64, int(rng.integers(0, n // 3 + 2)), dtype=np.uint64)]
        if not len(b):
            continue
        open_ = may_link(bitmap(a), len(a), bitmap(b), len(b))
        assert open_ == may_link(bitmap(b), len(b), bitmap(a), len(a))
        if 100 * common >= 75 * (len(a) + len(b) - common):
            assert open_
        else:
            kept, others = kept + open_, others + 1
    assert others > 1000 and kept < others / 5


def test_tables_of_texts_and_bitmaps_are_removed(spark):
    from pathlib import Path

    from lectern.llm.arrow import shared_folder

    folder = Path(shared_folder(spark).removeprefix("file:"))
    before = set(folder.glob("lectern_texts_*"))
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(base[:i % 4] + base[i % 4 + 1:])) for i in range(12)] + [(None, " ".join(base)), (90, None), (91, "")]
    found = {r.doc_id: r.component_id for r in similarity_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {i: 0 for i in range(12)} | {None: 0, 90: 90, 91: 91}
    assert set(folder.glob("lectern_texts_*")) == before and not [t for t in spark.catalog.listTables() if "lectern_texts" in t.name]
