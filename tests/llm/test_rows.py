"""Operators that work row by row: against brute force, and on odd rows."""

import os
import random
import re
import struct

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from lectern.llm import bpe, decontaminate, html_text, nearest, pii, quality, queries, secret_scan, words

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


@pytest.fixture(scope="module")
def entries():
    return bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def test_bpe_equals_tiktoken(entries):
    codec = bpe.Codec(entries, public_tokenizers.PATTERN)
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={e: i for i, e in enumerate(entries)},
                              special_tokens={})
    rng = random.Random(2)
    pools = ["abcdefghi thеing,!?#", " \t\n\r\x0b\x0c\x1c\x85\xa0 　a1", "éèêñ日本語中文кириллица😀🇩🇪a", "0123456789-., "]
    for k in range(2000):
        text = "".join(rng.choice(pools[k % 4]) for _ in range(rng.randint(0, 80)))
        ids = codec.encode(text)
        assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == other.encode_ordinary(text)
        assert codec.decode(ids) == text.encode()


def test_bpe_on_odd_rows(entries, odd_docs, clashing, no_docs):
    for docs in (odd_docs, clashing):
        encoded = bpe.encode(docs, entries, public_tokenizers.PATTERN)
        rows = bpe.decode(encoded, entries, public_tokenizers.PATTERN).collect()
        assert len(rows) == 10
        assert all(bytes(r.decoded) == (r.text or "").encode() and r.n_tokens == len(r.ids) // 4 for r in rows)
    assert bpe.encode(no_docs, entries, public_tokenizers.PATTERN).count() == 0


def test_bpe_vocabularies_by_turns(spark):
    """Workers go from one vocabulary to another and back without mixing them up."""
    single = [bytes([b]) for b in range(256)]
    vocabularies = [single + [b"ab", b"abc"], single + [b"bc", b"ca", b"bca"], single + [b"aa"]]
    docs = spark.createDataFrame([("abcabc",)], "text string").coalesce(1)
    for entries in vocabularies * 3:
        row = bpe.decode(bpe.encode(docs, entries, r"\w+"), entries, r"\w+").collect()[0]
        assert bytes(row.ids) == bpe.Codec(entries, r"\w+").encode("abcabc") and bytes(row.decoded) == b"abcabc"


def test_a_word_has_one_fingerprint_beside_any_other_words():
    def hashes(*texts):
        raw = [t.encode() for t in texts]
        return words.Words(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), words.SPACED).hash.tolist()

    alone = hashes("alpha beta") + hashes("x" * 3000)
    assert hashes("alpha beta", "x" * 3000) == alone
    assert len(set(hashes("x" * 3000, "x" * 3001, "x" * 2000 + "y" + "x" * 999, "x" * 976 + "y" + "x" * 2023))) == 4


def plain_spans(text):
    out = []
    for kind, expression in BASE.items():
        for m in re.finditer(expression, text):
            digits = "".join(re.findall("[0-9]", m.group()))
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == "card" and not (14 <= len(digits) <= 19 and pii.luhn(digits)):
                continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


def test_base_spans_equal_plain_search():
    rng = random.Random(1)
    pools = ["a@.b% ", "0123456789. -+()", "1.2 +(3)-", "ab@c.d 1+"]
    for i in range(20_000):
        text = "".join(rng.choice(pools[i % 4]) for _ in range(rng.randint(0, 50)))
        assert [s[:3] for s in pii.find_spans(text) if s[0] in BASE] == plain_spans(text)


def test_added_spans_need_checksum_or_context():
    kinds = lambda t: [s[0] for s in pii.find_spans(t)]
    assert kinds("IBAN DE89 3704 0044 0532 0130 00 ok")[:1] == ["iban"] and "iban" not in kinds("DE88 3704 0044 0532 0130 00")
    assert kinds("tel (030) 1234567") == ["local_phone"] and kinds("page (030) 1234567") == []
    assert kinds("ssn 123-45-6789") == ["social_security"] and kinds("part 123-45-6789") == []


def test_pii_on_odd_rows(odd_docs, clashing, no_docs):
    assert len(pii.detect(odd_docs).collect()) == len(pii.detect(clashing).collect()) == 10
    assert pii.redact(odd_docs).columns == odd_docs.columns and pii.redact(no_docs).count() == 0
    assert pii.redact_text("a@b.co and 1.2.3.4") == "<EMAIL> and <IP>" and pii.redact_text(None) is None


def test_hits_equal_plain_search(spark):
    rng = random.Random(4)
    word = lambda: f"v{rng.randint(0, 30)}"
    items = [(i, " ".join(word() for _ in range(rng.choice([0, 1, 3, 9, 10, 14, 30])))) for i in range(12)] + [(3, "Extra Item of one id"), (20, None)]
    docs = []
    for d in range(120):
        text = [word() for _ in range(rng.randint(0, 60))]
        if rng.random() < 0.5:
            part = rng.choice(items)[1]
            text[5:5] = (part or "").split()
        docs.append((d, rng.choice([" ", ", ", "--"]).join(text).title()))
    windows = {}
    for item, text in items:
        w = (text or "").lower().split()
        k = min(10, len(w))
        for s in range(len(w) - k + 1 if k else 0):
            windows.setdefault(tuple(w[s:s + k]), set()).add(str(item))
    found = {r.doc_id: r for r in decontaminate.contamination(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    for d, text in docs:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())
        hit, ids = set(), set()
        for k in {len(x) for x in windows}:
            for s in range(len(w) - k + 1):
                if tuple(w[s:s + k]) in windows:
                    hit.update(range(s, s + k))
                    ids |= windows[tuple(w[s:s + k])]
        assert (found[d].n_words, found[d].n_hit, found[d].items) == (len(w), len(hit), sorted(ids))
        assert all(m.words >= 1 and m.word + m.words <= len(w) for m in found[d].matches)


def test_blocks_of_a_large_benchmark_give_the_same(spark, monkeypatch):
    items = spark.createDataFrame([(i, " ".join(f"t{i + j}" for j in range(12))) for i in range(30)], "item_id long, text string")
    docs = spark.createDataFrame([(1, " ".join(f"t{j}" for j in range(25))), (2, "nothing")], "doc_id long, text string")
    whole = decontaminate.contamination(docs, items).drop("matches").collect()
    monkeypatch.setattr(decontaminate, "BLOCK_WINDOWS", 100)
    assert decontaminate.contamination(docs, items).drop("matches").collect() == whole


def test_decontamination_on_odd_rows(spark, odd_docs, clashing, no_docs):
    items = spark.createDataFrame([(1, "gamma delta"), (None, "words follow"), (2, "")], "item_id long, text string")
    assert decontaminate.remove_contaminated(odd_docs, items).columns == odd_docs.columns
    assert decontaminate.remove_contaminated(clashing, items).count() == 5
    assert decontaminate.contamination(no_docs, items).count() == 0
    assert decontaminate.remove_contaminated(odd_docs, items.where("false")).count() == 10


def test_factorisation_identity():
    rng = np.random.default_rng(0)
    model = quality.Model(np.zeros((len(quality.STATISTICS), quality.BINS - 1)), 0.3, rng.normal(size=quality.WORD_BUCKETS + 200),
                          rng.normal(size=(quality.WORD_BUCKETS + 200, 3)))
    import pyarrow as pa
    parts = quality.featurise(pa.array(["a b c b", "", "d e"]))
    columns, values, starts = quality.design(*parts, model.edges)
    for i, (a, b) in enumerate(zip(starts, [*starts[1:], len(columns)])):
        c, x = columns[a:b], values[a:b]
        pairs = sum(model.factors[c[p]] @ model.factors[c[q]] * x[p] * x[q] for p in range(len(c)) for q in range(p))
        assert np.isclose(model.logits(*parts)[i], model.bias + model.weights[c] @ x + pairs)


def test_quality_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.1"
    labels = queries.table(spark, folder, "labels").select("doc_id", "quality")
    rows = queries.op7_quality(spark, folder).join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in rows) / len(rows) > 0.95


def test_quality_on_odd_rows(odd_docs, clashing, no_docs):
    labels = odd_docs.selectExpr("doc_id", "cast(doc_id % 2 as int) quality")
    model = quality.train(odd_docs, labels)
    assert all(0 <= r.score <= 1 for r in quality.score(clashing, model).collect())
    assert quality.score(no_docs, model).count() == 0
    none = quality.train(odd_docs, labels.where("false"))
    assert {r.score for r in quality.score(odd_docs, none).collect()} == {0.5}


def test_neighbours(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(900, 16))
    v[100:300] = v[100] + rng.normal(scale=1e-3, size=(200, 16))
    v[300:330] = v[300]
    rows = [(i, v[i].tolist()) for i in range(900)] + [(2000, None), (2001, [0.0] * 16), (2002, [float("nan")] * 16), (2003, [None] * 16),
                                                      (None, v[3].tolist()), (5, v[5].tolist())]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = nearest.search(vectors, vectors.where("vec_id % 20 = 0"), k=20).collect()
    exact, hits = v @ v.T, 0
    for q in range(0, 900, 20):
        mine = sorted((r for r in found if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in mine] == list(range(1, 21)) and all(np.isclose(r.score, exact[q, r.vec_id]) for r in mine)
        assert q not in {r.vec_id for r in mine}
        order = sorted((i for i in range(900) if i != q), key=lambda i: (-round(exact[q, i], 9), i))[:20]
        hits += len({r.vec_id for r in mine} & set(order))
    assert hits / (45 * 20) >= 0.9 and {r.query_id for r in found} == set(range(0, 900, 20))
    assert nearest.search(vectors.where("false"), vectors.where("false")).count() == 0
    assert nearest.search(vectors.where("vec_id < 5"), vectors.where("vec_id = 0")).count() == 4


def test_pages(spark):
    rows = [(1, "http://a.b/x/1", '<body><div>Menu all</div><p>Own one &amp; two<p>Common para</p><div class="cookie-notice">C</div><p>last own</p><div>Foot all</div>'),
            (2, "http://a.b/x/2", "<body><div>Menu all</div><p>Other text</p><p>Common para</p><p>mine</p><div>Foot all</div>"), (3, None, None),
            (4, "http://c.d/", "plain < text & co<script>if(a<b)</script> x"), (4, "http://c.d/", "plain < text & co<script>if(a<b)</script> x"),
            (5, "http://z/", "<main><header><h1>T</h1></header><p>a<b>b</b> c<nav>no</nav></main><article class=comment>bad</article>")]
    found = html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((r.page_id, r.text) for r in found) == [
        (1, "Own one & two Common para last own"), (2, "Other text Common para mine"), (3, ""), (4, "plain < text & co x"),
        (4, "plain < text & co x"), (5, "T ab c")]
    assert html_text.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_every_page_is_compared_with_its_nearest(spark):
    """Nearest among many paths of a host, over copies of a page; article pages too."""
    wall = "<div>Top</div>{}<div>End</div>"
    rows = [(1, "http://h/a/1", wall.format("<p>one</p>")), (2, "http://h/a/2", wall.format("<p>one</p>")), (3, "http://h/a/3", wall.format("<p>three</p>")),
            (4, "http://h/b/x1", "<div>Other</div><p>four</p><div>Close</div>"), (5, "http://h/b/x2", "<div>Other</div><p>five</p><div>Close</div>"),
            (6, "http://h/b", "<div>Other</div><p>six</p><div>End</div>"),
            (7, "http://n/1", "<article>one long article</article><div>Share</div><p>own between</p><article>and its end</article><div>mine</div>"),
            (8, "http://n/2", "<article>one long article</article><div>Share</div><article>another end</article>"),
            (9, "http://alone/", "<article>one long article</article><div>Share</div><article>and its end</article>")]
    found = html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)).collect()
    assert {r.page_id: r.text for r in found} == {
        1: "one", 2: "one", 3: "three", 4: "four", 5: "five", 6: "six End", 7: "one long article own between and its end",
        8: "one long article another end", 9: "one long article and its end"}


def test_nearest_pages_equal_a_plain_search(spark, monkeypatch):
    monkeypatch.setattr(html_text, "NEIGHBOURS", 4)
    rng = random.Random(8)
    rows = list({(rng.choice("hg"), "".join(rng.choice("ab/") for _ in range(rng.randint(0, 6))), rng.randint(0, 3)) for _ in range(120)})
    pages = spark.createDataFrame([(h, p, s, [s]) for h, p, s in rows * 2], "host string, path string, sign long, hashes array<long>")
    found = html_text.nearest_pages(pages).collect()
    assert len(found) == len(rows)
    common = lambda a, b: len(os.path.commonprefix((a, b)))
    for r in found:
        others = [(p, s) for h, p, s in rows if h == r.host and s != r.sign]
        most = max(common(r.path, p) for p, _ in others)
        assert r.other[0] in {s for p, s in others if common(r.path, p) == most}


LONG = "long text of the article with many words " * 5


@pytest.mark.parametrize("page", [
    "<div class='content-sidebar-wrap'><main>{}</main></div><div class='sidebar'>no</div>", "<div class='no-sidebar'><p>{}</p></div>",
    "<article class='post category-search'>{}</article>", "<article class='post tag-social'>{}</article><div>no</div>",
    "<div class='no-sidebar'><article>{}</article></div><div class='related-posts'><article>no</article></div>",
    "<article>{0}</article><div id='comments'>no {0} {0} {0}</div>", "<div role='main'>{0}</div><div>no {0} {0}</div>",
    "<div class='site-main'><div class='ad'>no</div><p>{}</p><p class='share-links'>no</p></div>"])
def test_names_leave_no_article_out(page):
    lines, sure = html_text.page_lines(page.format(LONG))
    assert [t for t, s in zip(lines, sure) if s or not any(sure)] == [LONG.strip()]


@pytest.mark.parametrize("page", ["<div id='main-header'>Site</div><div class='post'>{}</div>", "<article>Site</article><div>{}</div>",
                                  "<article>Site</article><div class='no-sidebar'>{}</div>"])
def test_small_articles_and_names_with_main_do_not_hide_the_rest(page):
    assert html_text.page_lines(page.format(LONG)) == (["Site", LONG.strip()], [False, False])


@pytest.mark.parametrize("page", ['<a "' * 20_000, "<" * 50_000, "<div>" * 20_000, "<script " * 20_000, "<b></i>" * 20_000, "<!--" * 20_000])
def test_broken_markup_takes_linear_time(page):
    html_text.page_lines(page)


def test_shared_lines_are_a_longest_common_subsequence():
    rng = random.Random(6)
    for _ in range(300):
        a, b = ([rng.randint(0, 4) for _ in range(rng.randint(0, 12))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        kept = [x for x, s in zip(a, html_text.shared_lines(a, b)) if s]
        it = iter(b)
        assert len(kept) == best[-1][-1] and all(x in it for x in kept)


def test_secret_scan(odd_docs, clashing, no_docs, spark):
    docs = spark.createDataFrame(
        [(i, f'some words token = "{i * 7919:040x}" then thelongestwordofall here', "src") for i in range(1, 60)]
        + [(100, "AKIA" + "A1" * 8, None), (101, "4111111111111111 in averyveryverylongword", "a/test/b")], "doc_id long, text string, source string")
    found = secret_scan.rule_label(secret_scan.features(secret_scan.candidates(docs), secret_scan.dictionary(docs)))
    scored = secret_scan.score(found, secret_scan.fit(found)).collect()
    assert all((r.score >= 0.5) == bool(r.label) for r in scored if r.label is not None)
    assert len(scored) == 59 * 2 + 3
    assert secret_scan.candidates(odd_docs).count() == secret_scan.candidates(clashing).count() == 1
    empty = secret_scan.features(secret_scan.candidates(no_docs), secret_scan.dictionary(no_docs))
    assert secret_scan.score(empty, secret_scan.fit(secret_scan.rule_label(empty))).count() == 0


def test_short_assigned_secrets(spark):
    """Short values behind key words, once each; numbers of findings differ however many stand in a word."""
    lines = {'password = "Tr0ub4dor&3"': ["Tr0ub4dor&3"], "pwd=hunter2secret": ["hunter2secret"], "api_key: Ab9$kd!2xZ,": ["Ab9$kd!2xZ"],
             "auth_token := 'x7!y8@z9'.": ["x7!y8@z9"], "password required here": [], "key: https://host/path": [], "the key: short": [],
             "size=123456789": [], 'token="' + "aB3" * 8 + '"': ["aB3" * 8], "password =  s3cr3t!": ["s3cr3t!"]}
    docs = spark.createDataFrame([(i, f"some words {t} and more", "src") for i, t in enumerate(lines)]
                                 + [(99, " ".join(["aA1" * 6] * 3) + " " + ",".join(["bB2" * 6] * 1500), None)] * 2, "doc_id long, text string, source string")
    rows = secret_scan.candidates(docs).collect()
    for i, want in enumerate(lines.values()):
        assert [r.candidate for r in rows if r.key == i] == want
    many = [r.n for r in rows if r.key == 99]
    assert len(many) == 2 * 1503 and len(set(many)) == 1503
    found = {r.key: r for r in secret_scan.features(secret_scan.candidates(docs), ["the"]).collect() if r.key in (0, 1, 2)}
    assert all(r.keyword == 1 and r.assigned == 1 for r in found.values())


def test_pipeline_stages_keep_columns(spark, odd_docs, tmp_path):
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    docs = queries.table(spark, folder, "documents")
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, folder)
        if name != "tokens":
            assert made.columns == docs.columns
        made.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.count() > 100
    for name, stage in corpus_pipeline.STAGES[1:]:
        assert stage(spark, odd_docs, folder).count() >= 5
        assert stage(spark, odd_docs.where("false"), folder).count() == 0


def test_a_task_of_the_pipeline_has_one_worker_at_a_time(spark, odd_docs, entries):
    import corpus_pipeline

    made = corpus_pipeline.tokenize(spark, odd_docs, "/root/testdata/sf0.001")
    assert made._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    rows = made.collect()
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={e: i for i, e in enumerate(entries)},
                                special_tokens={})
    want = [(r.doc_id, library.encode_ordinary(r.text or "")) for r in odd_docs.collect()]
    found = [(r.doc_id, list(struct.unpack(f"<{r.n_tokens}I", r.ids))) for r in rows]
    assert sorted(found, key=str) == sorted(want, key=str)
    assert all(r.exact for r in rows)


def test_bytes_bound_a_slice_as_texts_do(spark):
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    from lectern.llm.arrow import with_columns

    docs = spark.range(0, 12, 1, 1).select("id", F.when(F.col("id") != 5, F.repeat(F.lit("é"), 400_000).cast("binary")).alias("ids"))
    output = T.StructType([T.StructField("rows", T.LongType())])
    made = with_columns(docs, ["ids"], output, lambda x: [pa.array([len(x)] * len(x), pa.int64())]).select("id", "rows").collect()
    assert sorted(r.id for r in made) == list(range(12))
    assert max(r.rows for r in made) <= 4
