"""Small cases with known results, and brute-force checks of the order-dependent operators."""

import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F, Window as W

from lectern.functions import ordered, text as tx
from lectern.operators import anchors, captions, concepts, course, frames, lint, markdown, terms, timeindex
from lectern.session import spread
from lectern.sources import readers


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_rolling_captions(spark):
    df = spark.createDataFrame(
        [("v", 0, 0.0, "hello"), ("v", 1, 1.0, "hello"), ("v", 2, 2.0, "hello world"), ("v", 3, 3.0, ""), ("v", 4, 4.0, "next  line\n")],
        "video_id string, ord int, start double, text string")
    assert rows(captions.dedupe_rolling_captions(df), "ord", "text") == [(0, "hello"), (2, "world"), (4, "next line")]


def test_json3(spark):
    raw = ('{"events":[{"tStartMs":0},{"tStartMs":4500,"segs":[{"utf8":"This is "},{"utf8":"a three"}]},'
           '{"tStartMs":6000,"segs":[{"utf8":"\\n"}]},{"tStartMs":65200,"segs":[{"utf8":"next"}]}]}')
    df = captions.flatten_json3(spark.createDataFrame([("v", raw)], "video_id string, raw string"))
    text = captions.render_transcript(df).first()["text"]
    assert text == "[00:04] This is a three\n[01:05] next"


@pytest.mark.parametrize("overlap", [0, 1, 2, 3])
def test_chunks_cover_and_match_plain_walk(spark, overlap):
    rnd = random.Random(overlap)
    docs = [(i, "\n".join("x" * rnd.randint(1, 90) if rnd.random() > 0.1 else " " for _ in range(rnd.randint(1, 60)))) for i in range(30)]
    got = {}
    for r in captions.chunk_transcript(spark.createDataFrame(docs, "doc_id long, text string"), 200, overlap).collect():
        got.setdefault(r["doc_id"], []).append((r["chunk_no"], r["first_para"], r["last_para"], r["chars"]))
    for doc_id, text in docs:
        sizes = [len(p) for p in text.split("\n") if p.strip()]
        want, start, total, fresh = [], 0, 0, False
        for i, n in enumerate(sizes):
            total, fresh = total + n, True
            if total >= 200:
                want.append((len(want) + 1, start + 1, i + 1, total))
                start = max(start, i + 1 - overlap) if overlap else i + 1
                total, fresh = sum(sizes[start: i + 1]), False
        if fresh:
            want.append((len(want) + 1, start + 1, len(sizes), total))
        assert sorted(got.get(doc_id, [])) == want


def test_transcript_agreement_joins_no_pieces(spark):
    """Repeated, null and short runs match a plain count, and no side of a join (which may be sent to all) holds pieces."""
    from collections import Counter

    runs = [(f, r, "m", 1, 8, 60.0, 30.0, t) for f, r, t in [
        (1, 0, "abcabcabc\U0001F600x"), (1, 1, "abcabd"), (1, 1, "xabcab"), (1, 2, ""), (1, 3, None), (1, None, "abc"), (1, 4, "zz"),
        (2, 5, "aaaa"), (2, 5, "aaaa"), (2, 6, "aaaaaaaa"), (3, 0, ""), (3, 1, "q"), (3, 2, ""), (None, 0, "abc"), (4, None, "abc"), (5, 1, "ab"), (5, 2, "ab")]]
    df = spark.createDataFrame(runs, "file_id long, run_no int, model string, threads int, batch int, duration_s double, asr_s double, text string")
    out = captions.transcript_agreement(df)
    cut = lambda t: [t[i:i + 3] for i in range(max(len(t) - 2, 1))] if t else []
    base = {f: min(r for g, r, *_ in runs if g == f and r is not None) for f, r, *_ in runs if f and r is not None}
    held = lambda f, r: sum((Counter(cut(x[-1])) for x in runs if r is not None and x[:2] == (f, r)), Counter())
    want = []
    for f, r, *_, t in runs:
        if f is not None:
            both = len(cut(t)) + len(cut(next(x[-1] for x in runs if x[:2] == (f, base[f])))) if f in base else 0
            want.append((f, -1 if r is None else r, 0.5, 2 * (held(f, r) & held(f, base[f])).total() / both if both else 1.0))
    assert rows(out.na.fill(-1, ["run_no"]), "file_id", "run_no", "ratio", "similarity") == sorted(want)

    def joined(plan):
        below = [plan.children().apply(i) for i in range(plan.children().size())]
        here = {x.output().apply(i).name() for x in below for i in range(x.output().size())} if plan.nodeName() == "Join" else set()
        return here.union(*map(joined, below))

    assert "file_id" in joined(out._jdf.queryExecution().optimizedPlan())
    assert "piece" not in joined(out._jdf.queryExecution().optimizedPlan())


def test_ordered_helpers_match_plain_windows(spark):
    """A hot key cut into many segments gives the same as one window over it."""
    df = spark.range(3000).selectExpr("IF(id % 10 < 7, 'hot', CAST(id % 10 AS STRING)) AS k", "CAST(id AS INT) AS o", "id % 13 AS v")
    w = W.partitionBy("k").orderBy("o")
    lag = ordered.lag_row(df, ["k"], "o", {"p": "v"}, size=64)
    assert rows(lag, "k", "o", F.coalesce("p", F.lit(-1))) == rows(df.withColumn("p", F.lag("v").over(w)), "k", "o", F.coalesce("p", F.lit(-1)))
    total = ordered.running_sum(df, ["k"], "o", {"s": F.col("v")}, size=64)
    assert rows(total, "k", "o", "s") == rows(df.withColumn("s", F.sum("v").over(w)), "k", "o", "s")
    number = ordered.row_numbers(df, ["k"], "o", "n", F.floor(F.col("o") / 64))
    assert rows(number, "k", "o", "n") == rows(df.withColumn("n", F.row_number().over(w)), "k", "o", "n")


GLOSSARY = [
    (0, "categories", "通用", "全线", "权限（上下文）", 1, "", False, 1), (0, "categories", "编程", "art component", "@Component", 0, "", False, 2),
    (0, "candidates", "编程", "Stutter", "Starter", 0, "", False, 3), (1, "categories", "通用", "reactive", "Reactor", 0, "", False, 4)]
GSCHEMA = "layer int, area string, category string, wrong string, correct string, hits int, source string, disabled boolean, ord long"


@pytest.mark.parametrize("inline", [None, False])
def test_scan_and_apply(spark, inline):
    keys = terms.scan_keys(terms.active_entries(spark.createDataFrame(GLOSSARY, GSCHEMA)))
    text = "[00:01] 这一节讲 Reactive 的全线校验，\n[00:09] 用 Art Component 注解。stutter"
    docs = spark.createDataFrame([(1, text), (2, "没有")], "doc_id long, text string")
    hits = rows(terms.scan_terms(docs, keys, inline=inline), "ts", "wrong", "right", "candidate")
    assert hits == [("00:01", "Reactive", "Reactor", False), ("00:01", "全线", "权限", False),
                    ("00:09", "Art Component", "@Component", False), ("00:09", "stutter", "Starter", True)]
    fixed = terms.apply_terms(docs, keys, inline=inline)
    assert rows(fixed, "doc_id", "text") == [(1, "[00:01] 这一节讲 Reactor 的权限校验，\n[00:09] 用 @Component 注解。stutter"), (2, "没有")]
    assert rows(terms.apply_terms(fixed, keys, inline=inline), "text") == rows(fixed, "text")


def test_longest_key_wins_everywhere(spark):
    rnd = random.Random(5)
    words = sorted({"".join(rnd.choice("abc") for _ in range(rnd.randint(1, 4))) for _ in range(25)})
    keys = spark.createDataFrame([(w, w.upper(), "c", False) for w in words], "key string, right string, category string, candidate boolean")
    docs = [(i, "".join(rnd.choice("abcd \n") for _ in range(200))) for i in range(20)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = {}
    for i, text in docs:
        pos, out = 0, []
        while pos < len(text):
            hit = max((w for w in words if text.startswith(w, pos)), key=len, default=None)
            out.append(hit.upper() if hit else text[pos])
            pos += len(hit) if hit else 1
        want[i] = "".join(out)
    for inline in (None, False):
        assert dict(rows(terms.apply_terms(df, keys, inline=inline), "doc_id", "text")) == want


def test_locate_page_first_line_not_nearest(spark):
    lines = spark.createDataFrame([("v", 1, 0, 5), ("v", 1, 1, 525), ("v", 2, 0, 22)], "video_id string, page int, line_no int, ts_sec int")
    entries = spark.createDataFrame([("v", 9, None), ("v", 20, None), ("v", 522, 2), ("v", 522, None), ("v", 300, None)], "video_id string, sec int, only_page int")
    got = rows(timeindex.locate_page(entries, lines), "sec", F.coalesce("only_page", F.lit(0)), F.coalesce("page", F.lit(0)), F.coalesce("rel_sec", F.lit(-1)))
    assert got == [(9, 0, 1, 5), (20, 0, 2, 22), (300, 0, 0, -1), (522, 0, 1, 525), (522, 2, 0, -1)]


def test_diverse_anchors_match_greedy_walk(spark):
    rnd = random.Random(3)
    data = []
    for page in range(6):
        for tok in {"".join(rnd.choice("abcde") for _ in range(rnd.randint(4, 7))) for _ in range(60)}:
            data.append((1, page, tok, False, rnd.randint(1, 9), rnd.randint(0, 90)))
    df = spark.createDataFrame(data, "video_id int, page int, tok string, is_zh boolean, cnt long, first_ts int")
    got = {}
    for r in anchors.pick_diverse_anchors(df, 4).orderBy("page", "no").collect():
        got.setdefault(r["page"], []).append(r["keyword"])
    for page in range(6):
        cands = sorted([d for d in data if d[1] == page], key=lambda d: (-1.5 * d[4] * len(d[2]), -len(d[2]), d[2]))
        kept = []
        for d in cands:
            t = max(2, d[5] - 3)
            if len(kept) < 4 and not any(d[2] in k for k, _ in kept) and not any(abs(t - s) < 15 for _, s in kept):
                kept.append((d[2], t))
        assert got[page] == [k for k, _ in kept]


def test_text_helpers(spark):
    df = spark.createDataFrame([("　 a b \n",)], "s string")
    assert df.select(tx.strip(F.col("s"))).first()[0] == "a b"
    assert df.select(tx.squeeze(F.col("s"))).first()[0] == "a b"
    got = spark.createDataFrame([("1:02:03",), ("05:09",), ("x",), ("7",)], "s string").select(tx.clock_to_seconds(F.col("s"))).collect()
    assert [r[0] for r in got] == [3723.0, 309.0, None, None]


NOTE = "\n".join([
    "> 核心主线：数据", "> 课程来源：测试", "", "## 1. 开头", "第一句", "第二句", "> **记住这个就够了**：要点", "## 2. 结尾", "第三句", "第四句",
    "> **记住这个就够了**：收尾", "## 本讲小结", "| 概念 | 问题 | 一句话 |", "|---|---|---|", "| 甲 | b | c |", "| 乙 | e | f |", "**学完能说的 3 句话：**",
    "1. 一", "2. 二", "3. 三", "## 本讲知识地图", "```mermaid", "graph TD", "A[甲] -->|依赖| B[乙]", "```", "## 概念卡片", "### 甲", "+ 定义：d",
    "+ 出现：第 1 节「开头」、第 2 节「结尾」", "### 乙", "+ 定义：e", "+ 出现：第 1 节「开头」、第 2 节「结尾」", "+ 依赖：甲", "## 自测题",
    *[x for i in range(1, 5) for x in (f"{i}. 什么是甲？（对应：甲）", "**答案：** " + "长" * 45)], "## 视频时间索引", "+ [00:05](https://www.bilibili.com/video/BV1?p=1&t=5) 1. 开头"])
INDEX = NOTE.split("\n").index("## 视频时间索引") + 1
NSCHEMA = "note_id long, video_id long, path string, template string, note_type string, platform string, vid string, source_lang string, only_page int, text string"


def note(spark, text, path="notes/1-a.md", note_type="lecture"):
    return spark.createDataFrame([(1, 1, path, None, note_type, "bilibili", "BV1", "zh", None, text)], NSCHEMA)


def checks(spark, text, **kw):
    return {(r["check"], r["severity"], r["line"]) for r in lint.text_findings(lint.parse_notes(note(spark, text, **kw))).collect()}


def test_good_note_has_no_findings(spark):
    assert checks(spark, NOTE) == set()


@pytest.mark.parametrize("old,new,expected", [
    ("第一句", "见 [01:02]", ("V4-E1", "error", 5)), ("第一句", "- 列表", ("V4-LIST", "warning", 5)), ("第一句", "**核心必考** x", ("V4-E4", "error", 5)),
    ("> 课程来源：测试", "> 无", ("V4-HEAD", "error", 1)), ("+ 定义：d", "+ 定义：", ("V4-E6", "error", 27)), ("| 乙 | e | f |", "", ("V4-SUM", "warning", 12)),
    ("+ [00:05]", "+ x [00:05]", ("V4-E2", "error", INDEX)), ("t=5)", "t=x)", ("V4-E3", "error", INDEX + 1)), ("A[甲] -->|依赖| B[乙]", "A[甲] --> B[乙]", ("V4-KM-REL", "error", None)),
    ("A[甲]", "A[甲甲甲甲甲甲甲甲甲甲甲甲甲]", ("V4-KM-LABEL", "warning", 24)), ("```\n## 概念", "## 概念", ("V4-E7", "error", None))])
def test_one_rule_per_mutation(spark, old, new, expected):
    assert expected in checks(spark, NOTE.replace(old, new, 1))


def test_gate_with_transcripts(spark):
    parsed = lint.parse_notes(note(spark, NOTE))
    heard = spark.createDataFrame([(1, 1, "[00:04] " + "字" * 900)], "video_id long, page int, text string")
    got = {(r["check"], r["severity"]) for r in lint.transcript_findings(parsed, heard).collect()}
    assert got == {("V4-E3", "error")}  # link says 5, transcript line is at 4


def counted_notes(spark):
    """Three notes with images and index, and the number of texts written so far: each reading of a note writes its text."""
    seen = spark.sparkContext.accumulator(0)

    def written(text):
        seen.add(1)
        return text

    shots = "\n".join([NOTE, "![cap x](images/a.png) images/b.jpg", "**核心必考** [01:00]", "![y](images/a.png)"]).replace(
        "第一句", "**核心必考** [02:30]\n\n![cap](images/a.png)\n第一句", 1)
    df = spark.createDataFrame([(i, i, "notes/1-a.md", None, "lecture", "bilibili", f"BV{i}", "zh", None, t) for i, t in
                                ((1, NOTE), (2, shots), (3, NOTE.replace("t=5)", "t=x)")))], NSCHEMA).coalesce(1)
    return df.withColumn("text", F.udf(written, "string").asNondeterministic()("text")), seen


def test_transcript_rules_write_each_note_once(spark):
    notes, seen = counted_notes(spark)
    heard = spark.createDataFrame([(1, 1, "[00:04] " + "字" * 900), (2, 1, "[09:00] x"), (4, 1, "[00:05] y")], "video_id long, page int, text string")
    out = lint.transcript_findings(lint.parse_notes(notes, [lint.TRANSCRIPTS]), heard)
    got = sorted((r["note_id"], r["check"], r["severity"], r["line"] or 0) for r in out.collect())
    index = INDEX + 1
    assert got == [(1, "V4-E3", "error", index), (2, "V4-E2", "error", index + 3), (2, "V4-RATIO", "warning", 0),
                   (3, "V4-E2", "warning", 0), (3, "V4-E3", "warning", 0), (3, "V4-RATIO", "warning", 0)]
    assert seen.value == 3


def test_image_rules_write_each_note_once(spark):
    notes, seen = counted_notes(spark)
    facts = lint.note_facts(lint.parse_notes(notes, [lint.IMAGES]), (lint.IMAGES,))
    inventory = spark.createDataFrame([(2, "images/a.png")], "note_id long, path string")
    manifest = spark.createDataFrame([(2, "a.png", "cap", 150.0, 2), (2, "a.png", "cap", 150.0, 2)],
                                     "note_id long, file string, keyword string, t double, section int")
    got = sorted((r["check"], r["line"] or 0, r["message"]) for r in lint.image_findings(facts, inventory, manifest).collect())
    assert got == [("V4-IMG", 0, "missing image: images/b.jpg"), ("V4-MANIFEST", 0, "caption without keyword: a.png"),
                   ("V4-MANIFEST", 0, "time differs: a.png"), ("V4-SHOT", 7, "belongs to section 2")]
    assert sorted(r["path"] for r in markdown.local_images(facts).collect()) == ["images/a.png", "images/b.jpg"]
    assert len(markdown.image_refs(facts).collect()) == 3
    assert seen.value == 3


def test_gate_stores_no_lines_of_notes(spark, monkeypatch):
    """The whole gate works through each note once and stores its findings, entries and images, not its text."""
    stored, keep = [], lint.durable_checkpoint
    monkeypatch.setattr(lint, "durable_checkpoint", lambda df: stored.append(df.columns) or keep(df))
    notes, seen = counted_notes(spark)
    heard = spark.createDataFrame([(1, 1, "[00:04] " + "字" * 900)], "video_id long, page int, text string")
    inventory = spark.createDataFrame([(2, "images/a.png")], "note_id long, path string")
    manifest = spark.createDataFrame([(2, "a.png", "cap", 150.0, 2)], "note_id long, file string, keyword string, t double, section int")
    out = lint.lint_notes(notes, heard, inventory, manifest)
    cols = ("note_id", "check", "severity", "line", "message")
    got = sorted(map(repr, rows(out.na.fill(0, ["line"]), *cols)))
    assert seen.value == 3 and stored and not {"text", "al", "ln", "lx"}.intersection(*[sum(stored, [])])
    parts = [lint.text_findings(lint.parse_notes(counted_notes(spark)[0])), lint.transcript_findings(lint.parse_notes(counted_notes(spark)[0]), heard),
             lint.image_findings(lint.parse_notes(counted_notes(spark)[0]), inventory, manifest)]
    assert got == sorted(repr(r) for p in parts for r in rows(p.na.fill(0, ["line"]), *cols))


def test_concept_key_folds_width_and_case(spark):
    df = concepts.concept_key(spark.createDataFrame([("Ａpi 网关",), ("API网关",), ("Straße",), ("STRASSE",)], "name string"))
    assert len({r["key"] for r in df.collect()}) == 2


def test_frame_timeline_matches_numpy(spark):
    """Cells and gain over a slice boundary equal a plain whole-video computation."""
    rng = np.random.default_rng(0)
    p = frames.Timeline(cell=2, ink_radius=1, plate_half=2, hold=3, slice_seconds=7)
    stack = rng.integers(0, 255, (30, 6, 8)).astype(np.int16)
    stack[10:] = stack[10]
    df = spark.createDataFrame([(1, i, 8, 6, [int(x) for x in f.ravel()]) for i, f in enumerate(stack)], "video_id long, t int, w int, h int, px array<int>")
    got = {r["t"]: r for r in frames.frame_cells(df, p).collect()}
    plates = np.stack([np.median(stack[max(0, i - 2): i + 3], axis=0).astype(np.uint8) for i in range(30)])
    pad = np.pad(plates.astype(float), [(0, 0), (1, 1), (1, 1)], mode="edge")
    box = sum(pad[:, y: y + 6, x: x + 8] for y in range(3) for x in range(3)) / 9
    density = (np.abs(plates - box) > p.ink_diff).reshape(30, 3, 2, 4, 2).mean(axis=(2, 4)).reshape(30, -1)
    assert len(got) == 30
    for i in range(30):
        assert np.allclose(got[i]["density"], density[i])
        assert np.allclose(got[i]["run"], density[max(0, i - 2): i + 1].min(axis=0))


def test_duplicates_collapse_hot_copies(spark):
    data = [(1, 1, i, [0] * 4, [10] * 8) for i in range(400)] + [(1, 1, 1000, [-1] * 4, [10] * 8)]
    df = spark.createDataFrame(data, "video_id int, page int, ord int, hash array<bigint>, thumb array<int>")
    got = rows(frames.near_duplicate_frames(df), "ord", F.coalesce("duplicate_of", F.lit(-1)))
    assert got == [(0, -1)] + [(i, 0) for i in range(1, 400)] + [(1000, -1)]


def test_partition_count_does_not_change_results(spark):
    docs = spark.range(40).selectExpr("id AS doc_id", "repeat('abc tion the \n', CAST(id % 7 + 1 AS INT)) AS text")
    keys = spark.createDataFrame([("the", "T", "c", False), ("tion", "N", "d", False)], "key string, right string, category string, candidate boolean")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    results = []
    for n in ("1", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        results.append(rows(terms.summarize_hits(terms.scan_terms(docs, keys), True), F.coalesce("doc_id", F.lit(-1)), F.coalesce("category", F.lit("")), "hits"))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert results[0] == results[1]


def test_bands_cover_all_bits_and_find_every_near_pair(spark):
    import random

    from lectern.operators import frames

    spans = frames.band_spans(256)
    assert len(spans) == 17 and {len(s) for s in spans} == {15, 16} and [i for s in spans for i in s] == list(range(256))
    assert len([s for s in frames.band_spans(17) if len(s)]) == 17
    with pytest.raises(ValueError):
        frames.near_duplicate_frames(spark.createDataFrame([], "video_id long, page int, ord int, hash array<long>, thumb array<int>"), bits=16)
    rng = random.Random(3)
    values = []
    for i in range(60):
        value = rng.getrandbits(256) if i % 3 == 0 else values[-1]
        for b in rng.sample(range(256), rng.choice([0, 5, 16, 17])):
            value ^= 1 << b
        values.append(value)
    words = [[((v >> (64 * (3 - k))) & (2**64 - 1)) - (2**64 if (v >> (64 * (3 - k) + 63)) & 1 else 0) for k in range(4)] for v in values]
    rows = [(1, 0, i, w, [0]) for i, w in enumerate(words)]
    found = {r.ord: r.duplicate_of for r in frames.near_duplicate_frames(
        spark.createDataFrame(rows, "video_id long, page int, ord int, hash array<long>, thumb array<int>")).collect()}
    kept, want = [], {}
    for i, v in enumerate(values):
        near = [j for j in kept if bin(v ^ values[j]).count("1") <= 16]
        want[i] = min(near) if near else None
        if not near:
            kept.append(i)
    assert found == want and len(kept) < 60


def test_both_dictionary_forms_match_alike(spark):
    from lectern.operators import terms

    docs = spark.createDataFrame([(1, "ſab [x] SA\nKelvin a[X y"), (2, ""), (3, "AB ab [12:34] sa")], "doc_id long, text string")
    schema = "key string, right string, category string, candidate boolean"
    keys = spark.createDataFrame([("sa", "one", "c", False), ("ab", "two", "c", True), ("[x", "three", "c", False), ("kel", "four", "d", False)], schema)
    for operator in (terms.scan_terms, terms.apply_terms):
        small, large = (sorted(operator(docs, keys, inline=i).collect(), key=str) for i in (None, False))
        assert small == large and small
        empty = keys.where("false")
        assert sorted(operator(docs, empty).collect(), key=str) == sorted(operator(docs, empty, inline=False).collect(), key=str)
        for inline in (None, False):
            with pytest.raises(ValueError):
                operator(docs, spark.createDataFrame([("a\nb", "r", "c", False)], schema), inline=inline)


def test_pixel_windows_follow_time_over_gaps(spark):
    """Rows do not depend on where slices begin, also behind a gap."""
    import numpy as np

    from lectern.operators import frames

    rng = np.random.default_rng(5)
    seconds = [*range(0, 20), *range(33, 50), 70, 71, 90]
    data = spark.createDataFrame([(1, t, 8, 8, rng.integers(0, 256, 64).tolist()) for t in seconds], "video_id long, t int, w int, h int, px array<int>")
    made = []
    for size in (7, 16, 1000):
        p = frames.Timeline(cell=2, ink_radius=1, plate_half=2, hold=3, slice_seconds=size)
        made.append({r.t: r for r in frames.frame_cells(data, p).collect()})
    assert made[0].keys() == set(seconds) and made[0] == made[1] == made[2]


def test_candidates_of_a_video_with_gaps(spark):
    """Lost and sampled frames: the reference is the next frame that exists, as in a plain walk over the frames."""
    from lectern.operators import frames

    p = frames.Timeline(min_seg=4, pre=5, post=6)
    rng = np.random.default_rng(7)
    at = [t for t in range(60) if t not in (5, 6, 15, 33, 34)] + list(range(60, 120, 3))
    seg = [sum(t >= c for c in (20, 40, 75)) for t in at]
    gain, seen = rng.random((2, len(at), 4))
    rows = [(1, t, s, g.tolist(), v.tolist(), float(g.mean()), float((g * v).mean())) for t, s, g, v in zip(at, seg, gain, seen)]
    segmented = spark.createDataFrame(rows, "video_id long, t int, seg int, gain array<double>, seen array<double>, content double, visible double")
    shots = [(i, 1, float(ra), float(ra + 7)) for i, ra in enumerate((2, 10, 11, 20, 38, 39, 66, 80.5))]
    got = frames.frame_candidates(segmented, spark.createDataFrame(shots, "shot_id long, video_id long, ra double, rb double"), p).collect()
    want = set()
    for shot, _, ra, rb in shots:
        for k in range(4):
            own = [i for i in range(len(at)) if seg[i] == k]
            idx = [i for i in own if ra - p.pre <= at[i] <= rb + p.post]
            ref = max(own[0], int(np.searchsorted(at, ra - p.pre)))
            for part in ([i for i in idx if at[i] <= rb], [i for i in idx if at[i] > rb]):
                if part:
                    score = {i: (np.clip(gain[i] - gain[ref], 0, None) * seen[i]).mean() + p.total_w * (gain[i] * seen[i]).mean() + 1e-7 * at[i] for i in part}
                    best = max(part, key=score.get)
                    want.add((shot, at[best], round(float(score[best]), 9)))
    assert {(r.shot_id, r.t, round(r.score, 9)) for r in got} == want


def test_timeline_does_not_depend_on_slices(spark):
    """Cuts by change and by erased content, on and beside slice borders, for bytes and for numbers."""
    from dataclasses import replace

    import numpy as np

    p = frames.Timeline(cell=4, ink_radius=2, plate_half=1, hold=2, erase_lag=3, min_seg=1, max_motion=1.0, slice_seconds=1000)
    rng = np.random.default_rng(5)
    rows = []
    for video, gaps in ((1, ()), (2, (13, 14, 30))):
        board = np.full((8, 8), 20, np.uint8)
        for t in range(70):
            if t % 11 == 7:
                board = np.full((8, 8), 20, np.uint8)
            if t % 3 == 0:
                board[rng.integers(0, 8), rng.integers(0, 8)] = 230
            if t in (24, 48):
                board = 255 - board
            if t not in gaps:
                rows.append((video, t, 8, 8, board.tobytes()))
    stored = spark.createDataFrame(rows, "video_id long, t int, w int, h int, px binary")
    numbers = spark.createDataFrame([(*r[:4], list(r[4])) for r in rows], "video_id long, t int, w int, h int, px array<int>")
    results = []
    for df, size in ((stored, 1000), (numbers, 1000), (stored, 7), (stored, 16)):
        q = replace(p, slice_seconds=size)
        out = frames.segment_timeline(frames.content_timeline(frames.persistent_content(frames.frame_cells(df, q), q), q), q)
        results.append(sorted((r.video_id, r.t, r.cut, r.seg, round(r.content, 9)) for r in out.collect()))
    assert results[0] == results[1] == results[2] == results[3]
    cuts = [r[1] for r in results[0] if r[0] == 1 and r[2]]
    assert len(cuts) > 5 and all(b - a > 3 for a, b in zip(cuts, cuts[1:]))
    assert [r[3] for r in results[0] if r[0] == 1] == [sum(0 < c <= t for c in cuts) for t in range(70)]


def test_both_dictionary_forms_match_alike(spark):
    """Against a plain search, on letters whose lower case depends on neighbours, has several sources or changes length."""
    import random

    rng = random.Random(11)
    letters = "ΟΔΣσςοδİiıIKkKÅåẞßſsS𐐀𐐨日ab́ "

    def fold(text):
        return "".join({"Σ": "σ", "ς": "σ", "İ": "i"}.get(c, c.lower()) for c in text)

    def some(n):
        return "".join(rng.choice(letters) for _ in range(n))

    wrongs = {some(rng.randint(1, 4)) for _ in range(60)} | {"οδος", "ΟΔΟΣ", "i", "sß"}
    wrongs = sorted(w for w in wrongs if w.strip())
    rows = [(0, "categories" if i % 3 else "candidates", "c", w, f"R{i}", 0, "t", False, i) for i, w in enumerate(wrongs)]
    glossary = spark.createDataFrame(rows, "layer int, area string, category string, wrong string, correct string, hits long, source string, disabled boolean, ord long")
    keys = terms.scan_keys(terms.active_entries(glossary))
    table = {r.key: r for r in keys.collect()}
    assert set(table) == {fold(w) for w in wrongs}
    texts = [(i, "".join(some(rng.randint(0, 30)) + rng.choice(["", "\n", "[00:05]"]) for _ in range(rng.randint(0, 5)))) for i in range(60)] + [(98, ""), (99, None)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    want, fixed = [], {98: "", 99: None}
    for i, text in texts[:-2]:
        at, out, low = 0, [], fold(text)
        while at < len(text):
            n = next((n for n in range(4, 0, -1) if low[at:at + n] in table and "\n" not in low[at:at + n]), 0)
            if n:
                hit = table[low[at:at + n]]
                want.append((i, text[at:at + n], hit.right, hit.candidate))
                out.append(text[at:at + n] if hit.candidate else hit.right)
            else:
                out.append(text[at])
            at += n or 1
        fixed[i] = "".join(out)
    for inline in (True, False):
        hits = terms.scan_terms(docs, keys, inline=inline).orderBy("doc_id", "unit_no", "hit_no").collect()
        assert [(r.doc_id, r.wrong, r.right, r.candidate) for r in hits] == want
        applied = {r.doc_id: r.text for r in terms.apply_terms(docs, keys, inline=inline).collect()}
        assert {k: v or "" for k, v in applied.items()} == {k: v or "" for k, v in fixed.items()}
    both = [sorted(map(tuple, terms.scan_terms(docs, keys, inline=x).collect()), key=str) for x in (True, False)]
    assert both[0] == both[1]


@pytest.mark.parametrize("inline", [None, False])
def test_terms_equal_a_plain_walk(spark, inline):
    rnd, words = random.Random(3), ["th", "the", "eau", "eaux", "[0", "σ", "q x", "一二"]
    parts = [*words, "THE", "Eau", "Σ", "ς", "İ", "\n", "\r", " ", "x", "[01:02]", "[1:02]", "😀", "0", "要"]
    docs = [(i, "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 60)))) for i in range(60)]
    low = str.maketrans({"Σ": "σ", "ς": "σ", "İ": "i"})
    want, fixed = [], {}
    for doc, text in docs:
        fold = text.translate(low).lower()
        cuts = sorted({0, len(text), *(m.start() for m in re.finditer(r"\[\d{1,2}:\d{2}\]", text)), *(i + 1 for i, c in enumerate(text) if c == "\n")})
        ts, new, last = "--:--", "", 0
        for a, b in zip(cuts, cuts[1:]):
            mark = re.match(r"\[(\d{1,2}:\d{2})\]", text[a:])
            ts, i = mark[1] if mark else ts, a
            while i < b:
                fits = [w for w in words if fold.startswith(w, i) and i + len(w) <= b]
                if not fits:
                    i += 1
                    continue
                w = max(fits, key=len)
                around = text[max(0, i - 20):i] + "【" + text[i:i + len(w)] + "】" + text[i + len(w):i + len(w) + 20]
                want.append((doc, ts, text[i:i + len(w)], around.replace("\r", " ").replace("\n", " ")))
                new, last, i = new + text[last:i] + "<" + w + ">", i + len(w), i + len(w)
        fixed[doc] = new + text[last:]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    keys = spark.createDataFrame([(w, f"<{w}>", "c", False) for w in words], "key string, right string, category string, candidate boolean")
    assert rows(terms.scan_terms(df, keys, inline=inline), "doc_id", "ts", "wrong", "context") == sorted(want)
    if inline is False:
        assert dict(rows(terms.apply_terms(df, keys, inline=inline), "doc_id", "text")) == fixed


def test_many_terms_in_one_line(spark):
    docs = spark.createDataFrame([(1, "the " * 80_000)], "doc_id long, text string")
    keys = spark.createDataFrame([("the", "T", "c", False)], "key string, right string, category string, candidate boolean")
    start = time.monotonic()
    assert terms.scan_terms(docs, keys).count() == 80_000
    assert terms.apply_terms(docs, keys).first()["text"] == "T " * 80_000
    assert time.monotonic() - start < 30  # each match is handled once, not copied with all those before it


def test_rows_of_one_row_group_are_dealt_out(spark, tmp_path):
    spark.range(20_000).selectExpr("id", "repeat(sha2(cast(id AS string), 256), 3) AS text").coalesce(1).write.parquet(str(tmp_path / "t"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", 1 << 17)
    try:
        table = spark.read.parquet(str(tmp_path / "t"))
        assert table.rdd.getNumPartitions() >= 8  # splits by bytes, one of them with all rows
        dealt = spread(table)
        per_task = [r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert dealt.columns == table.columns and sum(per_task) == 20_000
    assert len(per_task) >= 8 and max(per_task) < 5_000


def test_lines_are_cut_at_all_line_ends(spark):
    texts = ["", "a", "a\n", "\n", "\n\n", "a\r\n", "a\n\r", "a\rb\n\nc\n\n", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.l for r in df.select("i", tx.lines_of(F.col("t")).alias("l")).collect()}
    assert [got[i] for i in range(len(texts))] == [t and t.splitlines() or t and [t] or (None if t is None else [""]) for t in texts]


def test_promotion_moves_entries_once(spark):
    glossary = spark.createDataFrame(
        [(0, "candidates", "a", "X", "x0", 1, ""), (1, "candidates", "a", "x", "x1", 2, "s"), (1, "candidates", "b", "X", "x2", 3, ""),
         (0, "candidates", "a", "y", "y0", 4, ""), (1, "categories", "a", "y", "y1", 5, "")],
        "layer int, area string, category string, wrong string, correct string, hits int, source string")
    requests = spark.createDataFrame(
        [(1, "x", "a"), (2, "x", None), (3, "x", "c"), (4, "Y", None), (5, "z", None), (6, "y", None), (6, "x", "b"), (7, "y", "a"), (7, "y", "a")],
        "request_id long, word string, category string")
    done = terms.promote_terms(glossary, requests, "d")
    assert rows(done, "request_id", "status", "correct", "layer", "source") == [
        (1, "promoted", "x1", 1, "s | promoted:d"), (2, "ambiguous", None, None, None), (3, "not_in_category", None, None, None),
        (4, "promoted", "y0", 0, "promoted:d"), (5, "missing", None, None, None), (6, "promoted", "x2", 1, "promoted:d"),
        (7, "ambiguous", None, None, None)]
    plan = done._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 1


def test_item_history_reads_only_what_is_asked_for(spark):
    items = spark.createDataFrame([(1, "A", 1, 1, 1), (1, "B", 2, 2, 2), (2, "A", 1, 1, 1)], "course_id long, bvid string, cid long, page int, idx int")
    items = items.withColumn("status", F.lit("pending"))
    history = spark.createDataFrame(
        [(1, "A", 1, 1, 5, "done", None, "x"), (1, "A", 1, 1, 2, "failed", "n", "y"), (2, "A", 1, 1, None, "done", "n", "z")],
        "course_id long, bvid string, cid long, page int, ord long, status string, note string, more string")
    merged = course.merge_item_history(items, history)
    assert rows(merged, "course_id", "bvid", "status", "note", "more") == [(1, "A", "done", None, "x"), (1, "B", "pending", None, None), (2, "A", "pending", None, None)]
    plan = merged.select("idx", "status")._jdf.queryExecution().optimizedPlan().toString()
    assert "max_by(more" not in plan and "max_by(status" in plan and "RepartitionByExpression" in plan


def test_blanks_are_trimmed_as_the_pattern_says(spark):
    blanks = "\t\n\x0b\f\r\x1c\x1f \x85\xa0\u1680\u2000\u200a\u2028\u2029\u202f\u205f\u3000"
    texts = [*blanks, *[f"{b}a {b} é{b}{b}" for b in blanks], "", "\u200b x \u200b", "a", None, "\x00 \x00", " \ud55c\u3000"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    pattern = f"^{tx.BLANK}+|{tx.BLANK}+$"
    found = df.select(tx.strip(F.col("t")).alias("a"), F.expr(markdown.strip_sql("t")).alias("b"), F.regexp_replace("t", pattern, "").alias("c"),
                      tx.rstrip(F.col("t")).alias("d"), F.regexp_replace("t", f"{tx.BLANK}+$", "").alias("e")).collect()
    assert all(r.a == r.b == r.c and r.d == r.e for r in found)


def test_outline_takes_one_pass_over_the_lines(spark):
    rng = random.Random(3)
    cases = [[rng.choice(["```", "## a", "x", "## 1. b", "```java"]) for _ in range(rng.randint(1, 30))] for _ in range(20)]
    cases.append([rng.choice(["```", "## a", "x", "y"]) for _ in range(40_000)])
    notes = spark.createDataFrame([(i, "\n".join(c), None) for i, c in enumerate(cases)], "note_id int, text string, template string")
    start = time.time()
    found = {r.note_id: r.lx for r in markdown.outline(notes).select("note_id", "lx").collect()}
    assert time.time() - start < 30
    for i, lines in enumerate(cases):
        fence = head = shown = 0
        for n, line in enumerate(lines, 1):
            fence += line.startswith("```")
            head = n if line.startswith("##") else head
            shown = n if line.startswith("##") and fence % 2 == 0 else shown
            x = found[i][n - 1]
            assert (x.n, x.s, x.f, x.h, x.g) == (n, line, fence % 2 == 1, head, shown)


def test_course_notes_are_parsed_once(spark):
    text = "---\nnote_type: short\n---\n## 1. a\n## 概念卡片\n### b"
    notes = spark.createDataFrame([(1, text, None), (2, text, "v4-obsidian"), (2, "x", None), (None, text, None)],
                                  "note_id long, text string, template string")
    found = markdown.parse_course_notes(notes)
    assert "Generate" not in found._jdf.queryExecution().toString()
    # front matter is joined by id: a repeated id meets each of its rows, a null one none
    assert rows(found, "note_id", "note_type", "sections", "error") == [
        (1, "lecture", 1, ""), (2, "lecture", 0, "no card section"), (2, "lecture", 1, ""), (2, "short", 0, ""), (2, "short", 1, "")]
