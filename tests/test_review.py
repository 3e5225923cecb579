"""Course review: order of the model, documents line by line, queue."""

import pytest

from lectern.functions import text as tx
from lectern.functions.ordered import sorted_numbers
from lectern.operators import review

NOW = "2026-12-01T00:00:00+00:00"


@pytest.fixture(scope="module")
def model(spark):
    cards = spark.createDataFrame([
        (1, 1, 10, "Ａpi 网关", " first ", "Gateway"), (1, 1, 11, "队|列", "", ""), (1, 2, 20, "API网关", "second", "gateways"),
        (1, 2, 21, "缓存", "cache\nline", "Gateway"), (1, 2, 22, "api 网关", "first", "Proxy"), (2, 5, 1, "solo", "", "")],
        "course_id long, idx int, card_no long, name string, definition string, original string")
    refs = spark.createDataFrame([
        (1, 1, 10, "depends", 0, "队|列"), (1, 2, 20, "depends", 0, "ＮＯＮＥ"), (1, 2, 22, "depends", 0, "none"),
        (1, 1, 10, "confusable", 0, "缓存、x——why")], "course_id long, idx int, card_no long, field string, pos int, ref string")
    appears = spark.createDataFrame([
        (1, 1, 10, 0, 3, "C"), (1, 1, 10, 1, 2, "B"), (1, 1, 11, 0, 1, "A|a"), (1, 2, 20, 0, 1, "D"), (1, 2, 21, 0, 1, "D"), (2, 5, 1, 0, 9, "Z")],
        "course_id long, idx int, card_no long, pos int, section int, section_name string")
    nav = spark.createDataFrame([(1, 1, 1, "01:00", "u1"), (1, 1, 2, "02:00", None), (1, 2, 1, "03:00", "u3")],
                                "course_id long, idx int, section int, time string, url string")
    questions = spark.createDataFrame([
        (1, 1, 1, "why?", "api网关", "line 1\nline 2"), (1, 2, 1, "again", "API 网关", "b"), (1, 2, 2, "lost", "other", None), (1, 2, 3, "none", None, "c")],
        "course_id long, idx int, no int, stem string, correspond string, answer string")
    return review.course_model(cards, refs, appears, nav, questions)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, "Kurs", 1, "One", "n/a b(1).md"), (1, "Kurs", 2, "Two", "n\\第二.md"), (2, "Solo", 5, "Five", "s.md")],
                                 "course_id long, course_title string, idx int, title string, note string")


@pytest.fixture(scope="module")
def marks(spark):
    return spark.createDataFrame([(1, "队|列", True), (1, "缓存", False), (1, "gone", True)], "course_id long, key string, mastered boolean")


def lines(df, course):
    rows = df.filter(f"course_id = {course}").orderBy("line_no").collect()
    assert [r.line_no for r in rows] == list(range(1, len(rows) + 1))
    return [r.line for r in rows]


def test_concepts_go_by_item_section_and_card(model):
    rows = model.concepts.filter("course_id = 1").orderBy("first").collect()
    assert [(r.key, r.name, r.definition, r.original, r.groups, r.multi_item) for r in rows] == [
        ("队|列", "队|列", "", "", 0, False), ("api网关", "Ａpi 网关", "first", "Gateway", 2, True), ("缓存", "缓存", "cache\nline", "Gateway", 1, False)]


def test_concept_document(model, items, marks):
    assert lines(review.concept_document(model, items, marks, NOW), 1) == [
        f"> 课程：Kurs｜概念 3 个（跨集出现 1 个）｜已掌握 1 / 3｜来自 2 篇已完成的笔记｜更新于 {NOW}", review.TABLE_USAGE, "",
        "## 第 1 集 · One", "",
        "+ [x] **队\\|列**", "  + 定义：", "  + 出现：", "    + 第 1 集 第 1 节「A\\|a」：[笔记](n/a%20b%281%29.md) · [▶ 01:00](u1)", "",
        "+ [ ] **Ａpi 网关**（Gateway）", "  + 定义：first", "  + 出现：",
        "    + 第 1 集 第 2 节「B」：[笔记](n/a%20b%281%29.md) · [02:00]", "    + 第 1 集 第 3 节「C」：[笔记](n/a%20b%281%29.md) · （无时间点）",
        "    + 第 2 集 第 1 节「D」：[笔记](n/第二.md) · [▶ 03:00](u3)", "    + 第 2 集：[笔记](n/第二.md) · （无时间点）",
        "  + 其它集的说法：", "    + 第 2 集：second", "  + 依赖：队\\|列、ＮＯＮＥ｜易混：缓存、x——why", "  + 自测：第 1 集第 1 题、第 2 集第 1 题", "",
        "## 第 2 集 · Two", "",
        "+ [ ] **缓存**（Gateway）", "  + 定义：cache line", "  + 出现：", "    + 第 2 集 第 1 节「D」：[笔记](n/第二.md) · [▶ 03:00](u3)"]
    assert lines(review.concept_document(model, items, marks, NOW), 2)[-1] == "    + 第 5 集 第 9 节「Z」：[笔记](s.md) · （无时间点）"


def test_quiz_document(model, items, marks):
    got = lines(review.quiz_document(model, items, marks), 1)
    assert got[:9] == [
        "> 课程：Kurs｜共 4 题，来自 2 篇笔记｜没掌握的概念涉及 2 题｜答案不折叠，先遮住答案再自测", review.QUIZ_USAGE, "",
        "## 先复习：还没掌握的概念（2 题）", "", "### Ａpi 网关（Gateway）", "", "1. why?（第 1 集第 1 题）", ""]
    assert got[9:14] == ["**答案：** line 1", "line 2", "", "[笔记](n/a%20b%281%29.md)", ""] or got[9:13] == [
        "**答案：** line 1", "line 2", "", "[笔记](n/a%20b%281%29.md)"]
    assert "2. again（第 2 集第 1 题）" in got and "[▶ 回看 03:00](u3) · [笔记](n/第二.md)" in got
    tail = got[got.index("## 全部题目（按集）"):]
    assert [x for x in tail if x and (x[0] == "#" or x[0].isdigit())] == [
        "## 全部题目（按集）", "### 第 1 集 · One", "1. why?（对应：api网关；第 1 集第 1 题）",
        "### 第 2 集 · Two", "1. again（对应：API 网关；第 2 集第 1 题）", "2. lost（对应：other；第 2 集第 2 题）", "3. none（对应：；第 2 集第 3 题）"]
    assert got[-1] == "[笔记](n/第二.md)"
    assert lines(review.quiz_document(model, items, marks), 2) == [
        "> 课程：Solo｜共 0 题，来自 1 篇笔记｜没掌握的概念涉及 0 题｜答案不折叠，先遮住答案再自测", review.QUIZ_USAGE, "", review.QUIZ_UNMARKED, "", "## 全部题目（按集）"]


def test_checks_and_queue(model, items, marks):
    from pyspark.sql import functions as F

    state = items.select("course_id", "idx", F.lit("").alias("parse_error"), F.lit(True).alias("note_exists"), F.lit(True).alias("stale"))
    found = {(r.check, r.idx, r.concept, r.message) for r in review.model_checks(model, state).filter("course_id = 1").collect()}
    assert found == {("CR-STALE", None, None, "review is stale"), ("CR-ORIG", 1, "Ａpi 网关", "2"), ("CR-SAME", 2, "缓存", "gateway"),
                     ("CR-DEP", 1, "Ａpi 网关", "depends: ＮＯＮＥ"), ("CR-DEP", 1, "Ａpi 网关", "confusable: x"),
                     ("CR-QUIZ", 2, "other", "2"), ("CR-QUIZ", 2, None, "3"), ("CR-JUMP", 1, "Ａpi 网关", "2"), ("CR-JUMP", 1, "Ａpi 网关", "3"),
                     ("CR-JUMP", 2, "Ａpi 网关", "-")}
    queue = review.model_queue(model, marks, limit=1).filter("course_id = 1").orderBy("idx").collect()
    assert [(r.pos, r.name, r.original, r.truncated, r.idx, r.no) for r in queue] == [(1, "Ａpi 网关", "Gateway", True, 1, 1), (1, "Ａpi 网关", "Gateway", True, 2, 1)]


def test_numbers_run_over_partitions(spark):
    rows = [(k, i * 7919 % 1000) for k in ("a", "b") for i in range(1000 if k == "b" else 3)]
    df = spark.createDataFrame(rows, "k string, o int").repartition(16)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = sorted_numbers(df, "k", "o", "n").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    want = {}
    for k, o in sorted(rows):
        want.setdefault(k, []).append(o)
    assert {(r.k, r.n): r.o for r in got} == {(k, i): o for k, v in want.items() for i, o in enumerate(v, 1)}


def test_link_paths(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("a b/第一.md",), ("x\\y+*~!'%é😀.md",), (None,)], "p string")
    assert [r[0] for r in df.select(tx.link_path(F.col("p"))).collect()] == ["a%20b/第一.md", "x/y%2B%2A~%21%27%25%C3%A9%F0%9F%98%80.md", ""]


def test_closest_keys_equal_brute_force(spark):
    import random

    from lectern.operators import concepts

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("abc概") for _ in range(n))
    keys = sorted({(c, word(rng.randint(1, 12))) for c in (1, 2) for _ in range(60)} | {(3, "solo"), (3, "much longer than any of the others")})
    asked = sorted({(c, word(rng.randint(1, 14))) for c in (1, 2) for _ in range(15)} | {(3, "x"), (1, "aaaaaaaaaaaaaaaaaaaaaaaa"), (4, "nothing here")})
    got = sorted(map(tuple, concepts.closest_keys(spark.createDataFrame(asked, "course_id long, asked string"), spark.createDataFrame(keys, "course_id long, key string")).collect()))
    want = [(c, a, r, k) for c, a in asked for r, (_, k) in enumerate(sorted((distance(a, k), k) for d, k in keys if d == c)[:3], 1)]
    assert got == sorted(want)


def test_questions_are_attributed_when_they_are_read(spark):
    cards = spark.createDataFrame([(1, 1, 1, "a", "d", "")], "course_id int, idx int, card_no long, name string, definition string, original string")
    refs = spark.createDataFrame([], "course_id int, idx int, card_no long, field string, pos int, ref string")
    appears = spark.createDataFrame([], "course_id int, idx int, card_no long, pos int, section int, section_name string")
    nav = spark.createDataFrame([], "course_id int, idx int, section int, time string, url string")
    asked = spark.createDataFrame([(1, 1, 1, "s", "A", "x")], "course_id int, idx int, no long, stem string, correspond string, answer string")
    model = review.course_model(cards, refs, appears, nav, asked)
    assert "questions" not in vars(model)
    assert [r.concept for r in model.questions.collect()] == ["a"] and model.questions is model.questions


def test_quiz_is_made_from_compressed_tables_and_without_values(spark):
    cards = spark.createDataFrame([(1, 1, 1, "a", "d", "x"), (1, 2, 2, "A", "e", "X"), (None, 3, 3, "b", "f", ""), (1, None, 4, "c", None, None)],
                                  "course_id int, idx int, card_no long, name string, definition string, original string")
    refs = spark.createDataFrame([(1, 1, 1, "depends", 0, "b")], "course_id int, idx int, card_no long, field string, pos int, ref string")
    appears = spark.createDataFrame([(1, 1, 1, 0, 2, "S"), (1, 2, 2, 0, 1, "T")], "course_id int, idx int, card_no long, pos int, section int, section_name string")
    nav = spark.createDataFrame([(1, 1, 2, "00:10", "u")], "course_id int, idx int, section int, time string, url string")
    asked = spark.createDataFrame([(1, 1, 1, "s", "A", "x")], "course_id int, idx int, no long, stem string, correspond string, answer string")
    model = review.course_model(cards, refs, appears, nav, asked)
    assert sorted((r.course_id or 0, r.key, r.name, r.multi_item or False, r.original, r["first"].idx, r["first"].section_order) for r in model.concepts.collect()) == [
        (0, "b", "b", False, "", 3, review.NO_SECTION), (1, "a", "a", True, "x", 1, 2), (1, "c", "c", False, "", None, review.NO_SECTION)]
    items = spark.createDataFrame([(1, "Kurs", 1, "One", "a.md")], "course_id int, course_title string, idx int, title string, note string")
    marks = spark.createDataFrame([(1, "c", True)], "course_id int, key string, mastered boolean")
    got = lines(review.quiz_document(model, items, marks), 1)
    assert "### a（x）" in got and "[▶ 回看 00:10](u) · [笔记](a.md)" in got
    assert "values" not in vars(model)
    for table in (model.appearances, model.questions):
        assert table.inputFiles() and all(f.endswith(".parquet") for f in table.inputFiles())
    assert sorted((r.kind, r.vkey, r.n) for r in model.values.filter("course_id = 1 AND key = 'a'").collect()) == [
        ("definition", "d", 1), ("definition", "e", 1), ("depends", "b", 1), ("original", "X", 1), ("original", "x", 1)]
