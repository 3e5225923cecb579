"""Course review: one concept model per course, stored once, and the documents rendered from it.

The model is four tables (`CourseModel`), each written once and read by checks, queue and
documents, so that every input is scanned once. A course, a concept or a document is never one
cell: definitions, references, appearances and lines stay rows. A document is a union of line
blocks with a common sort key; :func:`lectern.functions.ordered.number_lines` sorts it over the
cluster and numbers its lines.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lectern.functions import text as tx
from lectern.functions.ordered import number_lines, row_numbers
from lectern.functions.udfs import case_fold
from lectern.operators.concepts import CONCEPT, _folded, concept_key
from lectern.session import durable_checkpoint, durable_table

# Sorts cards and entries without a section behind all sections.
NO_SECTION = 2**31 - 1
# Texts of the two documents.
TABLE_USAGE = "> 用法：掌握了就把 `[ ]` 改成 `[x]`，重新生成时会保留；也可以让 Agent “考考我没掌握的概念”。"
QUIZ_USAGE = "> 在 [概念表](概念表.md) 里勾选已掌握的概念，重新生成后这里只把没掌握的放在最前面。"
QUIZ_UNMARKED = "还没有勾选任何概念；在概念表里勾选后，这里会把没掌握的单独列出来。"


@dataclass(frozen=True)
class CourseModel:
    """``concepts``: one row per concept, with ``first`` as its place in the course
    (item, section, card, key). ``values``: distinct definitions, originals and references per
    concept (``kind``, ``vkey``) with first spelling, first place ``o`` and count ``n``.
    ``appearances``: one row per card and section. ``questions``: with concept and replay link."""

    concepts: DataFrame
    valued: Callable[[], DataFrame]
    appearances: DataFrame
    attributed: Callable[[], DataFrame]

    @cached_property
    def values(self) -> DataFrame:
        """Gathered and stored when they are first read; the quiz has none."""
        return self.valued()

    @cached_property
    def questions(self) -> DataFrame:
        """Attributed and stored when they are first read; the concept table has none."""
        return self.attributed()

    def of_kind(self, kind: str) -> DataFrame:
        return self.values.filter(F.col("kind") == kind).drop("kind")


def course_model(cards: DataFrame, refs: DataFrame, appears: DataFrame, nav: DataFrame, questions: DataFrame) -> CourseModel:
    """The model of all courses at once.

    Name and definition come from the first card (item, card); concepts are ordered by first
    appearance (item, section, none last, card). Questions without a concept name belong to none.
    """
    place = ["course_id", "idx", "card_no"]
    keyed = durable_table(concept_key(cards).select(
        *CONCEPT, "idx", "card_no", "name", tx.strip(F.col("definition")).alias("definition"), tx.strip(F.col("original")).alias("original")))
    # only the places of cards meet appearances and index; names and definitions stay with the cards
    # and each of the two joins gives up its shuffles before the next one starts
    placed = durable_table(keyed.select(*CONCEPT, "idx", "card_no").join(appears, place, "left"))
    shown = placed.join(nav, ["course_id", "idx", "section"], "left")
    section = F.coalesce("section", F.lit(NO_SECTION))
    shown = durable_table(shown.withColumn("section_order", section), placed)

    def facts(*names: str) -> DataFrame:
        fact = [F.struct(F.lit(k).alias("kind"), F.col(k).alias("vkey"), F.col(k).alias("value")) for k in names]
        return keyed.select(*CONCEPT, F.inline(F.array(*fact)), F.struct("idx", "card_no", F.lit(0).alias("pos")).alias("o")).filter(
            "kind = 'definition' OR vkey <> ''")

    def gathered(found: DataFrame) -> DataFrame:
        return found.groupBy(*CONCEPT, "kind", "vkey").agg(F.count("*").alias("n"), F.min("o").alias("o"), F.min_by("value", "o").alias("value"))

    def values() -> DataFrame:
        named = concept_key(refs, "ref", "vkey").join(keyed.select(*place, "key").distinct(), place).select(
            *CONCEPT, F.col("field").alias("kind"), "vkey", F.col("ref").alias("value"), F.struct("idx", "card_no", "pos").alias("o"))
        return durable_table(gathered(facts("definition", "original").unionByName(named)))

    card = F.struct("idx", "card_no")
    named = keyed.groupBy(*CONCEPT).agg(
        F.min_by(F.struct("name", "definition", "idx", "card_no"), card).alias("f"), (F.min("idx") != F.max("idx")).alias("multi_item"))
    at = shown.groupBy(*[F.col(c).alias(f"_{c}") for c in CONCEPT]).agg(F.min(F.struct("idx", "section_order")).alias("at"))
    heads = named.join(at, F.expr(" AND ".join(f"{c} <=> _{c}" for c in CONCEPT)))
    chosen = choose_originals(gathered(facts("original")))
    concepts = durable_checkpoint(heads.join(chosen, CONCEPT, "left").select(
        *CONCEPT, "f.name", "f.definition", F.struct("at.idx", "at.section_order", "f.card_no", "key").alias("first"),
        "multi_item", F.coalesce("original", F.lit("")).alias("original"), F.coalesce("groups", F.lit(0)).alias("groups")))
    return CourseModel(concepts, values, shown, lambda: durable_table(_attributed(questions, shown, concepts)))


def choose_originals(originals: DataFrame) -> DataFrame:
    """Representative original per concept: majority group (case and one trailing s ignored), in it
    the majority spelling, the earliest among equals; ``groups`` counts the groups."""
    folded = originals.withColumn("grp", F.regexp_replace(_folded("value", F.lower("value"), case_fold), "s$", ""))
    groups = folded.groupBy(*CONCEPT, "grp").agg(
        F.sum("n").alias("gn"), F.min("o").alias("go"), F.min_by("value", F.struct((-F.col("n")).alias("n"), "o")).alias("value"))
    return groups.groupBy(*CONCEPT).agg(
        F.min_by("value", F.struct((-F.col("gn")).alias("n"), "go")).alias("original"), F.count("*").alias("groups"))


def _attributed(questions: DataFrame, shown: DataFrame, concepts: DataFrame) -> DataFrame:
    """Questions without a concept name never reach the join, so they are no hot key of it."""
    keyed = concept_key(questions.withColumn("_c", F.coalesce("correspond", F.lit(""))), "_c", "_k").drop("_c")
    order = F.struct("section_order", "card_no", "pos")
    link = shown.groupBy("course_id", F.col("key").alias("_k"), "idx").agg(F.min_by(F.struct("time", "url"), order).alias("_a"))
    known = concepts.select("course_id", F.col("key").alias("_k"), F.col("key").alias("concept"))
    found = keyed.filter("_k <> ''").join(known, ["course_id", "_k"], "left").join(link, ["course_id", "_k", "idx"], "left")
    timed = F.coalesce("_a.time", F.lit("")) != ""
    rows = found.withColumns({"time": F.when(timed, F.col("_a.time")), "url": F.when(timed, F.col("_a.url"))}).drop("_a")
    null = F.lit(None).cast("string")
    return rows.unionByName(keyed.filter("_k = ''").withColumns({"concept": null, "time": null, "url": null})).drop("_k")


def model_checks(model: CourseModel, items: DataFrame) -> DataFrame:
    """Findings of the course model ``(course_id, check, severity, idx, concept, message)``.

    ``items(idx, parse_error, note_exists, stale)`` describes the notes.
    """
    concepts = model.concepts
    heads = concepts.select(*CONCEPT, "name", "first")
    held = model.of_kind("original").withColumn("folded", _folded("value", F.lower("value"), case_fold)).select(
        *CONCEPT, "folded").distinct().join(heads, CONCEPT)
    holder = held.groupBy("course_id", "folded").agg(F.min("first").alias("holder"))
    same = held.join(holder, ["course_id", "folded"]).filter("first <> holder")
    # only the names of a confusable reference, before its explanation, are looked up
    parts = F.when(F.col("kind") == "confusable", F.split(F.element_at(F.split("value", "——|--"), 1), "[、,，;；]")).otherwise(F.array("value"))
    names = model.values.filter("kind IN ('depends', 'confusable')").select(*CONCEPT, "kind", F.explode(parts).alias("_n"))
    names = concept_key(names.withColumn("_n", tx.strip(F.col("_n"))).filter("_n <> ''"), "_n", "_nk")
    unknown = names.join(concepts.select("course_id", F.col("key").alias("_nk")), ["course_id", "_nk"], "left_anti").join(heads, CONCEPT)
    jumps = model.appearances.filter("coalesce(time, '') = '' OR coalesce(url, '') = ''").join(heads, CONCEPT)

    def row(df, check, severity, idx, concept, message):
        return df.select("course_id", F.lit(check).alias("check"), F.lit(severity).alias("severity"),
                         idx.cast("int").alias("idx"), concept.alias("concept"), message.alias("message"))

    null, first = F.lit(None).cast("string"), F.col("first.idx")
    def wrong_item(check, idx, message):
        return F.struct(F.lit(check).alias("check"), F.lit("error").alias("severity"), idx.cast("int").alias("idx"), null.alias("concept"), message.alias("message"))

    wrong = items.select("course_id", F.inline(F.filter(F.array(
        F.when(F.col("parse_error") != "", wrong_item("CR-PARSE", F.col("idx"), F.col("parse_error"))),
        F.when(~F.col("note_exists"), wrong_item("CR-LINK", F.col("idx"), F.lit("note missing"))),
        F.when(F.col("stale"), wrong_item("CR-STALE", F.lit(None), F.lit("review is stale")))), lambda x: x.isNotNull())))
    # a course is stale once, however many of its items are
    found = wrong.groupBy("course_id", "check", "severity", "idx", "concept", "message").agg(F.count("*").alias("_n")).withColumn(
        "_n", F.explode(F.sequence(F.lit(1), F.when(F.col("check") == "CR-STALE", 1).otherwise(F.col("_n"))))).drop("_n")
    return reduce(DataFrame.unionByName, [
        found,
        row(jumps, "CR-JUMP", "warning", F.col("idx"), F.col("name"), F.coalesce(F.col("section").cast("string"), F.lit("-"))),
        row(concepts.filter("groups > 1"), "CR-ORIG", "warning", first, F.col("name"), F.col("groups").cast("string")),
        row(same, "CR-SAME", "warning", first, F.col("name"), F.col("folded")),
        row(unknown, "CR-DEP", "warning", first, F.col("name"), F.concat("kind", F.lit(": "), "_n")),
        row(model.questions.filter("concept IS NULL"), "CR-QUIZ", "warning", F.col("idx"), F.col("correspond"), F.col("no").cast("string")),
    ])


def _order(part: int, c: Column | None, block: int, a: Column | int = 0, b: Column | int = 0, d: Column | int = 0, text: Column | str = "") -> Column:
    """Sort key of a line: part of the document, place of its concept, block in it, order in the block."""
    def at(name, kind):
        return (c.getField(name) if c is not None else F.lit(None)).cast(kind).alias(name)

    def number(x, name):
        return (x if isinstance(x, Column) else F.lit(x)).cast("bigint").alias(name)

    return F.struct(F.lit(part).alias("part"), at("idx", "bigint"), at("section_order", "bigint"), at("card_no", "bigint"), at("key", "string"),
                    F.lit(block).alias("block"), number(a, "a"), number(b, "b"), number(d, "d"),
                    (text if isinstance(text, Column) else F.lit(text)).alias("text")).alias("o")


def _line(df: DataFrame, order: Column, *parts: Column | str) -> DataFrame:
    whole = F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    return df.select("course_id", order, whole.alias("line"))


def _at_item(idx: Column) -> Column:
    """Place before all concepts of an item."""
    return F.struct(idx.cast("bigint").alias("idx"), F.lit(-1).alias("section_order"), F.lit(0).alias("card_no"), F.lit("").alias("key"))


def _t(c: str) -> Column:
    return tx.cell_text(F.col(c))


def _s(c: str) -> Column:
    return F.col(c).cast("string")


def _label() -> Column:
    return F.concat(_t("name"), F.lit("**"), F.when(F.col("original") != "", F.concat(F.lit("（"), _t("original"), F.lit("）"))).otherwise(""))


def _course_counts(model: CourseModel, items: DataFrame, marks: DataFrame) -> DataFrame:
    """One row per course with a finished note: title, notes, concepts, mastered, questions and those not mastered."""
    notes = items.groupBy("course_id").agg(F.max("course_title").alias("course_title"), F.count("*").alias("notes"))
    done = marks.filter("mastered").select(*CONCEPT).distinct().withColumn("done", F.lit(1))
    concepts = model.concepts.join(done, CONCEPT, "left").groupBy("course_id").agg(
        F.count("*").alias("concepts"), F.count_if("multi_item").alias("multi"), F.count("done").alias("mastered"))
    asked = model.questions.join(done.withColumnRenamed("key", "concept"), ["course_id", "concept"], "left").groupBy("course_id").agg(
        F.count("*").alias("questions"), F.count_if(F.expr("concept IS NOT NULL AND done IS NULL")).alias("focus"))
    return notes.join(concepts, "course_id", "left").join(asked, "course_id", "left").na.fill(0)


def concept_document(model: CourseModel, items: DataFrame, marks: DataFrame, updated: str) -> DataFrame:
    """The concept table of every course as numbered lines ``(course_id, line_no, line)``.

    ``items(course_id, course_title, idx, title, note)`` are the items with a finished note;
    ``marks(course_id, key, mastered)``. References and questions of a concept are one line each.
    """
    counts = _course_counts(model, items, marks)
    done = marks.filter("mastered").select(*CONCEPT).distinct().withColumn("box", F.lit("x"))
    heads = durable_checkpoint(model.concepts.join(done, CONCEPT, "left"))
    place = heads.select(*CONCEPT, "first")
    c = F.col("first")
    titles = items.select("course_id", "idx", "title", "note")
    summary = (F.lit("> 课程："), _t("course_title"), F.lit("｜概念 "), _s("concepts"), F.lit(" 个（跨集出现 "), _s("multi"), F.lit(" 个）｜已掌握 "),
               _s("mastered"), F.lit(" / "), _s("concepts"), F.lit("｜来自 "), _s("notes"), F.lit(" 篇已完成的笔记｜更新于 "), F.lit(updated))
    groups = heads.select("course_id", F.col("first.idx").alias("idx")).distinct().join(titles, ["course_id", "idx"], "left")
    shown = model.appearances.join(place, CONCEPT).join(titles, ["course_id", "idx"], "left")
    where = F.concat(F.lit("第 "), _s("idx"), F.lit(" 集"), F.when(F.col("section").isNotNull(), F.concat(
        F.lit(" 第 "), _s("section"), F.lit(" 节「"), _t("section_name"), F.lit("」"))).otherwise(""))
    timed, linked = F.coalesce("time", F.lit("")) != "", F.coalesce("url", F.lit("")) != ""
    jump = (F.when(timed & linked, F.concat(F.lit("[▶ "), _t("time"), F.lit("]("), F.col("url"), F.lit(")")))
            .when(timed, F.concat(F.lit("["), _t("time"), F.lit("]"))).otherwise("（无时间点）"))
    definitions = model.of_kind("definition")
    opening = definitions.groupBy(*CONCEPT).agg(F.min("o").alias("opening"))
    others = definitions.filter("vkey <> ''").join(opening, CONCEPT).filter("o <> opening").join(place, CONCEPT)
    listed = model.values.filter("kind IN ('depends', 'confusable')").groupBy(*CONCEPT, "kind").agg(
        F.concat_ws("、", F.expr("transform(array_sort(collect_list(struct(o, value))), x -> x.value)")).alias("names"))
    # names are escaped one by one before they are joined, which changes nothing in between
    by_kind = listed.groupBy(*CONCEPT).agg(*[F.max(F.when(F.col("kind") == k, F.concat(F.lit(f"{label}："), _t("names")))).alias(k)
                                             for k, label in (("depends", "依赖"), ("confusable", "易混"))]).join(place, CONCEPT)
    source = F.concat(F.lit("第 "), _s("idx"), F.lit(" 集第 "), _s("no"), F.lit(" 题"))
    asked = model.questions.filter("concept IS NOT NULL").groupBy("course_id", F.col("concept").alias("key")).agg(
        F.array_sort(F.collect_list(F.struct("idx", "no", "stem", source.alias("line")))).alias("qs")).join(place, CONCEPT)
    return number_lines([
        _line(counts, _order(0, None, 0), *summary),
        _line(counts, _order(0, None, 1), TABLE_USAGE),
        _line(counts, _order(0, None, 2), ""),
        _line(groups, _order(1, _at_item(F.col("idx")), 0), F.lit("## 第 "), _s("idx"), F.lit(" 集 · "), _t("title")),
        _line(groups, _order(1, _at_item(F.col("idx")), 1), ""),
        _line(heads, _order(1, c, 0), F.lit("+ ["), F.coalesce("box", F.lit(" ")), F.lit("] **"), _label()),
        _line(heads, _order(1, c, 1), F.lit("  + 定义："), _t("definition")),
        _line(heads, _order(1, c, 2), "  + 出现："),
        _line(shown, _order(1, c, 3, F.col("idx"), F.col("section_order"), F.col("card_no"), F.lpad(F.coalesce(_s("pos"), F.lit("")), 10, "0")),
              F.lit("    + "), where, F.lit("：[笔记]("), tx.link_path(F.col("note")), F.lit(") · "), jump),
        _line(others.select("course_id", "first").distinct(), _order(1, c, 4), "  + 其它集的说法："),
        _line(others, _order(1, c, 5, F.col("o.idx"), F.col("o.card_no"), 0, F.col("vkey")), F.lit("    + 第 "), F.col("o.idx").cast("string"), F.lit(" 集："), _t("value")),
        _line(by_kind, _order(1, c, 6), F.lit("  + "), F.concat_ws("｜", "depends", "confusable")),
        _line(asked, _order(1, c, 7), F.lit("  + 自测："), F.array_join(F.transform("qs", lambda q: q.getField("line")), "、")),
        _line(heads, _order(1, c, 8), ""),
    ], "course_id")


def _question_lines(rows: DataFrame, order, suffix: Column) -> DataFrame:
    """The lines of each question; an answer of several lines gives several."""
    link = F.when((F.coalesce("time", F.lit("")) != "") & (F.coalesce("url", F.lit("")) != ""),
                  F.concat(F.lit("[▶ 回看 "), _t("time"), F.lit("]("), F.col("url"), F.lit(") · "))).otherwise("")
    head = F.concat(_s("number"), F.lit(". "), _t("stem"), F.lit("（"), suffix, F.lit("）"))
    answer = F.split(F.concat(F.lit("**答案：** "), F.coalesce("answer", F.lit(""))), "\n", -1)
    back = F.concat(link, F.lit("[笔记]("), tx.link_path(F.col("note")), F.lit(")"))
    blank = F.array(F.lit(""))
    lines = rows.select("*", F.posexplode(F.concat(F.array(head), blank, answer, blank, F.array(back), blank)).alias("sub", "line"))
    return lines.select("course_id", order(F.col("sub")), "line")


def quiz_document(model: CourseModel, items: DataFrame, marks: DataFrame) -> DataFrame:
    """The quiz of every course as numbered lines ``(course_id, line_no, line)``.

    Questions of unmastered concepts come first if anything is mastered, numbered per concept;
    then all questions by item, numbered per item.
    """
    counts = durable_checkpoint(_course_counts(model, items, marks))
    done = marks.filter("mastered").select(*CONCEPT).distinct()
    titles = items.select("course_id", "idx", "title", "note")
    questions = model.questions.join(titles, ["course_id", "idx"], "left").withColumn("_o", F.struct("idx", "no", "stem"))
    every = durable_table(row_numbers(questions, ["course_id", "idx"], "_o", "number", F.col("idx").cast("bigint")))
    started = counts.filter("mastered > 0")
    pending = model.concepts.join(done, CONCEPT, "left_anti").join(started.select("course_id"), "course_id", "left_semi").select(
        "course_id", F.col("key").alias("concept"), "first", "name", "original")
    focus = durable_table(row_numbers(every.drop("number").filter("concept IS NOT NULL").join(pending, ["course_id", "concept"]),
                                      ["course_id", "concept"], "_o", "number", F.col("idx").cast("bigint")))
    source = F.concat(F.lit("第 "), _s("idx"), F.lit(" 集第 "), _s("no"), F.lit(" 题"))
    named = focus.filter("number = 1")
    asked = every.select("course_id", "idx", "title").distinct()
    c, item = F.col("first"), _at_item(F.col("idx"))
    label = F.concat(_t("name"), F.when(F.col("original") != "", F.concat(F.lit("（"), _t("original"), F.lit("）"))).otherwise(""))
    summary = (F.lit("> 课程："), _t("course_title"), F.lit("｜共 "), _s("questions"), F.lit(" 题，来自 "), _s("notes"), F.lit(" 篇笔记｜没掌握的概念涉及 "),
               _s("focus"), F.lit(" 题｜答案不折叠，先遮住答案再自测"))
    opening = F.when(F.col("mastered") > 0, F.concat(F.lit("## 先复习：还没掌握的概念（"), _s("focus"), F.lit(" 题）"))).otherwise(QUIZ_UNMARKED)
    return number_lines([
        _line(counts, _order(0, None, 0), *summary),
        _line(counts, _order(0, None, 1), QUIZ_USAGE),
        _line(counts, _order(0, None, 2), ""),
        _line(counts, _order(0, None, 3), opening),
        _line(counts, _order(0, None, 4), ""),
        _line(named, _order(1, c, 0), F.lit("### "), label),
        _line(named, _order(1, c, 1), ""),
        _question_lines(focus, lambda sub: _order(1, c, 2, F.col("number"), sub), source),
        _line(counts, _order(2, None, 0), "## 全部题目（按集）"),
        _line(counts, _order(2, None, 1), ""),
        _line(asked, _order(3, item, 0), F.lit("### 第 "), _s("idx"), F.lit(" 集 · "), _t("title")),
        _line(asked, _order(3, item, 1), ""),
        _question_lines(every, lambda sub: _order(3, item, 2, F.col("number"), sub),
                        F.concat(F.lit("对应："), _t("correspond"), F.lit("；"), source)),
    ], "course_id")


def model_queue(model: CourseModel, marks: DataFrame, limit: int = 50) -> DataFrame:
    """The first ``limit`` unmastered concepts of each course in course order, with their questions.

    One row per concept and question (one without question for a concept that has none);
    ``truncated`` tells that the course has more.
    """
    pending = model.concepts.join(marks.filter("mastered").select(*CONCEPT), CONCEPT, "left_anti")
    top = pending.withColumn("pos", F.row_number().over(W.partitionBy("course_id").orderBy("first"))).filter(F.col("pos") <= limit)
    total = pending.groupBy("course_id").agg((F.count("*") > limit).alias("truncated"))
    asked = model.questions.select("course_id", F.col("concept").alias("key"), "idx", "no", "stem", "answer", "url")
    return top.join(total, "course_id").join(asked, CONCEPT, "left").select(
        "course_id", "pos", "name", "original", "definition", "truncated", "idx", "no", "stem", "answer", "url")


def model_summary(model: CourseModel, items: DataFrame, marks: DataFrame) -> DataFrame:
    """Receipt per course: concepts, multi-item concepts, questions, mastered, unmastered, jump rate."""
    linked = F.count_if(F.expr("coalesce(time, '') <> '' AND coalesce(url, '') <> ''"))
    jumps = model.appearances.groupBy("course_id").agg((linked / F.count("*")).alias("jump_rate"))
    return _course_counts(model, items, marks).join(jumps, "course_id", "left").select(
        "course_id", "concepts", F.col("multi").alias("multi_episode"), "questions", "mastered",
        (F.col("concepts") - F.col("mastered")).alias("unmastered"), F.coalesce("jump_rate", F.lit(0.0)).alias("jump_rate"))
