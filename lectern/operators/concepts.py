"""Course-wide concept model from the cards, questions and indexes of finished notes.

Inputs, all keyed by ``course_id``:
``cards(idx, card_no, name, definition, original)``, ``refs(idx, card_no, field, pos, ref)``,
``appears(idx, card_no, pos, section, section_name)``, ``nav(idx, section, time, url)``,
``questions(idx, no, stem, correspond, answer)``. ``(idx, card_no)`` is the course order.

A popular concept may be on most cards, so nothing here gathers a concept into one row with
lists; definitions, references and appearances stay rows, and "first" and "most frequent"
are aggregates that combine before the shuffle. `lectern.operators.review` builds all of it as one
stored model, with the checks, the queue and the documents of a course.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lectern.functions import text as tx
from lectern.functions.udfs import case_fold, fold_name
from lectern.session import durable_checkpoint

CONCEPT = ["course_id", "key"]


def _folded(column: str, plain: Column, udf) -> Column:
    """``plain`` for ASCII values; only other values reach the Arrow function."""
    ascii_only = F.col(column).rlike(r"^[\x00-\x7f]*$")
    return F.when(ascii_only, plain).otherwise(udf(F.when(~ascii_only, F.col(column))))


def concept_key(df: DataFrame, column: str = "name", out: str = "key") -> DataFrame:
    """Add the identity of a concept name: NFKC, no white space, case folded."""
    plain = F.lower(F.regexp_replace(column, r"[\s\x1c-\x1f]+", ""))
    return df.withColumn(out, _folded(column, plain, fold_name))


def _order() -> Column:
    return F.struct("idx", "card_no")


def merge_concepts(cards: DataFrame) -> DataFrame:
    """One row per concept: name and definition of its first card, with item and card counts."""
    rows = concept_key(cards)
    return rows.groupBy(*CONCEPT).agg(
        F.min_by(F.struct("name", tx.strip(F.col("definition")).alias("definition"), "idx", "card_no"), _order()).alias("f"),
        F.count("*").alias("cards"),
        F.max("idx").alias("_last"), F.min("idx").alias("_first"),
    ).select(*CONCEPT, "f.name", "f.definition", F.col("f.idx").alias("first_idx"), F.col("f.card_no").alias("first_card"),
             "cards", (F.col("_last") != F.col("_first")).alias("multi_item"))


def concept_definitions(cards: DataFrame) -> DataFrame:
    """Other distinct definitions of a concept with the first item that gives each."""
    rows = concept_key(cards).withColumn("definition", tx.strip(F.col("definition")))
    each = rows.groupBy(*CONCEPT, "definition").agg(F.min(_order()).alias("o"))
    first = each.groupBy(*CONCEPT).agg(F.min("o").alias("first"))
    return each.join(first, CONCEPT).filter((F.col("definition") != "") & (F.col("o") != F.col("first"))).select(
        *CONCEPT, "definition", F.col("o.idx").alias("idx"))


def concept_references(cards: DataFrame, refs: DataFrame) -> DataFrame:
    """Distinct ``depends`` / ``confusable`` references per concept, in their first spelling."""
    owners = concept_key(cards).select("course_id", "idx", "card_no", "key").distinct()
    rows = concept_key(refs.join(owners, ["course_id", "idx", "card_no"]), "ref", "ref_key")
    return rows.groupBy(*CONCEPT, "field", "ref_key").agg(
        F.min_by("ref", F.struct("idx", "card_no", "pos")).alias("ref"))


def _originals(cards: DataFrame) -> DataFrame:
    rows = concept_key(cards).withColumn("value", tx.strip(F.col("original"))).filter("value <> ''")
    each = rows.groupBy(*CONCEPT, "value").agg(F.count("*").alias("n"), F.min(_order()).alias("o"))
    folded = each.withColumn("folded", _folded("value", F.lower("value"), case_fold))
    return folded.withColumn("grp", F.regexp_replace("folded", "s$", ""))


def choose_original(cards: DataFrame) -> DataFrame:
    """Original term per concept: majority group (one trailing s ignored), then majority
    spelling in it; the earliest wins ties."""
    each = _originals(cards)
    groups = each.groupBy(*CONCEPT, "grp").agg(
        F.sum("n").alias("gn"), F.min("o").alias("go"),
        F.min_by("value", F.struct((-F.col("n")).alias("n"), "o")).alias("value"))
    best = F.min_by("value", F.struct((-F.col("gn")).alias("n"), "go"))
    return groups.groupBy(*CONCEPT).agg(best.alias("original"), F.count("*").alias("groups"))


def concept_appearances(cards: DataFrame, appears: DataFrame, nav: DataFrame) -> DataFrame:
    """One row per card and section with time and link; cards without any keep a NULL section."""
    rows = concept_key(cards).select(*CONCEPT, "idx", "card_no")
    rows = rows.join(appears, ["course_id", "idx", "card_no"], "left")
    return rows.join(nav, ["course_id", "idx", "section"], "left").select(
        *CONCEPT, "idx", "card_no", "pos", "section", "section_name", "time", "url")


def attribute_questions(questions: DataFrame, appearances: DataFrame) -> DataFrame:
    """Questions with their concept and the replay link of its first appearance in the same item."""
    keyed = concept_key(questions.withColumn("_c", F.coalesce("correspond", F.lit(""))), "_c", "_k").drop("_c")
    order = F.struct(F.col("section").isNull(), "section", "card_no", "pos")
    first = appearances.groupBy("course_id", F.col("key").alias("_k"), "idx").agg(
        F.min_by(F.struct("time", "url"), order).alias("a"))
    known = appearances.select("course_id", F.col("key").alias("_k")).distinct().withColumn("_known", F.lit(True))
    rows = keyed.join(known, ["course_id", "_k"], "left").join(first, ["course_id", "_k", "idx"], "left")
    timed = F.coalesce(F.col("a.time"), F.lit("")) != ""
    return rows.select(
        "course_id", "idx", "no", "stem", "correspond", "answer",
        F.when(F.col("_known"), F.col("_k")).alias("concept"),
        F.when(timed, F.col("a.time")).alias("time"), F.when(timed, F.col("a.url")).alias("url"))


def blocks_publication(findings: DataFrame) -> DataFrame:
    """Courses whose review documents must not be written."""
    return findings.filter(F.col("check").isin("CR-PARSE", "CR-LINK")).select("course_id").distinct()


def source_digest(items: DataFrame) -> DataFrame:
    """Content digest per course from ``items(idx, note, title, sha)`` and the course title.

    Row hashes are added up in four 60-bit lanes, so the digest needs no ordered list and
    combines before the shuffle; any changed, added or removed item changes it.
    """
    line = F.sha2(F.concat_ws("\u0001", F.col("idx").cast("string"), "note", "title", "sha"), 256)
    rows = items.select("course_id", "course_title", line.alias("h"))
    lanes = [F.sum(F.conv(F.substring("h", 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)")).alias(f"l{i}") for i in range(4)]
    agg = rows.groupBy("course_id").agg(F.max("course_title").alias("t"), F.count("*").alias("n"), *lanes)
    return agg.select("course_id", F.sha2(F.concat_ws("|", "t", F.col("n").cast("string"), *[F.col(f"l{i}").cast("string") for i in range(4)]), 256).alias("digest"))


def merge_mastery(concepts: DataFrame, backup: DataFrame, table: DataFrame, commands: DataFrame, now: str) -> DataFrame:
    """New mastery rows: stored state, overridden by the edited table, then by commands.

    ``backup(course_id, key, name, mastered, changed_at)``, ``table(course_id, key, mastered)``,
    ``commands(course_id, key, mastered, ord)``. Vanished concepts keep their row; the time
    moves only when the state does.
    """
    last = commands.groupBy(*CONCEPT).agg(F.max_by("mastered", "ord").alias("cmd")).join(concepts.select(*CONCEPT), CONCEPT, "left_semi")
    ticks = table.groupBy(*CONCEPT).agg(F.bool_or("mastered").alias("tick"))
    rows = (
        concepts.select(*CONCEPT, F.col("name").alias("cname"))
        .join(backup, CONCEPT, "full").join(ticks, CONCEPT, "full").join(last, CONCEPT, "left")
    )
    state = F.coalesce("cmd", "tick", "mastered", F.lit(False))
    same = F.col("mastered").isNotNull() & (F.col("mastered") == state)
    return rows.select(*CONCEPT, F.coalesce("cname", "name", "key").alias("name"), state.alias("mastered"),
                       F.when(same, F.col("changed_at")).otherwise(F.lit(now).cast("timestamp")).alias("changed_at"))


def unknown_commands(concepts: DataFrame, commands: DataFrame) -> DataFrame:
    """Commands for names the course does not have, with the three closest concept keys."""
    lost = commands.join(concepts.select(*CONCEPT), CONCEPT, "left_anti").select("course_id", F.col("key").alias("asked")).distinct()
    return closest_keys(lost, concepts.select(*CONCEPT))


def _bigrams(df: DataFrame, text: str) -> DataFrame:
    """Pairs of neighbouring characters of a name, its ends included, the second equal one told apart from the first."""
    chars = F.concat(F.array(F.lit("\u0001")), F.split(text, ""), F.array(F.lit("\u0002")))
    pairs = F.expr("transform(sequence(0, size(ch) - 2), i -> concat(ch[i], ch[i + 1]))")
    told = F.expr("transform(g, (x, i) -> named_struct('gram', x, 'no', size(filter(slice(g, 1, i), y -> y = x))))")
    rows = df.withColumn("ch", chars).withColumn("g", pairs).withColumn("g", F.explode(told))
    return rows.select(*df.columns, "g.gram", "g.no")


def closest_keys(asked: DataFrame, keys: DataFrame, n: int = 3) -> DataFrame:
    """The ``n`` keys of the course nearest to each asked name by edit distance, then by key; exact.

    The radius grows until a name has ``n`` keys within it, which then are its nearest. Names within
    a radius differ by so many pairs of characters at most, so at least one of the rarest pairs of
    the asked name is a pair of the key: only keys with such a pair and a fitting length are
    compared. Names too short for that at a radius meet the keys of the fitting lengths.
    """
    keys = durable_checkpoint(keys.filter("key <> ''").select("course_id", "key").distinct().withColumn("size", F.length("key")))
    grams = durable_checkpoint(_bigrams(keys, "key"))
    rarity = grams.groupBy("course_id", "gram", "no").agg(F.count("*").alias("freq"))
    by_rarity = W.partitionBy("course_id", "asked").orderBy(F.coalesce("freq", F.lit(0)), "gram", "no")
    probes = _bigrams(asked.select("course_id", "asked").distinct().withColumn("length", F.length("asked")), "asked")
    probes = durable_checkpoint(probes.join(rarity, ["course_id", "gram", "no"], "left").withColumn(
        "place", F.row_number().over(by_rarity)))
    waiting = probes.filter("place = 1").select("course_id", "asked", "length")
    longest = keys.agg(F.max("size")).first()[0] or 0
    longest = max(longest, waiting.agg(F.max("length")).first()[0] or 0)
    found, radius = [], 1
    while True:
        # a name of so many characters has one pair more; each edit changes two of them
        by_pairs = probes.join(waiting.select("course_id", "asked"), ["course_id", "asked"], "left_semi").filter(
            (F.col("length") + 1 > 2 * radius) & (F.col("place") <= 2 * radius + 1))
        near = by_pairs.join(grams, ["course_id", "gram", "no"]).filter(F.abs(F.col("size") - F.col("length")) <= radius)
        sizes = F.explode(F.sequence(F.greatest(F.lit(1), F.col("length") - radius), F.col("length") + radius)).alias("size")
        short = waiting.filter(F.col("length") + 1 <= 2 * radius).select("course_id", "asked", sizes).join(keys, ["course_id", "size"])
        pairs = near.select("course_id", "asked", "key").distinct().unionByName(short.select("course_id", "asked", "key"))
        close = pairs.withColumn("d", F.levenshtein("asked", "key", radius)).filter("d >= 0")
        ranked = close.withColumn("rank", F.row_number().over(W.partitionBy("course_id", "asked").orderBy("d", "key"))).filter(F.col("rank") <= n)
        ranked = durable_checkpoint(ranked)
        done = ranked.groupBy("course_id", "asked").agg(F.count("*").alias("c")).filter((F.col("c") >= n) | F.lit(radius >= longest))
        found.append(ranked.join(done.select("course_id", "asked"), ["course_id", "asked"], "left_semi"))
        if radius >= longest:
            break
        waiting = durable_checkpoint(waiting.join(done.select("course_id", "asked"), ["course_id", "asked"], "left_anti"))
        if waiting.isEmpty():
            break
        radius = min(2 * radius, longest)
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.select("course_id", "asked", "rank", "key")


MARK = r"^\+ \[( |x|X)\] \*\*(.+?)\*\*"


def read_marks(lines: DataFrame) -> DataFrame:
    """Tick lines of concept tables ``(course_id, line)`` to ``(course_id, key, mastered)``."""
    rows = lines.filter(F.col("line").rlike(MARK)).select(
        "course_id", F.col("line_no"),
        F.regexp_replace(F.regexp_extract("line", MARK, 2), r"\\([\\|])", "$1").alias("name"),
        (F.lower(F.regexp_extract("line", MARK, 1)) == "x").alias("mastered"))
    return concept_key(rows).groupBy(*CONCEPT).agg(F.max_by("mastered", "line_no").alias("mastered"))


def refused_tables(lines: DataFrame) -> DataFrame:
    """Courses whose table has text but neither a tick line nor the shape of an empty table."""
    empty_head = r"^> 课程：.*｜概念 0 个（跨集出现 0 个）｜已掌握 0 / 0｜来自 \d+ 篇已完成的笔记｜更新于 .+$"
    per = lines.filter("line <> ''").groupBy("course_id").agg(
        F.count("*").alias("n"), F.count_if(F.col("line").rlike(MARK)).alias("ticks"),
        F.count_if(F.col("line").rlike(empty_head)).alias("heads"), F.count_if(F.startswith("line", F.lit("> 用法：掌握了就"))).alias("usage"))
    return per.filter("ticks = 0 AND NOT (n = 2 AND heads = 1 AND usage = 1)").select("course_id")


def concept_table_lines(concepts: DataFrame, originals: DataFrame, definitions: DataFrame, references: DataFrame,
                        appearances: DataFrame, marks: DataFrame) -> DataFrame:
    """Lines of the concept table, with the sort key ``(course_id, idx, card, part, a, b)``.

    A course document can be far larger than a row, so lines stay rows; the writer sorts and
    writes them.
    """
    head = concepts.join(originals.select(*CONCEPT, "original"), CONCEPT, "left").join(
        marks.filter("mastered").select(*CONCEPT, F.lit("x").alias("box")), CONCEPT, "left")
    place = concepts.select(*CONCEPT, F.col("first_idx").alias("oidx"), F.col("first_card").alias("ocard"))
    suffix = F.when(F.coalesce("original", F.lit("")) != "", F.concat(F.lit("（"), tx.escape_cell(F.col("original")), F.lit("）"))).otherwise("")
    jump = (F.when((F.coalesce("time", F.lit("")) != "") & (F.coalesce("url", F.lit("")) != ""), F.concat(F.lit("[▶ "), "time", F.lit("]("), "url", F.lit(")")))
            .when(F.coalesce("time", F.lit("")) != "", F.concat(F.lit("["), "time", F.lit("]"))).otherwise("（无时间点）"))
    where = F.concat(F.lit("第 "), F.col("idx").cast("string"), F.lit(" 集"), F.when(F.col("section").isNotNull(), F.concat(
        F.lit(" 第 "), F.col("section").cast("string"), F.lit(" 节「"), tx.escape_cell(F.col("section_name")), F.lit("」"))).otherwise(""))
    label = F.when(F.col("field") == "depends", "依赖").otherwise("易混")

    def part(df, no, a, b, line):
        return df.select("course_id", F.col("oidx").alias("idx"), F.col("ocard").alias("card"), F.lit(no).alias("part"),
                         a.cast("bigint").alias("a"), b.cast("string").alias("b"), line.alias("line"))

    zero, none = F.lit(0), F.lit("")
    h = head.withColumns({"oidx": F.col("first_idx"), "ocard": F.col("first_card")})
    parts = [
        part(h, 1, zero, F.col("key"), F.concat(F.lit("+ ["), F.coalesce("box", F.lit(" ")), F.lit("] **"), tx.escape_cell(F.col("name")), F.lit("**"), suffix)),
        part(h, 2, zero, F.col("key"), F.concat(F.lit("  + 定义："), tx.escape_cell(F.col("definition")))),
        part(appearances.join(place, CONCEPT), 3, F.col("idx"), F.col("section"), F.concat(F.lit("    + "), where, F.lit("："), jump)),
        part(definitions.join(place, CONCEPT), 4, F.col("idx"), F.col("definition"), F.concat(
            F.lit("    + 第 "), F.col("idx").cast("string"), F.lit(" 集："), tx.escape_cell(F.col("definition")))),
        part(references.join(place, CONCEPT), 5, zero, F.col("ref_key"), F.concat(F.lit("  + "), label, F.lit("："), tx.escape_cell(F.col("ref")))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def quiz_document_lines(questions: DataFrame, concepts: DataFrame, marks: DataFrame) -> DataFrame:
    """Lines of the course quiz: unmastered concepts first if anything is mastered, then all by item.

    Question numbers restart per concept in the first part and per item in the second.
    """
    started = marks.filter("mastered").join(concepts.select(*CONCEPT), CONCEPT, "left_semi").select("course_id").distinct()
    pending = concepts.join(marks.filter("mastered").select(*CONCEPT), CONCEPT, "left_anti").join(started, "course_id", "left_semi")
    focus = questions.join(pending.select("course_id", F.col("key").alias("concept"), "first_idx", "first_card"), ["course_id", "concept"])
    by_concept = W.partitionBy("course_id", "concept", "idx").orderBy("no", "stem")
    before = focus.groupBy("course_id", "concept", "idx").agg(F.count("*").alias("_c")).withColumn(
        "_b", F.coalesce(F.sum("_c").over(W.partitionBy("course_id", "concept").orderBy("idx").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    focus = focus.join(before.drop("_c"), ["course_id", "concept", "idx"]).withColumn("number", F.row_number().over(by_concept) + F.col("_b"))
    every = questions.withColumn("number", F.row_number().over(W.partitionBy("course_id", "idx").orderBy("no", "stem")))
    source = F.concat(F.lit("第 "), F.col("idx").cast("string"), F.lit(" 集第 "), F.col("no").cast("string"), F.lit(" 题"))
    head = F.concat(F.col("number").cast("string"), F.lit(". "), tx.escape_cell(F.col("stem")), F.lit("（"))
    cols = ["course_id", "part", "a", "b", "number", "line"]
    first = focus.select("course_id", F.lit(1).alias("part"), F.col("first_idx").cast("bigint").alias("a"), F.col("concept").alias("b"),
                         F.col("number").cast("int").alias("number"), F.concat(head, source, F.lit("）")).alias("line"))
    second = every.select("course_id", F.lit(2).alias("part"), F.col("idx").cast("bigint").alias("a"), F.lit("").alias("b"),
                          F.col("number").cast("int").alias("number"),
                          F.concat(head, F.lit("对应："), tx.escape_cell(F.coalesce("correspond", F.lit(""))), F.lit("；"), source, F.lit("）")).alias("line"))
    return first.unionByName(second).select(*cols)
