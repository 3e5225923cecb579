"""Readers: file layouts of the product to tables.

Each reader is a Spark scan plus a parse function on its raw rows, so the same parsing runs
on files and on tables that already hold the texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lectern.functions import text as tx
from lectern.operators.captions import parse_ts_lines
from lectern.operators.terms import GENERAL_CATEGORY, TECH_CATEGORY, TECH_WORDS, main_word


def _name(path: str = "path") -> Column:
    return F.substring_index(path, "/", -1)


def _folder(path: str = "path") -> Column:
    return F.element_at(F.split(path, "/"), -2)


def _texts(spark: SparkSession, path: str) -> DataFrame:
    """Whole text files as ``(path, text)``."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def transcript_texts(files: DataFrame) -> DataFrame:
    """``(path, text)`` of ``<video>/<page>_<part>.txt`` to ``(video_id, page, part, text)``.

    Files without a leading page number are no transcripts.
    """
    pattern = r"^(\d{1,3})_(.*)\.txt$"
    return files.filter(_name().rlike(pattern)).select(
        _folder().alias("video_id"), F.regexp_extract(_name(), pattern, 1).cast("int").alias("page"),
        F.regexp_extract(_name(), pattern, 2).alias("part"), "text")


def read_transcripts(spark: SparkSession, path: str, grammar: str = "nav") -> DataFrame:
    """Transcript folder to timed lines ``(video_id, page, line_no, ts_sec, text)``."""
    return parse_ts_lines(transcript_texts(_texts(spark, path)), grammar)


METADATA = """video_id STRING, bvid STRING, platform STRING, title STRING, duration DOUBLE, suggested_note_type STRING,
    pages ARRAY<STRUCT<page: INT, part: STRING, cid: BIGINT, duration: INT, subtitle: BOOLEAN, subtitle_detail: STRING,
    subtitle_lang: STRING, audio_lang: STRING, asr_lang: STRING, media_path: STRING>>, _corrupt_record STRING"""


def video_tables(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(path, json)`` metadata documents to ``videos`` and ``video_pages``; broken JSON is a row with ``error``."""
    rows = docs.select("path", F.from_json("json", METADATA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("m"))
    vid = F.coalesce("m.bvid", "m.video_id")
    videos = rows.select("path", vid.alias("video_id"), F.coalesce("m.platform", F.lit("bilibili")).alias("platform"), "m.title", "m.duration",
                         "m.suggested_note_type", F.coalesce("m._corrupt_record", F.lit("")).alias("error"))
    pages = rows.select(vid.alias("video_id"), F.explode("m.pages").alias("p")).select("video_id", "p.*")
    return videos, pages


def read_video_metadata(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return video_tables(_texts(spark, path).withColumnRenamed("text", "json"))


_ENTRY = "STRUCT<correct: STRING, hits: INT, source: STRING, disabled: BOOLEAN>"


def glossary_entries(docs: DataFrame) -> DataFrame:
    """Glossary files ``(layer, path, text)`` to the long glossary table.

    JSON with areas and categories, flat JSON (with or without ``map``), or Markdown lines
    ``wrong(right)`` and ``wrong → right``. Keys and categories that open with ``_`` are
    remarks; entries without a correct word are dropped.
    """
    is_json = F.lower(_name()).rlike(r"\.json$")
    v2 = is_json & (F.get_json_object("text", "$.categories").isNotNull() | (F.get_json_object("text", "$.schema_version") == "2"))
    areas = docs.filter(v2).select("layer", F.explode(F.array(*[
        F.struct(F.lit(a).alias("area"), F.from_json(F.get_json_object("text", f"$.{a}"), "map<string,string>").alias("m")) for a in ("categories", "candidates")
    ])).alias("a")).select("layer", "a.area", F.posexplode("a.m").alias("ci", "category", "cat"))
    areas = areas.filter(~F.startswith("category", F.lit("_"))).select(
        "layer", "area", "ci", "category", F.posexplode(F.from_json("cat", "map<string,string>")).alias("wi", "wrong", "raw"))
    areas = areas.filter(~F.startswith("wrong", F.lit("_")))
    obj = F.startswith(F.ltrim("raw"), F.lit("{"))
    entry = F.from_json("raw", _ENTRY)
    long = areas.select(
        "layer", "area", "category", "wrong",
        F.when(obj, entry.getField("correct")).otherwise(F.col("raw")).alias("correct"),
        F.greatest(F.lit(0), F.coalesce(F.when(obj, entry.getField("hits")), F.lit(0))).alias("hits"),
        F.coalesce(F.when(obj, entry.getField("source")), F.lit("")).alias("source"),
        F.coalesce(F.when(obj, entry.getField("disabled")), F.lit(False)).alias("disabled"),
        (F.shiftleft(F.col("ci").cast("bigint"), 32) + F.col("wi")).alias("ord"))
    flat = docs.filter(is_json & ~F.coalesce(v2, F.lit(False))).select("layer", F.posexplode(F.from_json(
        F.coalesce(F.get_json_object("text", "$.map"), F.col("text")), "map<string,string>")).alias("i", "wrong", "raw"))
    flat = flat.filter(~F.startswith("wrong", F.lit("_"))).select(
        "layer", "wrong", F.when(obj, entry.getField("correct")).otherwise(F.col("raw")).alias("correct"), F.col("i").cast("bigint").alias("ord"))
    lines = docs.filter(~is_json).select("layer", F.posexplode(tx.lines_of(F.col("text"))).alias("i", "line"))
    line = tx.strip(F.col("line"))
    paren = r"^[-*\d.、\s]*([^\s→（(]+)\s*[（(]([^）)]+)[）)]"
    arrow = r"^[-*\s]*([^\s→]+)\s*→\s*(\S+)"
    md = lines.filter((line != "") & ~line.rlike(r"^[#|]") & (line.rlike(paren) | line.rlike(arrow))).select(
        "layer", F.when(line.rlike(paren), F.regexp_extract(line, paren, 1)).otherwise(F.regexp_extract(line, arrow, 1)).alias("wrong"),
        F.when(line.rlike(paren), F.regexp_extract(line, paren, 2)).otherwise(F.regexp_extract(line, arrow, 2)).alias("correct"),
        F.col("i").cast("bigint").alias("ord"))

    def filed(df: DataFrame, category: Column) -> DataFrame:
        last = df.groupBy("layer", "wrong").agg(F.max_by("correct", "ord").alias("correct"), F.max("ord").alias("ord"))
        return last.select("layer", F.lit("categories").alias("area"), category.alias("category"), "wrong", "correct",
                           F.lit(0).alias("hits"), F.lit("").alias("source"), F.lit(False).alias("disabled"), "ord")

    blob = F.lower(F.concat_ws(" ", "wrong", "correct"))
    tech = F.exists(F.array(*map(F.lit, TECH_WORDS)), lambda w: F.contains(blob, w))
    migrated = filed(flat, F.when(tech, TECH_CATEGORY).otherwise(GENERAL_CATEGORY))
    out = long.unionByName(migrated).unionByName(filed(md, F.lit(GENERAL_CATEGORY)))
    return out.filter(F.coalesce(main_word(F.col("correct")), F.lit("")) != "")


def read_glossary(spark: SparkSession, path: str, layer: int = 0) -> DataFrame:
    return glossary_entries(_texts(spark, path).withColumn("layer", F.lit(layer)))


def note_texts(files: DataFrame) -> DataFrame:
    """``(path, content)`` to ``(path, text, sha, error)``: hash of the raw bytes, BOM removed."""
    valid = F.is_valid_utf8("content")
    text = F.regexp_replace(F.try_validate_utf8(F.col("content").cast("string")), "^﻿", "")
    return files.select("path", F.when(valid, text).alias("text"), F.sha2("content", 256).alias("sha"),
                        F.when(valid, "").otherwise("not UTF-8").alias("error"))


def read_notes(spark: SparkSession, path: str) -> DataFrame:
    return note_texts(spark.read.format("binaryFile").load(path).select("path", "content"))


COURSE = """version INT, kind STRING, source_url STRING, title STRING, probe STRING, template STRING, asr_lang STRING,
    scope STRUCT<mode: STRING, first: INT, `range`: STRING>,
    review STRUCT<source_digest: STRING, concepts: INT, questions: INT>,
    mastery MAP<STRING, STRUCT<name: STRING, mastered: BOOLEAN, changed_at: STRING>>,
    items ARRAY<STRUCT<`index`: INT, bvid: STRING, page: INT, cid: BIGINT, title: STRING, section: STRING, duration: DOUBLE,
        subtitle_hint: STRING, status: STRING, note: STRING, seconds: DOUBLE>>"""


# Known fields of an item in a manifest; any other field is kept by name.
ITEM_FIELDS = """`index` INT, bvid STRING, page INT, cid BIGINT, title STRING, section STRING, duration DOUBLE, subtitle_hint STRING,
    status STRING, note STRING, planned_note STRING, started_at STRING, finished_at STRING, seconds DOUBLE, reason STRING, next_step STRING, rerun STRING,
    gate STRUCT<errors: BIGINT, warnings: BIGINT, sha256: STRING, template: STRING, checked_at: STRING>"""
_STATE = ("status", "subtitle_hint", "note", "planned_note", "started_at", "finished_at", "seconds", "reason", "next_step", "rerun")


def item_states(docs: DataFrame) -> DataFrame:
    """All that manifests ``(course_id, json)`` say of the state of their items, today's and earlier ones.

    ``(course_id, origin, ord, idx, bvid, cid, page, <state>, gate_*, extra)``: ``origin`` is
    ``items`` or ``history``, ``ord`` puts history before items, so that the later state wins.
    Fields that are not known are kept as text in the map ``extra``.
    """
    lists = docs.select("course_id", F.from_json("json", "history ARRAY<STRING>, items ARRAY<STRING>").alias("c"))

    def entries(origin: str, first: int):
        listed = F.coalesce(f"c.{origin}", F.array().cast("array<string>"))
        return F.transform(listed, lambda x, i: F.struct(F.lit(origin).alias("origin"), (i.cast("long") + first).alias("ord"), x.alias("raw")))

    rows = lists.select("course_id", F.inline(F.concat(entries("history", 0), entries("items", 2**32))))
    known = [c.strip().split(" ")[0].strip("`") for c in ITEM_FIELDS.replace("\n", " ").split("STRUCT<")[0].split(",")]
    read = rows.select("course_id", "origin", "ord", F.from_json("raw", ITEM_FIELDS).alias("i"), F.map_filter(
        F.from_json("raw", "map<string,string>"), lambda k, v: ~k.isin(*known)).alias("extra"))
    return read.select("course_id", "origin", "ord", F.col("i.index").alias("idx"), "i.bvid", "i.cid", "i.page", *[f"i.{c}" for c in _STATE],
                       F.col("i.gate.errors").alias("gate_errors"), F.col("i.gate.warnings").alias("gate_warnings"), F.col("i.gate.sha256").alias("gate_sha"),
                       F.col("i.gate.template").alias("gate_template"), F.col("i.gate.checked_at").alias("gate_checked_at"), "extra")


def course_tables(docs: DataFrame) -> dict[str, DataFrame]:
    """``(course_id, json)`` manifests to courses, items, mastery, scopes, and states (see :func:`item_states`)."""
    rows = docs.select("course_id", F.from_json("json", COURSE).alias("c"))
    lo = F.regexp_extract("c.scope.range", r"^(\d+)-(\d+)$", 1).try_cast("int")
    hi = F.regexp_extract("c.scope.range", r"^(\d+)-(\d+)$", 2).try_cast("int")
    items = rows.select("course_id", F.explode("c.items").alias("i")).select("course_id", "i.*").withColumnRenamed("index", "idx")
    return {
        "courses": rows.select("course_id", "c.version", "c.kind", "c.source_url", "c.title", "c.probe", "c.template", "c.asr_lang",
                               F.col("c.review.source_digest").alias("review_digest")),
        "items": items,
        "mastery": rows.select("course_id", F.explode("c.mastery").alias("key", "m")).select("course_id", "key", "m.name", "m.mastered", "m.changed_at"),
        "scopes": rows.select("course_id", "c.scope.mode", "c.scope.first", lo.alias("lo"), hi.alias("hi")),
        "states": item_states(docs),
    }


def read_course_manifests(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    docs = _texts(spark, path).select(_folder().alias("course_id"), F.col("text").alias("json"))
    return course_tables(docs)


_SHOT = "STRUCT<page: INT, section: INT, `range`: ARRAY<STRING>, caption: STRING, name: STRING, t: STRING, pick: STRING>"


def shot_lists(docs: DataFrame) -> DataFrame:
    """``(video_id, json)`` work lists (array, or object with ``shots``) to normalised shots."""
    body = F.coalesce(F.get_json_object("json", "$.shots"), F.col("json"))
    rows = docs.select("video_id", F.posexplode(F.from_json(body, f"ARRAY<{_SHOT}>")).alias("pos", "s"))
    caption = tx.strip(F.coalesce("s.caption", F.lit("")))
    name = tx.strip(F.coalesce(F.nullif("s.name", F.lit("")), F.nullif(caption, F.lit("")), F.lit("shot")))
    label = F.when(F.col("s.section").isNotNull(), F.concat(F.lit("s"), F.col("s.section").cast("string"), F.lit("_"), tx.file_safe(name))).otherwise(tx.file_safe(name))
    two = F.size("s.range") == 2
    a, b = tx.clock_to_seconds(F.col("s.range")[0]), tx.clock_to_seconds(F.try_element_at("s.range", F.lit(2)))
    fine = F.coalesce(two & (a <= b), F.lit(False))
    return rows.select(
        "video_id", "pos", F.coalesce(F.nullif("s.page", F.lit(0)), F.lit(1)).alias("page"), F.regexp_replace(label, f"{tx.BLANK}+", "-").alias("label"),
        caption.alias("caption"), tx.clock_to_seconds(F.col("s.t")).alias("t"), F.col("s.range").isNotNull().alias("has_range"),
        F.when(fine, a).alias("r0"), F.when(fine, b).alias("r1"), F.when(F.col("s.pick").rlike(r"^\d+$"), F.col("s.pick").cast("int")).alias("pick"), "s.section")


def anchor_table(docs: DataFrame) -> DataFrame:
    """``(json)`` anchor files ``{video: {page: [[label, caption, [pattern]]]}}`` to pattern rows; ``_`` keys are remarks."""
    rows = docs.select(F.explode(F.from_json("json", "map<string,string>")).alias("video_id", "v")).filter(~F.startswith("video_id", F.lit("_")))
    rows = rows.select("video_id", F.explode(F.from_json("v", "map<string,array<string>>")).alias("page", "e"))
    rows = rows.select("video_id", F.col("page").cast("int").alias("page"), F.posexplode("e").alias("pos", "x"))
    item = F.from_json("x", "array<string>")
    return rows.select("video_id", "page", "pos", item[0].alias("label"), item[1].alias("caption"),
                       F.explode(F.from_json(item[2], "array<string>")).alias("pattern"))


def manifest_frames(docs: DataFrame) -> DataFrame:
    """``(video_id, json)`` frame manifests to their frame records."""
    frames = "frames ARRAY<STRUCT<file: STRING, page: INT, label: STRING, keyword: STRING, caption: STRING, t: DOUBLE, qc: STRING, section: INT>>"
    return docs.select("video_id", F.explode(F.from_json("json", frames).getField("frames")).alias("f")).select("video_id", "f.*")


def read_shot_lists(spark: SparkSession, path: str) -> DataFrame:
    return shot_lists(_texts(spark, path).select(_folder().alias("video_id"), F.col("text").alias("json")))


def read_caption_json(spark: SparkSession, path: str) -> DataFrame:
    """Caption documents as ``(video_id, raw)`` for the flatten operators."""
    return _texts(spark, path).select(F.regexp_replace(_name(), r"\..*$", "").alias("video_id"), F.col("text").alias("raw"))


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """Decoded gray frames ``(video_id, t, w, h, px)`` from Parquet; pixels as bytes or as numbers."""
    frames = spark.read.parquet(path).select("video_id", "t", "w", "h", "px")
    return frames if dict(frames.dtypes)["px"] == "binary" else frames.withColumn("px", F.col("px").cast("array<int>"))


# Fixed value: header of an 8-bit gray picture file, with comments between its fields; one blank ends it.
_GAP = r"(?:\s|#[^\n\r]*[\n\r])+"
GRAY_HEADER = rf"^P5{_GAP}(\d{{1,6}}){_GAP}(\d{{1,6}}){_GAP}(\d{{1,5}})\s"
HEADER_BYTES = 4096


def _gray_parts(files: DataFrame) -> DataFrame:
    head = F.decode(F.substring("content", 1, HEADER_BYTES), "ISO-8859-1")
    parts = files.withColumn("_h", F.regexp_extract(head, GRAY_HEADER, 0)).withColumns({
        "w": F.regexp_extract(head, GRAY_HEADER, 1).try_cast("int"), "h": F.regexp_extract(head, GRAY_HEADER, 2).try_cast("int"),
        "_top": F.regexp_extract(head, GRAY_HEADER, 3).try_cast("int")})
    size = F.col("w") * F.col("h")
    return parts.withColumns({
        "px": F.expr("substring(content, length(_h) + 1, w * h)"),
        "error": F.when(F.col("content").isNull() | (F.col("_h") == ""), "no gray picture header").when(F.col("_top") != 255, "not 8 bits per pixel")
        .when(size == 0, "no pixels").when(F.length("content") - F.length("_h") < size, "pixels missing")})


def decode_gray(files: DataFrame) -> DataFrame:
    """``(video_id, t, content)`` with whole 8-bit gray files to frames with BINARY pixels.

    Files that are none are left out here and listed by :func:`gray_errors`.
    """
    return _gray_parts(files).filter("error IS NULL").select("video_id", "t", "w", "h", "px")


def gray_errors(files: DataFrame) -> DataFrame:
    """``(video_id, t, error)`` of the files that :func:`decode_gray` leaves out."""
    return _gray_parts(files).filter("error IS NOT NULL").select("video_id", "t", "error")


def gray_files(spark: SparkSession, path: str) -> DataFrame:
    """``(video_id, t, content)`` of files ``<video>/<second>.pgm`` under a folder; the reader passes over empty files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pgm").option("recursiveFileLookup", "true").load(path)
    place = F.regexp_extract("path", r"(\d+)/(\d+)\.pgm$", 0) != ""
    return files.filter(place).select(F.regexp_extract("path", r"(\d+)/(\d+)\.pgm$", 1).cast("long").alias("video_id"),
                                      F.regexp_extract("path", r"(\d+)/(\d+)\.pgm$", 2).cast("int").alias("t"), "content")


def read_binary_frames(spark: SparkSession, path: str) -> DataFrame:
    return decode_gray(gray_files(spark, path))


def link_catalog(docs: DataFrame, platforms: list[str] | None = None) -> DataFrame:
    """``(json)`` lists of links per platform (plain or ``{url}``) to ``(platform, pos, url)``."""
    rows = docs.select(F.explode(F.from_json("json", "map<string,string>")).alias("platform", "v"))
    if platforms:
        rows = rows.filter(F.col("platform").isin(*platforms))
    rows = rows.select("platform", F.posexplode(F.from_json("v", "array<string>")).alias("pos", "x"))
    url = F.when(F.startswith("x", F.lit("{")), F.get_json_object("x", "$.url")).otherwise(F.col("x"))
    return rows.select("platform", "pos", url.alias("url")).filter("coalesce(url, '') <> ''")


def read_link_catalog(spark: SparkSession, path: str, platforms: list[str] | None = None) -> DataFrame:
    return link_catalog(_texts(spark, path).select(F.col("text").alias("json")), platforms)
