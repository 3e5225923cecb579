"""Course manifests: items, scope, effort, progress, marks and the incremental gate.

Items are rows ``(course_id, idx, bvid, page, cid, title, section, duration, status, ...)``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from lectern.functions import ordered, text as tx

# Effort constants and batch limits.
ASR_RATIO = 0.2
NOTE_SECONDS = 60
FETCH_SECONDS = 5
MAX_ITEMS = 200
MAX_HOURS = 100
STATES = ("pending", "running", "done", "failed", "out_of_scope")
METADATA = ("idx", "title", "section", "duration")
ITEM_KEY = ["course_id", "bvid", "cid", "page"]

_PAGE = "STRUCT<page: INT, cid: BIGINT, part: STRING, duration: DOUBLE>"


def expand_course_items(courses: DataFrame, mode: str = "season") -> DataFrame:
    """Course payloads to numbered items, inside the row.

    ``pages`` reads ``(course_id, bvid, title, pages)``; ``season`` reads ``(course_id,
    sections ARRAY<STRUCT<title, episodes ARRAY<STRUCT<bvid, title, duration, pages>>>>)``.
    Rows without identity carry an ``error``. An episode's duration stands in only for its
    single page.
    """
    if mode == "pages":
        rows = courses.select("course_id", F.posexplode(F.expr(
            "transform(pages, p -> named_struct('bvid', bvid, 'p', p, 'vt', coalesce(title, bvid), 'st', '', 'n', size(pages), 'ed', 0D))")).alias("i", "x"))
    else:
        flat = """flatten(transform(sections, s -> flatten(transform(coalesce(s.episodes, array()), e -> transform(e.pages, p ->
            named_struct('bvid', e.bvid, 'p', p, 'vt', coalesce(e.title, e.bvid), 'st', coalesce(s.title, ''), 'n', size(e.pages), 'ed', coalesce(e.duration, 0D)))))))"""
        rows = courses.select("course_id", F.posexplode(F.expr(flat)).alias("i", "x"))
    own = F.coalesce("x.p.duration", F.lit(0.0))
    duration = F.when(own > 0, own).when(F.col("x.n") == 1, F.col("x.ed")).otherwise(0.0)
    error = F.when(F.coalesce("x.bvid", F.lit("")) == "", "no video id").when(
        F.coalesce("x.p.cid", F.lit(0)) <= 0, "no cid").otherwise("")
    return rows.select(
        "course_id", (F.col("i") + 1).alias("idx"), "x.bvid", F.coalesce("x.p.page", F.lit(1)).alias("page"), F.col("x.p.cid").alias("cid"),
        F.coalesce(F.nullif("x.p.part", F.lit("")), "x.vt").alias("title"), F.col("x.st").alias("section"),
        duration.alias("duration"), F.lit("pending").alias("status"), error.alias("error"))


def merge_item_history(items: DataFrame, history: DataFrame) -> DataFrame:
    """New item metadata with the latest known state; ``history`` has ``ord`` (later wins)."""
    state = [c for c in history.columns if c not in (*ITEM_KEY, *METADATA, "ord")]
    # Dealt out by item first: a task that reads many manifests would sort all their states. One value
    # per column, taken from the same row, lets the columns that nobody reads stay unread.
    last = history.repartition(*ITEM_KEY).groupBy(*ITEM_KEY).agg(
        F.max_by(F.lit(True), "ord").alias("_known"), *[F.max_by(c, "ord").alias(f"_h_{c}") for c in state])
    rows = items.join(last, ITEM_KEY, "left")
    kept = [c for c in items.columns if c not in state]
    fresh = {c: F.col(c) if c in items.columns else F.lit(None) for c in state}
    return rows.select(*kept, *[F.when(F.col("_known"), F.col(f"_h_{c}")).otherwise(fresh[c]).alias(c) for c in state])


def scope_bounds(scopes: DataFrame, items: DataFrame) -> DataFrame:
    """First and last index per course from ``(course_id, mode, first, lo, hi)``, with errors.

    ``first`` is clamped to the course, a ``range`` must fit it.
    """
    size = items.groupBy("course_id").agg(F.max("idx").alias("n"))
    rows = size.join(scopes, "course_id", "left")
    mode = F.coalesce("mode", F.lit("all"))
    bad = (mode == "range") & ~F.coalesce((F.col("lo") >= 1) & (F.col("lo") <= F.col("hi")) & (F.col("hi") <= F.col("n")), F.lit(False))
    bad = bad | ((mode == "first") & ~F.coalesce(F.col("first") >= 1, F.lit(False))) | ~mode.isin("all", "first", "range")
    return rows.select(
        "course_id", F.when(mode == "range", F.col("lo")).otherwise(1).alias("lo"),
        F.when(mode == "range", F.col("hi")).when(mode == "first", F.least("first", "n")).otherwise(F.col("n")).alias("hi"),
        F.when(bad, "invalid scope").otherwise("").alias("error"))


def select_scope(items: DataFrame, scopes: DataFrame) -> DataFrame:
    """Items inside their course's scope; courses with an invalid scope give none."""
    bounds = scope_bounds(scopes, items).filter("error = ''").select("course_id", "lo", "hi")
    return items.join(bounds, "course_id").filter("idx BETWEEN lo AND hi").drop("lo", "hi")


def apply_scope_state(items: DataFrame, scopes: DataFrame) -> DataFrame:
    """Items outside become ``out_of_scope`` (if open), items inside come back to ``pending``."""
    bounds = scope_bounds(scopes, items).filter("error = ''").select("course_id", "lo", "hi")
    inside = F.col("idx").between(F.col("lo"), F.col("hi"))
    status = F.when(~inside & F.col("status").isin("pending", "running"), "out_of_scope").when(
        inside & (F.col("status") == "out_of_scope"), "pending").otherwise(F.col("status"))
    return items.join(bounds, "course_id", "left").withColumn("status", status).drop("lo", "hi")


def _no_caption() -> Column:
    return F.coalesce("subtitle_hint", F.lit("unknown")) != "has"


def estimate_effort(items: DataFrame) -> DataFrame:
    """Videos, hours and seconds of work per course."""
    g = items.groupBy("course_id").agg(
        F.count_distinct("bvid").alias("videos"), F.count("*").alias("items"),
        F.count_if(_no_caption()).alias("asr_items"), F.sum("duration").alias("duration"),
        F.sum(F.when(_no_caption(), F.col("duration")).otherwise(0)).alias("_asr"))
    asr = F.col("_asr") * ASR_RATIO
    fixed = F.col("items") * (NOTE_SECONDS + FETCH_SECONDS)
    hours = F.col("duration") / 3600
    return g.select(
        "course_id", "videos", "items", "asr_items", "duration", hours.alias("hours"), asr.alias("asr_seconds"),
        (F.col("items") * NOTE_SECONDS).alias("note_seconds"), (F.col("items") * FETCH_SECONDS).alias("fetch_seconds"),
        (asr + fixed).alias("total_seconds"), ((F.col("items") > MAX_ITEMS) | (hours > MAX_HOURS)).alias("oversize"))


def remaining_effort(items: DataFrame) -> DataFrame:
    """Seconds still needed: mean time of finished items per open one, else the estimate."""
    timed = (F.col("status") == "done") & (F.col("seconds") > 0)
    open_ = F.col("status").isin("pending", "running")
    g = items.groupBy("course_id").agg(
        F.sum(F.when(timed, F.col("seconds"))).alias("spent"), F.count_if(timed).alias("done"), F.count_if(open_).alias("open"),
        F.sum(F.when(open_ & _no_caption(), F.col("duration")).otherwise(0)).alias("asr"))
    seconds = F.when(F.col("done") > 0, F.col("spent") / F.col("done") * F.col("open")).otherwise(
        F.col("asr") * ASR_RATIO + F.col("open") * (NOTE_SECONDS + FETCH_SECONDS))
    return g.select("course_id", "open", seconds.cast("double").alias("remaining_seconds"))


def probe_hints(resolved: DataFrame) -> DataFrame:
    """Caption hint per item from :func:`captions.resolve_subtitle_probes` results."""
    hint = (F.when((F.col("failed") > 0) & (F.col("succeeded") == 0), "unknown")
            .when(F.col("kind") != "none", "has").when(F.col("saw_track"), "track_only").otherwise("none"))
    return resolved.withColumn("subtitle_hint", hint)


def login_hints(hinted: DataFrame) -> DataFrame:
    """Courses where more than half of the known items show no captions at all."""
    g = hinted.groupBy("course_id").agg(
        F.count_if(F.col("subtitle_hint") == "none").alias("none"), F.count_if(F.col("subtitle_hint") != "unknown").alias("known"))
    return g.select("course_id", "none", "known", (F.col("none") * 2 > F.col("known")).alias("login_hint"))


def course_progress(items: DataFrame) -> DataFrame:
    """State counts per course."""
    return items.groupBy("course_id").agg(
        *[F.count_if(F.col("status") == s).alias(s) for s in STATES], F.count("*").alias("total"))


# Labels of the states in the course index.
STATE_LABELS = {"pending": "待处理", "running": "进行中", "done": "已完成", "failed": "失败", "out_of_scope": "未选"}


def course_index_lines(items: DataFrame) -> DataFrame:
    """Index rows of a course: label, clock text, link or reason, keyed for ordered writing."""
    label = F.coalesce(*[F.when(F.col("status") == k, v) for k, v in STATE_LABELS.items()])
    link = F.when((F.col("status") == "done") & (F.coalesce("note", F.lit("")) != ""),
                  F.concat(F.lit("[笔记]("), F.replace("note", F.lit(" "), F.lit("%20")), F.lit(")"))).otherwise("")
    line = F.concat(F.lit("| "), F.col("idx").cast("string"), F.lit(" | "), tx.escape_cell(F.col("title")), F.lit(" | "),
                    tx.hms(F.col("duration")), F.lit(" | "), label, F.lit(" | "), link, F.lit(" |"))
    return items.select("course_id", "section", "idx", line.alias("line"))


# Labels and headings of the index document.
INDEX_LABELS = {"done": "✅ 完成", "failed": "❌ 失败", "running": "🔄 进行中", "pending": "⏳ 待做", "out_of_scope": "⏳ 待做"}
INDEX_REOPENED = "⏳ 待修改"
INDEX_HEADER = ("| 序号 | 标题 | 时长 | 状态 | 笔记 | 视频 |", "| --- | --- | --- | --- | --- | --- |")
INDEX_VIDEO = "https://www.bilibili.com/video/"


def course_index(courses: DataFrame, items: DataFrame, updated: str) -> DataFrame:
    """The index document of every course as numbered lines ``(course_id, line_no, line)``.

    ``courses(course_id, title, owner, source_url, kind, root, concepts_file, quiz_file, concepts,
    questions, mastered)``, the last five null without a review; ``items`` with ``chosen`` and, for
    failed ones, ``reason``, ``next_step`` and ``rerun``. A course with sections gets a table
    whenever the section changes along its chosen items; failed items are listed with their next step.
    """
    def t(c):
        return tx.cell_text(F.col(c))

    def s(c):
        return F.col(c).cast("string")

    def line(df, part, sub, *parts, idx=None):
        order = F.struct(F.lit(part).alias("part"), (F.lit(0) if idx is None else F.col(idx)).cast("bigint").alias("idx"), F.lit(sub).alias("sub"))
        return df.select("course_id", order.alias("o"), F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts]).alias("line"))

    chosen = items.filter("chosen")
    counts = items.groupBy("course_id").agg(
        F.count("*").alias("total"), F.sum("duration").alias("_d"), F.count_if("chosen").alias("n"),
        *[F.count_if(F.col("chosen") & (F.col("status") == k)).alias(f"n_{k}") for k in ("done", "failed", "pending", "running")])
    heads = courses.join(counts, "course_id").withColumn("hours", F.rint(F.col("_d") / 360) / 10)
    reviewed = heads.filter("concepts_file IS NOT NULL")
    kind = F.when(F.col("kind") == "pages", "B站").otherwise("合集")
    rows = chosen.join(courses.select("course_id", "kind"), "course_id")
    parted = ordered.lag_row(rows.filter("kind = 'season'").withColumn("section", F.coalesce("section", F.lit(""))), ["course_id"], "idx", {"_s": "section"})
    opening = parted.filter("_s IS NULL OR _s <> section")
    label = F.coalesce(*[F.when(F.col("status") == k, v) for k, v in INDEX_LABELS.items()])
    label = F.when((F.col("status") == "pending") & F.coalesce(F.startswith("reason", F.lit("gate failed")), F.lit(False)), INDEX_REOPENED).otherwise(label)
    note = F.when(F.coalesce("note", F.lit("")) != "", F.concat(F.lit("[笔记]("), tx.link_path(F.col("note")), F.lit(")"))).otherwise("—")
    failed = chosen.filter("status = 'failed'")
    rerun = F.translate(F.coalesce("rerun", F.lit("")), "\r\n", "  ")
    return ordered.number_lines([
        line(heads, 0, 0, "> 课程：", t("title"), "（", kind, "，UP主：", t("owner"), "）"),
        line(heads, 0, 1, "> 来源：", F.coalesce("source_url", F.lit(""))),
        line(heads, 0, 2, "> 进度：完成 ", s("n_done"), "/", s("n"), "，失败 ", s("n_failed"), "，待做 ", s("n_pending"), "，进行中 ", s("n_running"),
             "；总集 ", s("total"), "，约 ", F.col("hours").cast("decimal(18,1)").cast("string"), f" 小时；更新时间：{updated}"),
        line(reviewed, 0, 3, "> 复习：[概念表](", tx.link_path(F.col("concepts_file")), ")（", s("concepts"), " 个概念，已掌握 ",
             F.least("mastered", "concepts").cast("string"), "）｜[课程自测](", tx.link_path(F.col("quiz_file")), ")（", s("questions"), " 题）"),
        *[line(heads, 0, 4 + i, x) for i, x in enumerate(("", "## 目录", ""))],
        *[line(heads.filter("kind = 'pages'"), 0, 7 + i, x) for i, x in enumerate(INDEX_HEADER)],
        line(opening, 1, 0, "### ", F.when(F.col("section") != "", t("section")).otherwise("未分组"), idx="idx"),
        *[line(opening, 1, 1 + i, x, idx="idx") for i, x in enumerate(("", *INDEX_HEADER))],
        line(rows, 1, 4, "| ", s("idx"), " | ", t("title"), " | ", tx.hms(F.col("duration")), " | ", label, " | ", note,
             f" | [视频]({INDEX_VIDEO}", F.col("bvid"), "?p=", s("page"), ") |", idx="idx"),
        *[line(heads, 2, i, x) for i, x in enumerate(("", "## 失败与补跑", ""))],
        line(failed, 3, 0, "+ 第 ", s("idx"), " 集 ", t("title"), "；原因：", t("reason"), "；下一步：", t("next_step"), idx="idx"),
        line(failed, 3, 1, "  补跑：`", rerun, "`", idx="idx"),
        line(heads.filter("n_failed = 0"), 3, 0, "无失败集。"),
        *[line(heads, 4, i, x) for i, x in enumerate(("", "## 未选择的集", ""))],
        line(heads, 4, 3, "共 ", (F.col("total") - F.col("n")).cast("string"), " 集；可运行 start ", F.col("root"), " --range A-B 选择范围。"),
        line(heads, 4, 4, ""),
    ], "course_id")


def stale_notes(done: DataFrame, current: DataFrame) -> DataFrame:
    """Done notes whose content or template changed since their last gate.

    ``done(course_id, idx, note_id, gate_sha, gate_template, template)``; ``current(note_id, sha)``
    lists existing notes. Missing notes are returned with a NULL sha.
    """
    rows = done.join(current, "note_id", "left")
    same = (F.col("sha") == F.col("gate_sha")) & (F.col("template") == F.col("gate_template"))
    return rows.filter(F.col("sha").isNull() | ~F.coalesce(same, F.lit(False)))


def reopen_items(stale: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Items put back to pending after the re-check, with the reason.

    ``verdicts(note_id, errors, first_errors)`` is the gate summary of the stale notes; the
    reason gives the first of the errors that it joins by "; ".
    """
    first = F.substring_index("first_errors", "; ", 1)
    rows = stale.join(verdicts, "note_id", "left")
    reason = F.when(F.col("sha").isNull(), "note missing").when(F.col("errors") > 0, F.concat(F.lit("gate failed: "), first))
    return rows.withColumn("reason", reason).filter("reason IS NOT NULL").select(
        "course_id", "idx", "note_id", F.lit("pending").alias("status"), F.col("note_id").alias("planned_note"), "reason")


def mark_outcome(events: DataFrame) -> DataFrame:
    """Validity of mark events ``(course_id, idx, ts, state, note, gate_errors, reason)``."""
    error = (F.when(~F.col("state").isin("done", "failed", "pending"), "unknown state")
             .when((F.col("state") == "done") & F.col("note").isNull(), "no note")
             .when((F.col("state") == "done") & (F.coalesce("gate_errors", F.lit(1)) > 0), "gate failed")
             .when((F.col("state") == "failed") & tx.is_blank(F.coalesce("reason", F.lit(""))), "no reason"))
    return events.withColumn("error", error)


def apply_marks(items: DataFrame, events: DataFrame) -> DataFrame:
    """Item state after the latest valid mark of each item (rejected marks change nothing)."""
    valid = mark_outcome(events).filter("error IS NULL")
    last = valid.groupBy("course_id", "idx").agg(F.max_by(F.struct("state", "ts", "note", "reason"), F.struct("ts", "event_id")).alias("m"))
    rows = items.join(last, ["course_id", "idx"], "left")
    m, state = F.col("m").isNotNull(), F.col("m.state")
    reset = m & (state == "pending")
    ts, started = F.col("m.ts").cast("timestamp"), F.col("started_at").cast("timestamp")
    elapsed = F.greatest(F.lit(0).cast("bigint"), F.unix_seconds(ts) - F.unix_seconds(started))
    null = F.lit(None)
    return rows.select(
        "course_id", "idx", F.when(m, state).otherwise(F.col("status")).alias("status"),
        F.when(reset, null).when(m & (state == "done"), F.col("m.note")).otherwise(F.col("note")).alias("note"),
        F.when(reset, null).otherwise(started).alias("started_at"),
        F.when(reset, null).when(m, ts).otherwise(F.col("finished_at")).alias("finished_at"),
        F.when(reset, null).when(m, elapsed).otherwise(F.col("seconds")).alias("seconds"),
        F.when(m & (state == "failed"), tx.strip(F.col("m.reason"))).when(m, null).otherwise(F.col("reason")).alias("reason"))


def assign_unique_names(items: DataFrame, reserved: DataFrame) -> DataFrame:
    """File name per item ``(course_id, idx, title)`` that no other item or reserved name uses.

    ``N.M`` numbering in the title is kept, otherwise the index is the prefix; names that
    differ only in case get the index in front, taken names a serial number.
    """
    safe = tx.file_safe(F.col("title"))
    pattern = r"(?U)^(\d+\.\d+)(?:[\s.、_\-]+|$)(.*)"
    numbered = safe.rlike(pattern)
    index3 = F.lpad(F.col("idx").cast("string"), F.greatest(F.lit(3), F.length(F.col("idx").cast("string"))), F.lit("0"))
    prefix = F.when(numbered, F.regexp_extract(safe, pattern, 1)).otherwise(index3)
    topic = F.when(numbered, tx.strip(F.regexp_extract(safe, pattern, 2))).otherwise(safe)
    base = F.concat(prefix, F.lit("-"), F.when(topic == "", "未命名").otherwise(topic), F.lit(".md"))
    rows = items.withColumn("_n", base).withColumn("_low", F.lower(base))
    twice = rows.groupBy("course_id", "_low").agg((F.count("*") > 1).alias("_twice"))
    rows = rows.join(twice, ["course_id", "_low"]).withColumn(
        "_name", F.when(F.col("_twice"), F.concat(index3, F.lit("-"), "_n")).otherwise(F.col("_n")))
    rows = rows.withColumn("_stem", F.concat(F.regexp_replace("_name", r"\.md$", ""), F.lit("-"), index3))
    taken = reserved.select("course_id", F.lower("name").alias("_r"))
    plain = taken.select("course_id", F.col("_r").alias("_key"), F.lit(True).alias("_hit")).distinct()
    # Serial numbers already used with a stem; the smallest free one is taken.
    used = taken.filter(F.col("_r").rlike(r"-\d+\.md$")).groupBy(
        "course_id", F.regexp_extract("_r", r"^(.*)-\d+\.md$", 1).alias("_skey")).agg(
        F.collect_set(F.regexp_extract("_r", r"-(\d+)\.md$", 1).cast("int")).alias("_used"))
    rows = rows.withColumn("_key", F.lower("_name")).withColumn("_skey", F.lower("_stem"))
    rows = rows.join(plain, ["course_id", "_key"], "left").join(used, ["course_id", "_skey"], "left")
    free = F.expr("array_min(array_except(sequence(1, size(coalesce(_used, array())) + 1), coalesce(_used, array())))")
    name = F.when(F.col("_hit"), F.concat("_stem", F.lit("-"), free.cast("string"), F.lit(".md"))).otherwise(F.col("_name"))
    return rows.select("course_id", "idx", name.alias("name"))


def validate_manifests(courses: DataFrame, items: DataFrame) -> DataFrame:
    """Field, enum and type findings over many manifests."""
    sha = r"^[0-9a-f]{64}$"
    course_rules = {
        "version": F.coalesce("version", F.lit(0)) != 1,
        "kind": ~F.coalesce(F.col("kind").isin("pages", "season"), F.lit(False)),
        "source_url": F.col("source_url").isNull(),
        "probe": F.col("probe").isNotNull() & ~F.col("probe").isin("default", "all", "none"),
        "template": F.col("template").isNotNull() & ~F.col("template").isin("v4", "v4-obsidian"),
        "asr_lang": F.col("asr_lang").isNotNull() & ~F.col("asr_lang").isin("zh", "en", "auto"),
        "review_digest": F.col("review_digest").isNotNull() & ~F.col("review_digest").rlike(sha),
    }
    item_rules = {
        "identity": (F.coalesce("bvid", F.lit("")) == "") | (F.coalesce("cid", F.lit(0)) == 0),
        "status": ~F.coalesce(F.col("status").isin(*STATES), F.lit(False)),
        "page": F.coalesce("page", F.lit(0)) < 1,
        "duration": F.coalesce("duration", F.lit(-1.0)) < 0,
        "gate": F.col("gate_sha").isNotNull() & (~F.col("gate_sha").rlike(sha) | (F.coalesce("gate_errors", F.lit(-1)) < 0)),
    }

    def found(df: DataFrame, rules: dict[str, Column], idx: Column) -> DataFrame:
        checks = F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules.items()]))
        return df.select("course_id", idx.cast("int").alias("idx"), F.explode(checks).alias("check"))

    gaps = items.groupBy("course_id").agg(
        F.count("*").alias("n"), F.count_distinct("idx").alias("d"), F.min("idx").alias("lo"), F.max("idx").alias("hi"))
    gaps = gaps.filter("n <> d OR lo <> 1 OR hi <> n").select("course_id", F.lit(None).cast("int").alias("idx"), F.lit("index").alias("check"))
    empty = courses.join(items.select("course_id").distinct(), "course_id", "left_anti").select(
        "course_id", F.lit(None).cast("int").alias("idx"), F.lit("no items").alias("check"))
    return found(courses, course_rules, F.lit(None)).unionByName(found(items, item_rules, F.col("idx"))).unionByName(gaps).unionByName(empty)


def course_backlog(items: DataFrame, fetched: DataFrame, transcribed: DataFrame) -> DataFrame:
    """Next item per course: the running one, else the first pending, with steps already done."""
    rank = F.when(F.col("status") == "running", 0).when(F.col("status") == "pending", 1)
    rows = items.filter(F.col("status").isin("running", "pending"))
    best = rows.groupBy("course_id").agg(F.min_by(F.struct("idx", "bvid", "page", "cid", "status"), F.struct(rank, "idx")).alias("i")).select("course_id", "i.*")
    got = fetched.select("bvid").distinct().withColumn("fetched", F.lit(True))
    text = transcribed.select("bvid", "page").distinct().withColumn("transcribed", F.lit(True))
    return best.join(got, "bvid", "left").join(text, ["bvid", "page"], "left").select(
        "course_id", "idx", "bvid", "page", "cid", "status", F.coalesce("fetched", F.lit(False)).alias("skip_fetch"),
        F.coalesce("transcribed", F.lit(False)).alias("skip_transcribe"))
