"""Time-to-page lookup with tolerance, and deep links.

Catalyst has no range join, so both sides are cut into buckets of the tolerance: every entry
looks into its own bucket and its two neighbours, which turns the lookup into an equi-join
on ``(video_id, bucket)`` that also spreads a hot video over all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

TOLERANCE = 5
# Platforms whose web page cannot jump to a second.
NO_LINK_PLATFORMS = ("douyin", "xiaohongshu")


def _bucket(c: Column, width: int) -> Column:
    return F.floor(c / F.lit(width)).cast("bigint")


def near_lines(points: DataFrame, lines: DataFrame, tolerance: int = TOLERANCE) -> DataFrame:
    """Pairs of ``points(video_id, sec)`` and the seconds of ``lines`` within the tolerance.

    Both sides are reduced to distinct seconds first; the first line of each second stands
    for the rest, which is exact because only the first line in file order is ever wanted.
    """
    seconds = lines.groupBy("video_id", "page", "ts_sec").agg(F.min("line_no").alias("line_no"))
    seconds = seconds.withColumn("_b", _bucket(F.col("ts_sec"), tolerance))
    wide = points.distinct().withColumn(
        "_b", F.explode(F.array(*[_bucket(F.col("sec"), tolerance) + d for d in (-1, 0, 1)])))
    return wide.join(seconds, ["video_id", "_b"]).filter(
        F.abs(F.col("ts_sec") - F.col("sec")) <= tolerance).drop("_b")


def locate_page(entries: DataFrame, lines: DataFrame, tolerance: int = TOLERANCE) -> DataFrame:
    """Add ``page`` and ``rel_sec`` to entries ``(video_id, sec, only_page, ...)``.

    The lowest page wins, then the first line in file order within the tolerance (not the
    nearest); ``only_page`` fixes the page. Both are NULL when nothing is near.
    """
    points = entries.select("video_id", "sec", "only_page")
    near = near_lines(points, lines, tolerance).filter("only_page IS NULL OR only_page = page")
    best = near.groupBy("video_id", "sec", "only_page").agg(
        F.min(F.struct("page", "line_no", "ts_sec")).alias("_m"))
    best = best.select(
        "video_id", "sec", F.coalesce("only_page", F.lit(-1)).alias("_op"),
        F.col("_m.page").alias("page"), F.col("_m.ts_sec").alias("rel_sec"))
    return entries.withColumn("_op", F.coalesce("only_page", F.lit(-1))).join(
        best, ["video_id", "sec", "_op"], "left").drop("_op")


def deep_link(platform: Column, vid: Column, page: Column, rel: Column) -> Column:
    """Link to a second of a page; NULL where the platform has none or nothing was found."""
    second = F.round(rel).cast("bigint").cast("string")
    youtube = F.concat(F.lit("https://www.youtube.com/watch?v="), vid, F.lit("&t="), second, F.lit("s"))
    paged = F.concat(F.lit("https://www.bilibili.com/video/"), vid, F.lit("?p="), page.cast("string"),
                     F.lit("&t="), second)
    return F.when(platform.isin(*NO_LINK_PLATFORMS), F.lit(None).cast("string")).when(
        platform == "youtube", youtube).otherwise(paged)


def build_deep_links(entries: DataFrame, lines: DataFrame) -> DataFrame:
    """Entries ``(entry_id, video_id, sec, only_page, platform, vid)`` with page, second and link."""
    found = locate_page(entries, lines)
    return found.withColumn(
        "url", deep_link(F.coalesce("platform", F.lit("")), F.col("vid"), F.col("page"), F.col("rel_sec")))


def whitelist_entries(entries: DataFrame, lines: DataFrame) -> DataFrame:
    """Entries with no transcript second near them on any page."""
    near = near_lines(entries.select("video_id", "sec"), lines).select("video_id", "sec").distinct()
    return entries.join(near, ["video_id", "sec"], "left_anti")


YOUTUBE_LINK = r"https://www\.youtube\.com/watch\?v={vid}&t=\d+s"
PAGED_LINK = r"https://www\.bilibili\.com/video/{vid}\?p=\d+&t=\d+"


def link_is_valid(url: Column, platform: Column, vid: Column) -> Column:
    """Format test of a deep link for its platform and identity (loose when unknown)."""
    youtube = (platform == "youtube") | ((platform == "") & F.contains(url, F.lit("youtube.com")))

    def shape(pattern: str, loose: str) -> Column:
        head, tail = pattern.split("{vid}")
        known = (
            url.rlike(f"^{head}") & F.startswith(F.regexp_replace(url, f"^{head}", ""), vid)
            & F.substring(F.regexp_replace(url, f"^{head}", ""), F.length(vid) + 1, F.length(url)).rlike(f"^{tail}$")
        )
        return F.when(vid != "", known).otherwise(url.rlike(f"^{head}{loose}{tail}$"))

    return F.when(youtube, shape(YOUTUBE_LINK, "[A-Za-z0-9_-]{11}")).otherwise(shape(PAGED_LINK, r"\S+"))


def verify_deep_links(entries: DataFrame, lines: DataFrame) -> DataFrame:
    """Problem per linked entry: bad ``format``, or ``second`` differs from the transcript."""
    vid, platform = F.coalesce("vid", F.lit("")), F.coalesce("platform", F.lit(""))
    found = locate_page(entries.filter("url IS NOT NULL"), lines)
    t = F.regexp_extract("url", r"&t=(\d+)s?$", 1).try_cast("bigint")
    problem = F.when(~link_is_valid(F.col("url"), platform, vid), "format").when(
        F.col("rel_sec").isNotNull() & (t != F.col("rel_sec")), "second")
    return found.withColumn("problem", problem).filter("problem IS NOT NULL").select(
        "entry_id", "problem", t.alias("link_sec"), F.col("rel_sec"))


# Markers, heading and entries of a time index.
NAV_BEGIN, NAV_END = r"^\s*<!--\s*NAV:BEGIN\b.*?-->\s*$", r"^\s*<!--\s*NAV:END\b.*?-->\s*$"
INDEX_HEAD, ANY_HEAD = r"^##\s+.*视频时间索引", r"^##\s+"
OPEN_ENTRY = r"^(\s*)([-*+])\s*\[(\d{1,3}):(\d{2})\]\s+(?!\()(\S.*?)\s*$"
MARKED_ENTRY = r"^(\s*)(-)\s*\[(\d{1,3}):(\d{2})\]\s+(?!\()(\S.*?)\s*$"
ANY_ENTRY = r"^\s*-\s*\[\d{1,3}:\d{2}\]\s*(\(|\S)"


def fill_nav_links(notes: DataFrame, lines: DataFrame, tolerance: int = TOLERANCE) -> DataFrame:
    """Notes with the open entries of their time index linked in place, and what was done.

    ``notes(note_id, text, kind, video_id, platform, vid, only_page)``; a v3 note has its index
    between two markers, the others below a heading. Linked entries and all other lines stay, so
    filling twice changes nothing. ``status`` is ok, skipped (no index, or none of its markers or
    entries) or error (markers that are no pair: the text stays). Only the entries
    meet the transcript lines; their links join the texts at the end.
    """
    v3 = F.col("kind") == "v3"
    body = F.split(F.regexp_replace("text", r"\n$", ""), "\n", -1)
    rows = notes.select("*", F.inline(F.array(F.struct(body.alias("ls")))))

    def places(pattern: str, since: Column = F.lit(0)) -> Column:
        return F.filter(F.transform("ls", lambda s, i: F.when(s.rlike(pattern) & (i >= since), i)), lambda i: i.isNotNull())

    closing = F.try_element_at(places("^---$", F.lit(1)), F.lit(1))
    front = F.when((F.col("kind") == "v4-obsidian") & (F.element_at("ls", 1) == "---"), F.coalesce(closing + 1, F.lit(0))).otherwise(0)
    rows = rows.select("*", F.inline(F.array(F.struct(
        places(NAV_BEGIN).alias("begins"), places(NAV_END).alias("ends"), places(INDEX_HEAD, front).alias("heads"), places(ANY_HEAD).alias("marks")))))
    head = F.try_element_at("heads", F.lit(1))
    after = F.try_element_at(F.filter("marks", lambda i: i > head), F.lit(1))
    paired = (F.size("begins") == 1) & (F.size("ends") == 1) & (F.try_element_at("begins", F.lit(1)) < F.try_element_at("ends", F.lit(1)))
    start = F.when(v3, F.when(paired, F.element_at("begins", 1))).otherwise(head)
    end = F.when(v3, F.when(paired, F.element_at("ends", 1))).otherwise(F.coalesce(after, F.size("ls")))
    rows = rows.select("*", F.inline(F.array(F.struct(start.alias("start"), end.alias("end")))))
    inside = F.filter(F.transform("ls", lambda s, i: F.struct(i.alias("i"), s.alias("s"))), lambda x: (x["i"] > F.col("start")) & (x["i"] < F.col("end")))
    bare = (v3 & (F.size("begins") + F.size("ends") == 0)) | (~v3 & F.col("start").isNull())
    empty = v3 & ~F.exists(F.coalesce(inside, F.array()), lambda x: x["s"].rlike(ANY_ENTRY))
    status = F.when(bare, "skipped").when(v3 & ~paired, "error").when(empty, "skipped").otherwise("ok")
    rows = rows.select("note_id", "text", "ls", "kind", "video_id", "platform", "vid", "only_page", status.alias("status"), inside.alias("inside"))
    wanted = (F.col("status") == "ok") & ~F.coalesce("platform", F.lit("")).isin(*NO_LINK_PLATFORMS)
    fits = F.when(v3, F.col("x.s").rlike(MARKED_ENTRY)).otherwise(F.col("x.s").rlike(OPEN_ENTRY))
    part = [F.regexp_extract("x.s", OPEN_ENTRY, g) for g in range(1, 6)]
    entries = rows.filter(wanted).select("note_id", "kind", "video_id", "platform", "vid", "only_page", F.explode("inside").alias("x")).filter(fits).select(
        "note_id", "video_id", "platform", "vid", "only_page", F.col("x.i").alias("i"), (part[2].cast("int") * 60 + part[3].cast("int")).alias("sec"),
        F.concat(part[0], part[1], F.lit(" ["), part[2], F.lit(":"), part[3], F.lit("](")).alias("left"), F.concat(F.lit(") "), part[4]).alias("right"))
    found = locate_page(entries, lines, tolerance)
    link = F.when(F.col("page").isNotNull(), deep_link(F.coalesce("platform", F.lit("")), F.col("vid"), F.col("page"), F.col("rel_sec")))
    # the entries of one note come from one text cell, so this map is bounded by it
    made = found.withColumn("url", link).groupBy("note_id").agg(
        F.map_from_entries(F.collect_list(F.when(F.col("url").isNotNull(), F.struct("i", F.concat("left", "url", "right"))))).alias("new"),
        F.count("url").alias("written"), F.count_if(F.col("url").isNull()).alias("skipped"))
    # the join carries the text once; the few notes that get links are split again behind it
    woven = F.transform(body, lambda s, i: F.coalesce(F.try_element_at("new", i), s))
    filled = F.concat(F.array_join(woven, "\n"), F.when(F.endswith("text", F.lit("\n")), "\n").otherwise(""))
    return rows.select("note_id", "text", "status").join(made, "note_id", "left").select(
        "note_id", F.when(F.coalesce("written", F.lit(0)) > 0, filled).otherwise(F.col("text")).alias("text"), "status",
        F.coalesce("written", F.lit(0)).alias("written"), F.coalesce("skipped", F.lit(0)).alias("skipped"))
