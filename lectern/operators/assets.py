"""Images and media files of notes: keys, links, cleanup, readability."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lectern.operators.markdown import IMAGE

REMOTE = r"^(?:https?:)?//|^data:"
# Suffixes that are kept, media suffixes, and temporary files.
PROTECTED = ("txt", "json", "done", "md", "markdown", "srt", "vtt", "ass", "lrc")
MEDIA = ("m4s", "m4a", "mp4", "mp3", "wav", "flac", "aac", "ogg", "opus", "webm", "mkv", "mov", "avi", "ts", "flv")
TEMPORARY = r"^\.audio_.*\.m4s$|^\.video_.*\.m4s$|\.part$"


def content_keys(files: DataFrame, prefix: str = "") -> DataFrame:
    """Key of each file ``(path, content)``: same bytes, same key."""
    suffix = F.lower(F.regexp_extract("path", r"(?<=[^/])(\.[^./]*)$", 1))
    return files.select("path", F.concat(F.lit(prefix), F.substring(F.sha2("content", 256), 1, 16), suffix).alias("key"))


def _references(notes: DataFrame) -> DataFrame:
    rows = notes.select("note_id", F.posexplode(F.regexp_extract_all("text", F.lit(IMAGE), F.lit(2))).alias("pos", "path"))
    return rows.filter(~F.col("path").rlike(REMOTE)).groupBy("note_id", "path").agg(F.min("pos").alias("pos"))


def missing_assets(notes: DataFrame, inventory: DataFrame) -> DataFrame:
    """Local image references of each note, once, in order, with whether the file exists."""
    have = inventory.select("note_id", "path").distinct().withColumn("_f", F.lit(True))
    return _references(notes).join(have, ["note_id", "path"], "left").select(
        "note_id", "pos", "path", F.coalesce("_f", F.lit(False)).alias("found"))


def rewrite_asset_links(notes: DataFrame, mapping: DataFrame) -> DataFrame:
    """Replace image paths by ``mapping(note_id, path, url)`` and count the replacements.

    Only the path inside the image syntax changes. The mapping of one note is gathered (it is
    bounded by the note's own references) and applied inside the row.
    """
    used = mapping.join(_references(notes).select("note_id", "path"), ["note_id", "path"], "left_semi")
    used = used.groupBy("note_id", "path").agg(F.min("url").alias("url"))
    per = used.groupBy("note_id").agg(F.map_from_entries(F.collect_list(F.struct("path", "url"))).alias("m"))
    rows = notes.join(per, "note_id", "left")
    woven = F.expr(f"""zip_with(split(text, r'{IMAGE}', -1), regexp_extract_all(text, r'{IMAGE}', 0), (g, x) -> concat(g, coalesce(
        IF(m IS NULL OR m[regexp_extract(x, r'{IMAGE}', 2)] IS NULL, x,
           concat('![', regexp_extract(x, r'{IMAGE}', 1), '](', m[regexp_extract(x, r'{IMAGE}', 2)], ')')), '')))""")
    count = F.expr(f"coalesce(size(filter(regexp_extract_all(text, r'{IMAGE}', 2), p -> m[p] IS NOT NULL)), 0)")
    return rows.select("note_id", F.array_join(woven, "").alias("text"), F.when(F.col("m").isNull(), 0).otherwise(count).alias("replaced"))


def cleanup_candidates(files: DataFrame, referenced: DataFrame, protected: DataFrame) -> DataFrame:
    """Media that may be removed (listing only).

    ``files(folder, name, resolved, bytes)``; ``referenced(folder, name)`` comes from metadata,
    ``protected(resolved)`` from manifests. Texts, notes and their markers always stay; one row
    per resolved path.
    """
    known = referenced.select("folder", "name").distinct().withColumn("_m", F.lit(True))
    rows = files.join(known, ["folder", "name"], "left")
    parts = F.split(F.lower("name"), r"\.")
    inner = F.slice(parts, 2, F.size(parts))
    artifact = F.exists(inner, lambda p: p.isin(*PROTECTED))
    suffix = F.regexp_extract(F.lower("name"), r"\.([^.]*)$", 1)
    collected = F.col("_m") | F.col("name").rlike(TEMPORARY)
    rows = rows.filter(F.coalesce(collected, F.lit(False)) & ~artifact & (suffix.isin(*MEDIA) | (suffix == "part")))
    rows = rows.join(protected, "resolved", "left_anti")
    return rows.groupBy("resolved").agg(F.min("folder").alias("folder"), F.min("name").alias("name"), F.max("bytes").alias("bytes"))


def cleanup_totals(candidates: DataFrame) -> DataFrame:
    return candidates.agg(F.count("*").alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))


def scan_unreadable_files(files: DataFrame) -> DataFrame:
    """Flag files with a NUL byte or broken UTF-8 in their first 4096 bytes.

    A character cut off by the end of the head is no error, so up to four bytes may be missing.
    """
    head = F.expr("substring(content, 1, 4096)")
    rows = files.select("path", head.alias("h"))
    tails = " OR ".join(f"is_valid_utf8(substring(h, 1, greatest(length(h) - {k}, 0)))" for k in range(5))
    return rows.select("path", F.expr(f"coalesce(position(X'00' IN h) > 0, false) OR NOT ({tails})").alias("unreadable"))
