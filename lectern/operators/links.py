"""Ids, embedded page state, stream variants and post kinds harvested from pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lectern.functions import text as tx

# Id grammars of the platforms.
ID_PATTERNS = (
    ("bilibili", r"(BV[0-9A-Za-z]{10})"),
    ("youtube", r"(?:[?&]v=|youtu\.be/|/shorts/|/live/|/embed/|/v/)([A-Za-z0-9_-]{11})"),
    ("douyin", r"(?:video/|aweme_id=|/note/)(\d{15,})"),
    ("xiaohongshu", r"https?://(?:www\.)?xiaohongshu\.com/(?:explore|discovery/item)/([0-9a-f]{24})"),
)
BARE_PATTERNS = (("youtube", r"^([A-Za-z0-9_-]{11})$"), ("douyin", r"^(\d{15,})$"))
CODECS = ("h264", "h265", "av1")
ALBUM_TYPES = (68, 150)
STATE = r"(?s)window\.__INITIAL_STATE__\s*=\s*(\{.*?\})\s*</script>"


def extract_video_ids(texts: DataFrame) -> DataFrame:
    """Platform and id of each ``(text_id, text)``; bare ids count when nothing else matches."""
    text = tx.strip(F.col("text"))
    hits = [F.when(text.rlike(p), F.struct(F.lit(name).alias("platform"), F.regexp_extract(text, p, 1).alias("id")))
            for name, p in (*ID_PATTERNS, *BARE_PATTERNS)]
    return texts.select("text_id", F.coalesce(*hits).alias("v")).filter("v IS NOT NULL").select("text_id", "v.platform", "v.id")


def extract_page_state(pages: DataFrame) -> DataFrame:
    """Post object of ``(page_id, note_id, html)`` pages as JSON text with its type and title.

    The mobile form wins, then the entry with the page's id, then the last entry.
    """
    raw = F.regexp_replace(F.nullif(F.regexp_extract("html", STATE, 1), F.lit("")), r"\bundefined\b", "null")
    rows = pages.select("page_id", "note_id", raw.alias("state")).filter("state IS NOT NULL")
    mobile = F.get_json_object("state", "$.noteData.data.noteData")
    entries = F.from_json(F.get_json_object("state", "$.note.noteDetailMap"), "map<string,string>")
    by_id = F.get_json_object(F.try_element_at(entries, F.col("note_id")), "$.note")
    last = F.get_json_object(F.try_element_at(F.map_values(entries), F.lit(-1)), "$.note")
    post = F.coalesce(mobile, by_id, F.when(F.try_element_at(entries, F.col("note_id")).isNull(), last), F.lit("{}"))
    out = rows.select("page_id", F.try_parse_json(post).alias("v"))
    return out.select("page_id", F.try_variant_get("v", "$.type", "string").alias("type"),
                      F.try_variant_get("v", "$.title", "string").alias("title"))


def _codec_rank(codec: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, CODECS)), codec)


def pick_stream_variant(variants: DataFrame) -> DataFrame:
    """Best of ``(video_id, kind, codec, height, bandwidth, stream_id, url)`` per video and kind.

    ``stream``: codec order, then height; ``video``: highest id; ``audio``: lowest bandwidth;
    ``original`` is only a fallback for streams.
    """
    rows = variants.filter("url IS NOT NULL AND url <> ''")
    rows = rows.filter((F.col("kind") != "stream") | (_codec_rank(F.col("codec")) > 0))
    slot = F.when(F.col("kind") == "original", "stream").otherwise(F.col("kind"))
    rank = F.when(F.col("kind") == "original", F.struct(F.lit(99).cast("bigint").alias("a"), F.lit(0.0).alias("b"))).when(
        F.col("kind") == "stream", F.struct(_codec_rank(F.col("codec")).alias("a"), (-F.coalesce("height", F.lit(0))).cast("double").alias("b"))).when(
        F.col("kind") == "video", F.struct((-F.col("stream_id")).cast("bigint").alias("a"), F.lit(0.0).alias("b"))).otherwise(
        F.struct(F.lit(0).cast("bigint").alias("a"), F.col("bandwidth").cast("double").alias("b")))
    best = F.min_by(F.struct("kind", "codec", "height", "url"), F.struct(rank.alias("r"), "stream_id", "url"))
    return rows.groupBy("video_id", slot.alias("slot")).agg(best.alias("x")).select("video_id", "slot", "x.*")


def classify_posts(posts: DataFrame) -> DataFrame:
    """Video or album; live and upcoming posts are left out.

    ``posts(post_id, images, play_urls, download_urls, aweme_type, live_status)``.
    """
    has_video = (F.coalesce("play_urls", F.lit(0)) > 0) | (F.coalesce("download_urls", F.lit(0)) > 0)
    album = ((F.coalesce("images", F.lit(0)) > 0) & ~has_video) | F.coalesce(F.col("aweme_type").isin(*ALBUM_TYPES), F.lit(False))
    live = F.coalesce(F.col("live_status").isin("is_live", "is_upcoming"), F.lit(False))
    return posts.filter(~live).select("post_id", F.when(album, "album").otherwise("video").alias("kind"))
