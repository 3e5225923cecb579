"""Keyword anchors from transcripts and planning of screenshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lectern.functions import text as tx
from lectern.operators.timeindex import near_lines

# Spoken English words that make no anchor.
STOP_WORDS = (
    "this", "that", "with", "from", "have", "what", "when", "your", "then",
    "them", "they", "will", "would", "there", "these", "those", "which",
    "about", "into", "just", "like", "make", "made", "need", "want", "here",
    "very", "much", "more", "some", "time", "know", "think", "also",
    "because", "video", "today", "start", "okay",
)
# Chinese function characters and words that spoil an n-gram.
STOP_CHARS = "的了呢吗是在有和与就不都也还又把被让给从向对为以等"
STOP_PIECES = (
    "并且", "但是", "因为", "所以", "如果", "这个", "那个", "什么", "怎么",
    "我们", "你们", "他们", "没有", "已经", "还是", "而且", "因此", "然后",
    "可以", "自己", "一样", "这么", "那么", "怎样", "如何", "以及", "或者",
    "关于", "通过", "进行", "开始", "继续", "一直",
)
LATIN_TOKEN = r"@[A-Za-z]\w+|[A-Za-z][A-Za-z0-9_]{3,}"
HAN_RUN = r"[\x{4e00}-\x{9fff}]{2,8}"
LATIN_WEIGHT = 1.5
LEAD = 3
EARLIEST = 2
SPACING = 15
PAGE = ["video_id", "page"]


def mine_terms(lines: DataFrame) -> DataFrame:
    """Token counts and first time per page of ``(video_id, page, line_no, ts_sec, text)``.

    Latin tokens keep their case; Chinese runs (cut at eight characters) give every n-gram of
    two to four characters. Counts are combined before the shuffle.
    """
    latin = F.transform(
        F.regexp_extract_all("text", F.lit("(?U)" + LATIN_TOKEN), F.lit(0)),
        lambda x: F.struct(x.alias("tok"), F.lit(False).alias("is_zh")))
    grams = F.flatten(F.transform(
        F.regexp_extract_all("text", F.lit(HAN_RUN), F.lit(0)),
        lambda run: F.flatten(F.transform(
            F.filter(F.array(F.lit(2), F.lit(3), F.lit(4)), lambda n: n <= F.length(run)),
            lambda n: F.transform(
                F.sequence(F.lit(1), F.length(run) - n + 1),
                lambda i: F.struct(F.substring(run, i, n).alias("tok"), F.lit(True).alias("is_zh")))))))
    rows = lines.select(*PAGE, "line_no", "ts_sec", F.explode(F.concat(latin, grams)).alias("t"))
    return rows.groupBy(*PAGE, "t.tok", "t.is_zh").agg(
        F.count("*").alias("cnt"), F.min_by("ts_sec", "line_no").alias("first_ts"))


def filter_stop_terms(terms: DataFrame) -> DataFrame:
    """Drop stop words; Chinese n-grams also need two hits and no function character."""
    tok = F.col("tok")
    latin_stop = F.regexp_replace(F.lower(tok), "^@+", "").isin(*STOP_WORDS)
    pieces = F.exists(F.array(*map(F.lit, STOP_PIECES)), lambda w: F.contains(tok, w))
    han_bad = (F.col("cnt") < 2) | tok.rlike(f"[{STOP_CHARS}]") | pieces
    return terms.filter(F.when(F.col("is_zh"), ~han_bad).otherwise(~latin_stop))


def _score() -> Column:
    weight = F.when(F.col("is_zh"), F.lit(1.0)).otherwise(F.lit(LATIN_WEIGHT))
    return (F.col("cnt") * F.length("tok") * weight).cast("double")


def _rank_key() -> Column:
    return F.struct((-_score()).alias("s"), (-F.length("tok")).alias("l"), F.col("tok").alias("t"))


def rank_terms(terms: DataFrame, top: int | None = None) -> DataFrame:
    """Rank per page: score, then length, then token; ``top`` keeps the best of each page."""
    from pyspark.sql import Window as W

    order = W.partitionBy(*PAGE).orderBy(_rank_key())
    ranked = terms.withColumn("score", _score()).withColumn("rank", F.row_number().over(order))
    return ranked if top is None else ranked.filter(F.col("rank") <= top)


def anchor_label(tok: Column, is_zh: Column) -> Column:
    latin = F.regexp_replace(F.lower(F.regexp_replace(tok, "^@+", "")), r"(?U)\W+", "-")
    return F.when(is_zh, tok).otherwise(F.regexp_replace(latin, "^-+|-+$", ""))


def pick_diverse_anchors(terms: DataFrame, max_n: int = 3) -> DataFrame:
    """Greedy anchors per page: no substring of a kept token, at least 15 s apart.

    Walking the ranked list once is the same as ``max_n`` rounds that each take the best
    candidate free of conflicts with the kept ones. A round is one map-side combined
    aggregate, so no page is ever gathered into one task and nothing is cut off.
    """
    cands = terms.select(
        *PAGE, "tok", "is_zh", _rank_key().alias("_k"),
        F.greatest(F.lit(EARLIEST), F.col("first_ts") - LEAD).cast("double").alias("t"),
        anchor_label(F.col("tok"), F.col("is_zh")).alias("label"),
    ).filter("label <> ''")
    pick = F.min_by(F.struct("tok", "is_zh", "label", "t"), "_k")
    kept = cands.groupBy(*PAGE).agg(F.array(pick).alias("kept"))
    for _ in range(max_n - 1):
        free = cands.join(kept, PAGE).filter(
            "NOT exists(kept, k -> contains(k.tok, tok) OR abs(k.t - t) < %d)" % SPACING)
        more = free.groupBy(*PAGE).agg(pick.alias("_next"))
        kept = kept.join(more, PAGE, "left").select(
            *PAGE, F.expr("IF(_next IS NULL, kept, array_append(kept, _next))").alias("kept"))
    out = kept.select(*PAGE, F.posexplode("kept").alias("_i", "k"))
    quote = F.when(F.col("k.is_zh"), F.concat(F.lit("关键词“"), F.col("k.tok"), F.lit("”出现的画面"))).otherwise(
        F.concat(F.lit("关键词「"), F.col("k.tok"), F.lit("」出现的画面")))
    return out.select(*PAGE, (F.col("_i") + 1).alias("no"), F.col("k.label").alias("label"),
                      F.col("k.tok").alias("keyword"), quote.alias("caption"), F.col("k.t").alias("t"))


def match_anchor_patterns(lines: DataFrame, anchors: DataFrame) -> DataFrame:
    """Time of each ``anchors(video_id, page, label, pattern)`` row: first matching line, minus the lag.

    A line is tested once against all patterns of its page together; only lines that match any
    meet the patterns one by one. Patterns with back references or named groups cannot be put
    together, so their pages skip the first test.
    """
    alone = F.col("pattern").rlike(r"\\[1-9]|\\k<|\(\?<[A-Za-z]")
    whole = F.when(~F.bool_or(alone), F.concat(F.lit("(?:"), F.array_join(F.collect_set("pattern"), ")|(?:"), F.lit(")")))
    together = anchors.groupBy(*PAGE).agg(whole.alias("_any"))
    some = lines.join(together, PAGE).filter("_any IS NULL OR text RLIKE _any").drop("_any")
    hit = some.join(anchors, PAGE).filter("text RLIKE pattern")
    first = hit.groupBy(*PAGE, "label").agg(F.min_by("ts_sec", "line_no").alias("ts"))
    return first.select(*PAGE, "label", F.greatest(F.lit(EARLIEST), F.col("ts") - LEAD).cast("double").alias("t"))


def check_shot_times(shots: DataFrame, lines: DataFrame) -> DataFrame:
    """Reason why a shot cannot be taken at its time, NULL if it can.

    ``shots(shot_id, video_id, page, has_range, t, r0, r1)``; a time must lie within five
    seconds of a transcript time of the same page.
    """
    ends = shots.select(
        "shot_id", "video_id", "page",
        F.explode(F.array(F.col("t"), F.col("r0"), F.col("r1"))).alias("sec"),
    ).filter("sec IS NOT NULL")
    near = near_lines(ends.select("video_id", F.col("page").alias("only_page"), "sec"), lines).filter(
        "page = only_page").select("video_id", "page", "sec").distinct()
    legal = ends.join(near, ["video_id", "page", "sec"]).groupBy("shot_id").agg(
        F.collect_set("sec").alias("legal"))  # at most three seconds per shot
    rows = shots.join(legal, "shot_id", "left").withColumn(
        "legal", F.coalesce("legal", F.array().cast("array<double>")))
    bad_range = F.col("r0").isNull() | F.col("r1").isNull() | (F.col("r0") > F.col("r1"))
    reason = (
        F.when(F.col("has_range") & bad_range, "range_invalid")
        .when(F.col("has_range") & ~(F.array_contains("legal", F.col("r0")) & F.array_contains("legal", F.col("r1"))),
              "range_not_in_transcript")
        .when(~F.col("has_range") & (F.col("t").isNull() | ~F.coalesce(F.array_contains("legal", F.col("t")), F.lit(False))),
              "t_not_in_transcript")
    )
    return rows.withColumn("reason", reason).drop("legal")


def resolve_picks(checked: DataFrame, candidates: DataFrame) -> DataFrame:
    """Fix the time of range shots from ``candidates(video_id, page, label, no, t)``."""
    key = ["video_id", "page", "label"]
    any_cand = candidates.groupBy(*key).agg(F.count("*").alias("_n"))
    chosen = candidates.groupBy(*key, F.col("no").alias("pick")).agg(F.min("t").alias("_t"))
    rows = checked.join(any_cand, key, "left").join(chosen, [*key, "pick"], "left")
    open_range = F.col("has_range") & F.col("reason").isNull()
    reason = F.when(open_range & F.col("_n").isNull(), "no_candidates").when(
        open_range & F.col("pick").isNull(), "need_pick").when(
        open_range & F.col("_t").isNull(), "pick_not_found").otherwise(F.col("reason"))
    fixed = F.col("has_range") & reason.isNull()
    return rows.select(
        "shot_id", *key, reason.alias("reason"),
        F.when(reason.isNull(), F.when(fixed, F.col("_t")).otherwise(F.col("t"))).alias("t"), fixed.alias("fixed"))


def expand_candidate_times(jobs: DataFrame, step: int = 4, count: int = 3) -> DataFrame:
    """Frame times to try for each job ``(job_id, t, fixed, duration)``: never empty."""
    times = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda k: (F.col("t") + k * step).cast("double"))
    fits = F.filter(times, lambda x: (F.coalesce("duration", F.lit(0)) <= 0) | (x < F.col("duration") - 1))
    alone = F.array(F.col("t").cast("double"))
    chosen = F.when(F.col("fixed"), alone).when(F.size(fits) == 0, alone).otherwise(fits)
    return jobs.select("job_id", F.posexplode(chosen).alias("k", "t"))


# Causes for a run without shots, most telling first.
ZERO_SHOT_CAUSES = ("no_transcript", "no_anchor", "need_pick", "t_not_in_transcript", "partial")


def shot_receipts(frames: DataFrame, pages: DataFrame) -> DataFrame:
    """Receipt per video from ``frames(video_id, outcome, qc)`` and ``pages(video_id, page, status)``.

    ``outcome`` is kept, duplicate or failed; the cause is given when nothing was kept.
    """
    counts = frames.groupBy("video_id").agg(
        F.count_if(F.col("outcome") == "kept").alias("frames"),
        F.count_if(F.col("outcome") == "duplicate").alias("duplicates"),
        F.count_if(F.col("outcome") == "failed").alias("failed"),
        F.count_if((F.col("outcome") == "kept") & ~F.col("qc").isin("ok", "skipped")).alias("qc_review"))
    order = F.array(*map(F.lit, ZERO_SHOT_CAUSES))
    rank = F.when(F.array_position(order, F.col("status")) > 0, F.array_position(order, F.col("status")))
    status = pages.groupBy("video_id").agg(
        F.count_if(F.col("status") == "error").alias("error_pages"), F.count("*").alias("_pages"),
        F.min(rank).alias("_cause"))
    rows = status.join(counts, "video_id", "left").fillna(0, ["frames", "duplicates", "failed", "qc_review"])
    cause = F.when(F.col("frames") > 0, F.lit(None)).when(
        F.col("error_pages") == F.col("_pages"), "error").otherwise(
        F.coalesce(F.try_element_at(order, F.col("_cause").cast("int")), F.lit("none")))
    return rows.select("video_id", "frames", (F.col("duplicates") + F.col("failed")).alias("dropped"),
                       "duplicates", "failed", "qc_review", "error_pages", cause.alias("cause"))
