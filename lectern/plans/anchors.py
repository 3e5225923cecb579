"""Time index and anchor queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import anchors as op, timeindex as ti
from lectern.plans.inputs import COMMON, frame, with_inputs
from lectern.plans.registry import Registry

REG = Registry()

COMMON.update({
    # Index entries near (or off) the transcript times of the same video.
    "index_entries": """
        SELECT conv_id * 100 + turn AS entry_id, conv_id AS video_id,
               CAST(turn * 9 + conv_id % 7 + (conv_id * 3 + turn) % 17 - 8 AS INT) AS sec,
               CAST(CASE WHEN turn % 4 = 0 THEN conv_id % 3 + 1 WHEN turn % 7 = 3 THEN 9 END AS INT) AS only_page,
               CASE conv_id % 4 WHEN 0 THEN 'bilibili' WHEN 1 THEN 'youtube' WHEN 2 THEN 'douyin' ELSE '' END AS platform,
               'V' || CAST(conv_id AS STRING) AS vid,
               CASE WHEN turn % 5 = 0 THEN NULL
                    WHEN turn % 5 = 1 THEN 'https://www.youtube.com/watch?v=V' || CAST(conv_id AS STRING) || '&t=' || CAST(turn * 9 + conv_id % 7 AS STRING) || 's'
                    WHEN turn % 5 = 2 THEN 'https://www.bilibili.com/video/V' || CAST(conv_id AS STRING) || '?p=1&t=' || CAST(turn * 9 + conv_id % 7 AS STRING)
                    WHEN turn % 5 = 3 THEN 'https://www.bilibili.com/video/V' || CAST(conv_id AS STRING) || '?p=1&t=3'
                    ELSE 'https://example.com/x' END AS url
        FROM {conversations}""",
    # Two pages per video, so that the lowest page has to win.
    "paged_lines": """
        SELECT conv_id AS video_id, CAST(CASE WHEN turn % 3 = 2 THEN 1 ELSE conv_id % 3 + 1 END AS INT) AS page,
               CAST(turn AS INT) AS line_no, CAST(turn * 9 + conv_id % 7 - (turn % 2) * 4 AS INT) AS ts_sec, text
        FROM {conversations}""",
    # Every third line is written with Chinese characters, to exercise the n-grams.
    "bilingual_lines": """
        SELECT conv_id AS video_id, CAST(conv_id % 3 + 1 AS INT) AS page, CAST(turn AS INT) AS line_no,
               CAST(turn * 9 + conv_id % 7 AS INT) AS ts_sec,
               CASE WHEN turn % 3 = 0 THEN translate(lower(text), 'etaoinshrdlu', '学习视频课程注解编译的')
                    WHEN turn % 3 = 1 THEN replace(text, ' the', ' @th') ELSE text END AS text
        FROM {conversations}""",
    "shots": """
        SELECT conv_id * 100 + turn AS shot_id, conv_id AS video_id, CAST(conv_id % 3 + 1 AS INT) AS page,
               's' || CAST(turn % 3 AS STRING) AS label, turn % 2 = 0 AS has_range,
               CAST(CASE WHEN turn % 2 = 0 OR conv_id % 9 = 0 THEN NULL ELSE turn * 9 + conv_id % 17 END AS DOUBLE) AS t,
               CAST(CASE WHEN turn % 2 = 0 AND conv_id % 8 > 0 THEN turn * 9 + conv_id % 7 + conv_id % 6 END AS DOUBLE) AS r0,
               CAST(CASE WHEN turn % 2 = 0 THEN turn * 9 + conv_id % 19 END AS DOUBLE) AS r1,
               CAST(CASE WHEN conv_id % 5 > 0 THEN conv_id % 5 END AS INT) AS pick
        FROM {conversations}""",
    "shot_candidates": """
        SELECT conv_id AS video_id, CAST(conv_id % 3 + 1 AS INT) AS page, 's' || CAST(turn % 3 AS STRING) AS label,
               CAST(turn % 4 + 1 AS INT) AS no, CAST(length(text) AS DOUBLE) AS t
        FROM {conversations} WHERE turn <> 2""",
})

_LOCATED = """,
    near AS (SELECT e.entry_id, l.page, l.ts_sec, row_number() OVER (PARTITION BY e.entry_id ORDER BY l.page, l.line_no) AS n
             FROM index_entries e JOIN paged_lines l ON l.video_id = e.video_id AND abs(l.ts_sec - e.sec) <= 5
                  AND (e.only_page IS NULL OR e.only_page = l.page)),
    loc AS (SELECT e.*, n.page, n.ts_sec AS rel_sec FROM index_entries e
            LEFT JOIN (SELECT * FROM near WHERE n = 1) n ON n.entry_id = e.entry_id)"""
_IN = with_inputs("index_entries", "paged_lines") + _LOCATED


@REG.query("locate_page", _IN + " SELECT entry_id, page, rel_sec FROM loc")
def _(t):
    return ti.locate_page(frame(t, "index_entries"), frame(t, "paged_lines")).select("entry_id", "page", "rel_sec")


_URL = """CASE WHEN platform = 'douyin' OR page IS NULL THEN NULL
     WHEN platform = 'youtube' THEN 'https://www.youtube.com/watch?v=' || vid || '&t=' || rel_sec || 's'
     ELSE 'https://www.bilibili.com/video/' || vid || '?p=' || page || '&t=' || rel_sec END"""


@REG.query("build_deep_links", _IN + f" SELECT entry_id, page, rel_sec, {_URL} AS url FROM loc")
def _(t):
    return ti.build_deep_links(frame(t, "index_entries").drop("url"), frame(t, "paged_lines")).select(
        "entry_id", "page", "rel_sec", "url")


@REG.query("whitelist_entries", with_inputs("index_entries", "paged_lines") + """
    SELECT entry_id, sec FROM index_entries e WHERE NOT EXISTS (
        SELECT 1 FROM paged_lines l WHERE l.video_id = e.video_id AND abs(l.ts_sec - e.sec) <= 5)""")
def _(t):
    return ti.whitelist_entries(frame(t, "index_entries"), frame(t, "paged_lines")).select("entry_id", "sec")


@REG.query("verify_deep_links", _IN + r""",
    f AS (SELECT *, CASE WHEN platform = 'youtube' OR (platform = '' AND contains(url, 'youtube.com'))
                 THEN regexp_full_match(url, 'https://www\.youtube\.com/watch\?v=' || vid || '&t=\d+s')
                 ELSE regexp_full_match(url, 'https://www\.bilibili\.com/video/' || vid || '\?p=\d+&t=\d+') END AS fine,
                 TRY_CAST(regexp_extract(url, '&t=(\d+)s?$', 1) AS BIGINT) AS link_sec FROM loc WHERE url IS NOT NULL)
    SELECT entry_id, CASE WHEN NOT fine THEN 'format' ELSE 'second' END AS problem, link_sec, rel_sec
    FROM f WHERE NOT fine OR (rel_sec IS NOT NULL AND link_sec <> rel_sec)""")
def _(t):
    return ti.verify_deep_links(frame(t, "index_entries"), frame(t, "paged_lines"))


# Notes of one index entry each, in all three templates; {e} is the entry, {l} what its two open lines become.
def _nav_note(first: str, second: str) -> str:
    return f"""CASE WHEN entry_id % 3 = 0 THEN concat('# t', chr(10), '## 1 视频时间索引', chr(10), {first.format(b="+ ", t="题 a")}, chr(10), '- [', mark, '](http://x) done', chr(10), 'other', chr(10),
             {second.format(b="  * ", t="far (b)")}, chr(10), '## next', chr(10), '+ [', mark, '] outside', chr(10))
        WHEN entry_id % 3 = 1 THEN concat('- [', mark, '] before', chr(10), CASE WHEN entry_id % 11 = 0 THEN '' ELSE '<!-- NAV:BEGIN x -->' END, chr(10), {first.format(b="- ", t="题 a")}, chr(10), '+ [', mark, '] no', chr(10),
             {second.format(b="  - ", t="far (b)")}, chr(10), CASE WHEN entry_id % 7 = 0 OR entry_id % 11 = 0 THEN '' ELSE '<!-- NAV:END -->' END)
        ELSE concat('---', chr(10), '## 视频时间索引', chr(10), '- [', mark, '] front', chr(10), '---', chr(10), '## 视频时间索引', chr(10), {first.format(b="- ", t="题 a")}, chr(10), {second.format(b="+ ", t="far (b)")}) END"""


_PLAIN = _nav_note("concat('{b}[', mark, '] {t}')", "concat('{b}[', mark, '] {t}')")
_MARK = "concat(lpad(CAST(CAST(floor(sec / 60) AS INT) AS STRING), 2, '0'), ':', lpad(CAST(CAST(sec AS INT) % 60 AS STRING), 2, '0'))"
_NAV = _IN + f""",
    en AS (SELECT * EXCLUDE (url), {_MARK} AS mark, {_URL} AS url, CASE WHEN entry_id % 3 <> 1 THEN 'ok' WHEN entry_id % 11 = 0 THEN 'skipped' WHEN entry_id % 7 = 0 THEN 'error' ELSE 'ok' END AS status FROM loc WHERE sec BETWEEN 0 AND 5999),
    fl AS (SELECT *, url IS NOT NULL AND status = 'ok' AS hit FROM en)
    SELECT entry_id AS note_id, CASE WHEN hit THEN {_nav_note("concat('{b}[', mark, '](', url, ') {t}')", "concat('{b}[', mark, '](', url, ') {t}')")} ELSE {_PLAIN} END AS text, status,
           CAST(CASE WHEN hit THEN 2 ELSE 0 END AS BIGINT) AS written, CAST(CASE WHEN status = 'ok' AND url IS NULL AND platform <> 'douyin' THEN 2 ELSE 0 END AS BIGINT) AS skipped FROM fl"""


def _nav_notes(t):
    return frame(t, "index_entries").filter("sec BETWEEN 0 AND 5999").withColumn("mark", F.expr(_MARK)).selectExpr(
        "entry_id AS note_id", f"{_PLAIN} AS text", "CASE entry_id % 3 WHEN 0 THEN 'v4' WHEN 1 THEN 'v3' ELSE 'v4-obsidian' END AS kind",
        "video_id", "platform", "vid", "only_page")


@REG.query("fill_nav_links", _NAV)
def _(t):
    return ti.fill_nav_links(_nav_notes(t), frame(t, "paged_lines"))


@REG.query("fill_nav_links_twice", _NAV.rsplit("SELECT entry_id AS note_id", 1)[0] + "SELECT entry_id AS note_id," + _NAV.rsplit("SELECT entry_id AS note_id,", 1)[1].split(" AS text, status", 1)[0]
           + " AS text, status, CAST(0 AS BIGINT) AS written, CAST(CASE WHEN status = 'ok' AND url IS NULL AND platform <> 'douyin' THEN 2 ELSE 0 END AS BIGINT) AS skipped FROM fl")
def _(t):
    notes = _nav_notes(t)
    once = ti.fill_nav_links(notes, frame(t, "paged_lines")).select("note_id", "text")
    return ti.fill_nav_links(once.join(notes.drop("text"), "note_id"), frame(t, "paged_lines"))


_TERMS = with_inputs("bilingual_lines") + r""",
    lat AS (SELECT video_id, page, line_no, ts_sec, unnest(regexp_extract_all(text, '@[A-Za-z][\p{L}\p{N}_]+|[A-Za-z][A-Za-z0-9_]{3,}')) AS tok, FALSE AS is_zh FROM bilingual_lines),
    run AS (SELECT video_id, page, line_no, ts_sec, unnest(regexp_extract_all(text, '[\x{4e00}-\x{9fff}]{2,8}')) AS r FROM bilingual_lines),
    gram AS (SELECT video_id, page, line_no, ts_sec, substring(r, i, n) AS tok, TRUE AS is_zh
             FROM run, (VALUES (2), (3), (4)) w(n), (SELECT unnest(range(1, 8)) AS i) WHERE i + n - 1 <= length(r)),
    tokens AS (SELECT * FROM lat UNION ALL SELECT * FROM gram),
    terms AS (SELECT video_id, page, tok, is_zh, count(*) AS cnt, arg_min(ts_sec, line_no) AS first_ts FROM tokens GROUP BY ALL)"""
_STOP = ", ".join(f"'{w}'" for w in op.STOP_WORDS)
_BAD = "[" + op.STOP_CHARS + "]|" + "|".join(op.STOP_PIECES)
_GOOD = _TERMS + f""",
    good AS (SELECT * FROM terms WHERE CASE WHEN is_zh THEN cnt >= 2 AND NOT regexp_matches(tok, '{_BAD}')
                                      ELSE ltrim(lower(tok), '@') NOT IN ({_STOP}) END)"""
_RANKED = _GOOD + """,
    sc AS (SELECT *, CAST(cnt * length(tok) * CASE WHEN is_zh THEN 1.0 ELSE 1.5 END AS DOUBLE) AS score FROM good),
    ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY video_id, page ORDER BY score DESC, length(tok) DESC, tok) AS INT) AS rank FROM sc)"""


@REG.query("mine_terms", _TERMS + " SELECT * FROM terms")
def _(t):
    return op.mine_terms(frame(t, "bilingual_lines"))


@REG.query("filter_stop_terms", _GOOD + " SELECT * FROM good")
def _(t):
    return op.filter_stop_terms(op.mine_terms(frame(t, "bilingual_lines")))


@REG.query("rank_terms", _RANKED + " SELECT * FROM ranked")
def _(t):
    return op.rank_terms(op.filter_stop_terms(op.mine_terms(frame(t, "bilingual_lines"))))


def _free(prev: str) -> str:
    return f"""SELECT c.*, row_number() OVER (PARTITION BY c.video_id, c.page ORDER BY c.rank) AS n FROM c
        WHERE EXISTS (SELECT 1 FROM {prev} k WHERE k.video_id = c.video_id AND k.page = c.page)
          AND NOT EXISTS (SELECT 1 FROM {prev} k WHERE k.video_id = c.video_id AND k.page = c.page
                          AND (contains(k.tok, c.tok) OR abs(k.t - c.t) < 15))"""


@REG.query("pick_diverse_anchors", _RANKED + f""",
    c AS (SELECT * FROM (SELECT *, CAST(greatest(2, first_ts - 3) AS DOUBLE) AS t,
             CASE WHEN is_zh THEN tok ELSE trim(regexp_replace(lower(ltrim(tok, '@')), '[^\\p{{L}}\\p{{N}}_]+', '-', 'g'), '-') END AS label
             FROM ranked) WHERE label <> ''),
    k1 AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY video_id, page ORDER BY rank) = 1),
    k2 AS (SELECT * EXCLUDE n FROM ({_free('k1')}) WHERE n = 1),
    k12 AS (SELECT * FROM k1 UNION ALL SELECT * FROM k2),
    k3 AS (SELECT * EXCLUDE n FROM ({_free('k12')}) WHERE n = 1),
    k AS (SELECT 1 AS no, * FROM k1 UNION ALL SELECT 2, * FROM k2 UNION ALL SELECT 3, * FROM k3)
    SELECT video_id, page, CAST(no AS INT) AS no, label, tok AS keyword,
           CASE WHEN is_zh THEN '关键词“' || tok || '”出现的画面' ELSE '关键词「' || tok || '」出现的画面' END AS caption, t FROM k""")
def _(t):
    return op.pick_diverse_anchors(op.filter_stop_terms(op.mine_terms(frame(t, "bilingual_lines"))))


_PATTERNS = """
    SELECT conv_id AS video_id, CAST(conv_id % 3 + 1 AS INT) AS page, 'p' || CAST(turn % 2 AS STRING) AS label,
           CASE turn WHEN 0 THEN 'tion' WHEN 1 THEN '[Tt]he\\\\b' WHEN 2 THEN 'qu(e|oi)' ELSE '^Z' END AS pattern
    FROM {conversations} WHERE turn < 4"""


@REG.query("match_anchor_patterns", with_inputs("transcript_lines") + f""",
    a AS ({_PATTERNS.replace('{conversations}', 'conversations').replace(chr(92) * 4, chr(92))})
    SELECT l.video_id, l.page, label, CAST(greatest(2, arg_min(ts_sec, line_no) - 3) AS DOUBLE) AS t
    FROM transcript_lines l JOIN a ON a.video_id = l.video_id AND a.page = l.page
    WHERE CASE a.pattern WHEN 'tion' THEN regexp_matches(text, 'tion') WHEN '^Z' THEN regexp_matches(text, '^Z')
          WHEN 'qu(e|oi)' THEN regexp_matches(text, 'qu(e|oi)') ELSE regexp_matches(text, '[Tt]he\\b') END GROUP BY ALL""")
def _(t):
    return op.match_anchor_patterns(frame(t, "transcript_lines"), t.sql(_PATTERNS))


_CHECKED = with_inputs("shots", "transcript_lines", "shot_candidates") + """,
    near AS (SELECT s.shot_id,
               EXISTS (SELECT 1 FROM transcript_lines l WHERE l.video_id = s.video_id AND l.page = s.page AND abs(l.ts_sec - s.t) <= 5) AS tn,
               EXISTS (SELECT 1 FROM transcript_lines l WHERE l.video_id = s.video_id AND l.page = s.page AND abs(l.ts_sec - s.r0) <= 5) AS an,
               EXISTS (SELECT 1 FROM transcript_lines l WHERE l.video_id = s.video_id AND l.page = s.page AND abs(l.ts_sec - s.r1) <= 5) AS bn
             FROM shots s),
    checked AS (SELECT s.*, CASE WHEN has_range AND (r0 IS NULL OR r1 IS NULL OR r0 > r1) THEN 'range_invalid'
                          WHEN has_range AND NOT (an AND bn) THEN 'range_not_in_transcript'
                          WHEN NOT has_range AND NOT tn THEN 't_not_in_transcript' END AS reason
                FROM shots s JOIN near USING (shot_id)),
    picked AS (SELECT c.*, x.n, y.t AS pt FROM checked c
               LEFT JOIN (SELECT video_id, page, label, count(*) AS n FROM shot_candidates GROUP BY ALL) x USING (video_id, page, label)
               LEFT JOIN (SELECT video_id, page, label, no AS pick, min(t) AS t FROM shot_candidates GROUP BY ALL) y USING (video_id, page, label, pick)),
    resolved AS (SELECT *, CASE WHEN reason IS NOT NULL OR NOT has_range THEN reason WHEN n IS NULL THEN 'no_candidates'
                         WHEN pick IS NULL THEN 'need_pick' WHEN pt IS NULL THEN 'pick_not_found' END AS why FROM picked)"""


@REG.query("check_shot_times", _CHECKED + " SELECT * FROM checked")
def _(t):
    return op.check_shot_times(frame(t, "shots"), frame(t, "transcript_lines"))


@REG.query("resolve_picks", _CHECKED + """
    SELECT shot_id, video_id, page, label, why AS reason, CASE WHEN why IS NULL THEN CASE WHEN has_range THEN pt ELSE t END END AS t,
           has_range AND why IS NULL AS fixed FROM resolved""")
def _(t):
    checked = op.check_shot_times(frame(t, "shots"), frame(t, "transcript_lines"))
    return op.resolve_picks(checked, frame(t, "shot_candidates"))


@REG.query("expand_candidate_times", """
    SELECT o_orderkey AS job_id, CAST(k AS INT) AS k, o_custkey % 100 + 4.0::DOUBLE * k AS t
    FROM orders, (VALUES (0), (1), (2)) v(k)
    WHERE CASE WHEN o_orderkey % 7 = 0 THEN k = 0
               WHEN o_custkey % 100 >= (o_orderkey % 90) - 1 AND o_orderkey % 90 > 0 THEN k = 0
               ELSE o_orderkey % 90 = 0 OR o_custkey % 100 + 4 * k < (o_orderkey % 90) - 1 END""")
def _(t):
    jobs = t.orders.selectExpr("o_orderkey AS job_id", "CAST(o_custkey % 100 AS DOUBLE) AS t",
                               "o_orderkey % 7 = 0 AS fixed", "CAST(o_orderkey % 90 AS DOUBLE) AS duration")
    return op.expand_candidate_times(jobs)


_FRAMES = """
    SELECT o_custkey AS video_id, CASE WHEN o_orderkey % 4 = 0 AND o_custkey % 3 > 0 THEN 'kept' WHEN o_orderkey % 4 = 1 THEN 'duplicate' ELSE 'failed' END AS outcome,
           CASE o_orderkey % 3 WHEN 0 THEN 'ok' WHEN 1 THEN 'dark' ELSE 'blurry' END AS qc FROM {orders} WHERE o_orderkey % 3 < 2"""
_PAGES = """
    SELECT o_custkey AS video_id, o_orderkey AS page, CASE WHEN o_custkey % 10 = 0 THEN 'error'
           WHEN o_orderstatus = 'F' THEN 'no_anchor' WHEN o_orderstatus = 'O' THEN 'partial' WHEN o_orderkey % 5 = 0 THEN 'need_pick' ELSE 'ok' END AS status
    FROM {orders}"""


@REG.query("shot_receipts", f"""WITH f AS ({_FRAMES.replace('{orders}', 'orders')}), p AS ({_PAGES.replace('{orders}', 'orders')}),
    c AS (SELECT video_id, count(*) FILTER (outcome = 'kept') AS frames, count(*) FILTER (outcome = 'duplicate') AS duplicates,
                 count(*) FILTER (outcome = 'failed') AS failed, count(*) FILTER (outcome = 'kept' AND qc <> 'ok') AS qc_review FROM f GROUP BY 1),
    s AS (SELECT video_id, count(*) FILTER (status = 'error') AS error_pages, count(*) AS pages,
                 bool_or(status = 'no_anchor') AS na, bool_or(status = 'need_pick') AS np, bool_or(status = 'partial') AS pa FROM p GROUP BY 1)
    SELECT video_id, coalesce(frames, 0) AS frames, coalesce(duplicates, 0) + coalesce(failed, 0) AS dropped,
           coalesce(duplicates, 0) AS duplicates, coalesce(failed, 0) AS failed, coalesce(qc_review, 0) AS qc_review, error_pages,
           CASE WHEN coalesce(frames, 0) > 0 THEN NULL WHEN error_pages = pages THEN 'error' WHEN na THEN 'no_anchor'
                WHEN np THEN 'need_pick' WHEN pa THEN 'partial' ELSE 'none' END AS cause
    FROM s LEFT JOIN c USING (video_id)""")
def _(t):
    return op.shot_receipts(t.sql(_FRAMES), t.sql(_PAGES))
