"""Caption and transcript queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions.text import BLANK
from lectern.operators import captions as op
from lectern.plans.inputs import COMMON, doc_lines, frame, rolling_captions, stamped_docs, with_inputs
from lectern.plans.registry import Registry

REG = Registry()


def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{BLANK}+|{BLANK}+$', '', 'g')"


def sql_squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '{BLANK}+', ' ', 'g'))"


def sql_mmss(x: str) -> str:
    m = f"CAST(floor(({x}) / 60) AS BIGINT)"
    return (
        f"(CASE WHEN {m} < 10 THEN '0' ELSE '' END || CAST({m} AS VARCHAR) || ':' || "
        f"lpad(CAST(CAST(floor({x}) AS BIGINT) % 60 AS VARCHAR), 2, '0'))"
    )


def _anchor_sql(pattern: str) -> str:
    return with_inputs("stamped_lines") + f"""
        SELECT video_id, page, line_no,
               CAST(regexp_extract(line, '{pattern}', 1) AS BIGINT) * 60
               + CAST(regexp_extract(line, '{pattern}', 2) AS BIGINT) AS ts_sec,
               regexp_extract(line, '{pattern}', 3) AS text
        FROM stamped_lines WHERE regexp_matches(line, '{pattern}')"""


@REG.query("parse_ts_lines", _anchor_sql(op.MARK_ANCHOR))
def _(t):
    return op.parse_ts_lines(stamped_docs(t))


@REG.query("parse_ts_lines_nav", _anchor_sql(op.MARK_NAV))
def _(t):
    return op.parse_ts_lines(stamped_docs(t), "nav")


@REG.query("parse_ts_lines_inline", with_inputs("stamped_lines") + r""",
    m AS (SELECT video_id, page, line_no, regexp_extract_all(line, '\[\d{1,2}:\d{2}\]') AS a FROM stamped_lines),
    e AS (SELECT video_id, page, line_no, unnest(a) AS mark,
                 CAST(generate_subscripts(a, 1) AS INT) AS mark_no FROM m)
    SELECT video_id, page, line_no, mark_no,
           CAST(regexp_extract(mark, '(\d+):(\d+)', 1) AS BIGINT) * 60
           + CAST(regexp_extract(mark, '(\d+):(\d+)', 2) AS BIGINT) AS ts_sec
    FROM e""")
def _(t):
    return op.parse_ts_lines(stamped_docs(t), "inline")


@REG.query("flatten_json3", with_inputs("doc_lines") + f"""
    SELECT doc_id AS video_id, line_no - 1 AS ord, ((line_no - 1) * 1700) / 1000.0::DOUBLE AS start,
           {sql_strip('line')} AS text
    FROM doc_lines
    WHERE (line_no - 1) % 4 <> 3 AND (line_no - 1) % 6 <> 5 AND {sql_strip('line')} <> ''""")
def _(t):
    raw = t.documents.select(F.col("doc_id").alias("video_id"), F.expr("""
        to_json(named_struct('events', transform(split(text, '\\n', -1), (l, i) -> named_struct(
            'tStartMs', i * 1700,
            'segs', CASE WHEN i % 4 = 3 THEN NULL
                         WHEN i % 6 = 5 THEN array(named_struct('utf8', '\\n'))
                         ELSE array(named_struct('utf8', substring(l, 1, 7)),
                                    named_struct('utf8', CAST(NULL AS STRING)),
                                    named_struct('utf8', substring(l, 8, length(l)))) END))))""").alias("raw"))
    return op.flatten_json3(raw)


@REG.query("flatten_cc_body", with_inputs("doc_lines") + """
    SELECT doc_id AS video_id, line_no - 1 AS ord, (line_no - 1) * 1.5::DOUBLE AS start, line AS text
    FROM doc_lines""")
def _(t):
    raw = t.documents.select(F.col("doc_id").alias("video_id"), F.expr("""
        to_json(named_struct('body', transform(split(text, '\\n', -1), (l, i) ->
            named_struct('from', i * 1.5D, 'content', l))))""").alias("raw"))
    return op.flatten_cc_body(raw)


@REG.query("dedupe_rolling_captions", with_inputs("rolling_captions") + f""",
    s AS (SELECT video_id, ord, start, {sql_squeeze('text')} AS text FROM rolling_captions),
    p AS (SELECT *, lag(text) OVER (PARTITION BY video_id ORDER BY ord) AS before FROM s WHERE text <> ''),
    n AS (SELECT video_id, ord, start,
                 CASE WHEN before IS NOT NULL AND starts_with(text, before)
                      THEN trim(substring(text, length(before) + 1)) ELSE text END AS text, text AS raw, before
          FROM p)
    SELECT video_id, ord, start, text FROM n WHERE text <> '' AND raw IS DISTINCT FROM before""")
def _(t):
    return op.dedupe_rolling_captions(rolling_captions(t))


@REG.query("render_transcript", with_inputs("rolling_captions") + f"""
    SELECT video_id, string_agg('[' || {sql_mmss('start')} || '] ' || {sql_squeeze('text')}, chr(10) ORDER BY ord) AS text
    FROM rolling_captions WHERE {sql_strip('text')} <> '' GROUP BY video_id""")
def _(t):
    return op.render_transcript(rolling_captions(t))


def _track_sql(langs, explicit):
    values = ", ".join(f"({i}, '{x}')" for i, x in enumerate(langs, 1))
    known = "FALSE" if explicit else "audio IS NOT NULL"
    return with_inputs("caption_tracks") + f""",
    pr(i, lang) AS (VALUES {values}),
    audio AS (SELECT video_id, arg_min(lang, ord) AS audio FROM caption_tracks WHERE is_auto GROUP BY 1),
    c AS (SELECT t.video_id, t.lang, t.is_auto, t.ord, a.audio,
                 (SELECT min(i) FROM pr WHERE pr.lang = t.lang) AS ex,
                 (SELECT min(i) FROM pr WHERE split_part(pr.lang, '-', 1) = split_part(t.lang, '-', 1)) AS ba
          FROM caption_tracks t LEFT JOIN audio a ON a.video_id = t.video_id),
    s AS (SELECT *, CASE WHEN {known} AND NOT is_auto AND lang = audio THEN 1
                         WHEN {known} AND NOT is_auto AND ba <= 5 THEN 2
                         WHEN {known} AND is_auto AND lang = audio THEN 3
                         WHEN NOT is_auto AND ba IS NOT NULL THEN 4
                         WHEN ba IS NOT NULL THEN 5 WHEN NOT is_auto THEN 6 ELSE 7 END AS tier
          FROM c),
    r AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY tier,
                 CASE WHEN tier IN (2, 4, 5) THEN CASE WHEN ex IS NULL THEN 1 ELSE 0 END ELSE 0 END,
                 CASE WHEN tier IN (2, 4, 5) THEN coalesce(ex, ba) ELSE 0 END, ord) AS n FROM s)
    SELECT video_id, lang, is_auto FROM r WHERE n = 1"""


@REG.query("pick_caption_track", _track_sql(op.DEFAULT_LANGS, False))
def _(t):
    return op.pick_caption_track(frame(t, "caption_tracks"))


@REG.query("pick_caption_track_listed", _track_sql(("fr", "en-US", "ja"), True))
def _(t):
    return op.pick_caption_track(frame(t, "caption_tracks"), ["fr", "en-US", "ja"])


_FALLBACK_TRACKS = """
    SELECT video_id, ord, is_auto, CASE WHEN ord = 7 THEN 'live_chat'
           WHEN is_auto AND ord % 3 = 1 THEN lang || '-orig' ELSE lang END AS lang
    FROM ({caption_tracks}) c"""


def _fallback_tracks(t):
    return t.sql(_FALLBACK_TRACKS, caption_tracks=frame(t, "caption_tracks"))


def _fallback_languages(t):
    return t.part.selectExpr(
        "CAST(floor(p_partkey / 8) AS BIGINT) AS video_id", "p_partkey", "p_size",
    ).filter("p_partkey % 8 = 0").selectExpr(
        "video_id", "CASE p_size % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'fr' ELSE '' END AS language")


_FALLBACK_SQL = with_inputs("caption_tracks") + """,
    ft AS (""" + _FALLBACK_TRACKS.replace("({caption_tracks}) c", "caption_tracks") + """),
    pr(i, lang) AS (VALUES (1,'zh-Hans'),(2,'zh'),(3,'zh-CN'),(4,'zh-TW'),(5,'zh-HK'),(6,'en'),(7,'en-US'),(8,'en-GB')),
    d AS (SELECT video_id, lang, is_auto, min(ord) AS ord FROM ft WHERE lang <> 'live_chat' GROUP BY ALL),
    m AS (SELECT CAST(floor(p_partkey / 8) AS BIGINT) AS video_id,
                 CASE p_size % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'fr' END AS language FROM part WHERE p_partkey % 8 = 0),
    o AS (SELECT video_id, arg_min(lang, ord) AS orig FROM d WHERE is_auto AND lang LIKE '%-orig' GROUP BY 1),
    a AS (SELECT video_id, orig, coalesce(replace(orig, '-orig', ''), language) AS audio
          FROM m FULL JOIN o USING (video_id)),
    k AS (SELECT d.*, a.orig, a.audio, (SELECT min(i) FROM pr WHERE pr.lang = d.lang) AS ex,
                 (SELECT min(i) FROM pr WHERE split_part(pr.lang, '-', 1) = split_part(d.lang, '-', 1)) AS ba
          FROM d LEFT JOIN a USING (video_id)),
    c AS (SELECT video_id, 1 AS tier, lang, is_auto FROM k WHERE NOT is_auto AND lang = audio
          UNION ALL SELECT video_id, 2, lang, is_auto FROM (SELECT *, row_number() OVER (PARTITION BY video_id
              ORDER BY ex IS NULL, coalesce(ex, ba), ord) AS n FROM k WHERE NOT is_auto AND audio IS NOT NULL AND ba <= 5) WHERE n = 1
          UNION ALL SELECT video_id, 3, lang, is_auto FROM k WHERE is_auto AND lang = coalesce(orig, audio)
          UNION ALL SELECT video_id, CASE WHEN is_auto THEN 5 ELSE 4 END, lang, is_auto FROM (SELECT *, row_number() OVER (
              PARTITION BY video_id, is_auto ORDER BY ba IS NULL, ex IS NULL AND ba IS NOT NULL, coalesce(ex, ba), ord) AS n
              FROM k WHERE ba IS NOT NULL OR NOT is_auto) WHERE n = 1),
    f AS (SELECT video_id, lang, is_auto, min(tier) AS tier FROM c GROUP BY ALL),
    ranked AS (SELECT video_id, CAST(row_number() OVER (PARTITION BY video_id ORDER BY tier) AS INT) AS rank, lang, is_auto FROM f)
"""


@REG.query("rank_fallback_tracks", _FALLBACK_SQL + "SELECT * FROM ranked")
def _(t):
    return op.rank_fallback_tracks(_fallback_tracks(t), languages=_fallback_languages(t))


@REG.query("first_track_with_content", _FALLBACK_SQL + """
    SELECT r.video_id, arg_min(replace(r.lang, '-orig', ''), r.rank) AS lang, arg_min(r.is_auto, r.rank) AS is_auto
    FROM ranked r JOIN ft USING (video_id, lang, is_auto) WHERE ft.ord % 4 <> 0 GROUP BY 1""")
def _(t):
    tracks = _fallback_tracks(t)
    contents = tracks.groupBy("video_id", "lang", "is_auto").agg(F.max(F.col("ord") % 4).alias("segments"))
    return op.first_track_with_content(
        op.rank_fallback_tracks(tracks, languages=_fallback_languages(t)), contents)


@REG.query("pick_subtitle", with_inputs("probe_tracks") + """,
    r AS (SELECT video_id, lan, ai_type <> 0 OR lan LIKE 'ai%' AS is_ai, row_number() OVER (PARTITION BY video_id
            ORDER BY CASE WHEN lan LIKE '%zh%' THEN 0 ELSE 1 END, ai_type <> 0 OR lan LIKE 'ai%', ord, lan, ai_type) AS n
          FROM probe_tracks WHERE lan IS NOT NULL AND has_url)
    SELECT video_id, lan, is_ai FROM r WHERE n = 1""")
def _(t):
    return op.pick_subtitle(frame(t, "probe_tracks").filter("lan IS NOT NULL AND has_url"))


_RESOLVED = with_inputs("probe_tracks", "video_titles") + """,
    att AS (SELECT video_id, attempt, bool_or(ok) AS ok, bool_or(ok AND lan IS NOT NULL) AS tr,
                  bool_or(ok AND lan IS NOT NULL AND has_url AND NOT (ai_type <> 0 OR lan LIKE 'ai%')) AS cc,
                  bool_or(ok AND lan IS NOT NULL AND has_url) AS us
           FROM probe_tracks GROUP BY ALL),
    w AS (SELECT *, min(CASE WHEN cc THEN attempt END) OVER (PARTITION BY video_id) AS stop FROM att),
    resolved AS (SELECT video_id, coalesce(min(stop), min(CASE WHEN us THEN attempt END)) AS attempt,
               CASE WHEN min(stop) IS NOT NULL THEN 'cc' WHEN bool_or(us) THEN 'ai' ELSE 'none' END AS kind,
               bool_or(tr) AS saw_track, count(*) AS attempted,
               count(*) FILTER (ok) AS succeeded, count(*) FILTER (NOT ok) AS failed
        FROM w WHERE stop IS NULL OR attempt <= stop GROUP BY video_id)"""


@REG.query("resolve_subtitle_probes", _RESOLVED + "SELECT * FROM resolved")
def _(t):
    return op.resolve_subtitle_probes(frame(t, "probe_tracks"))


_TOKEN = r"""list_has_any(list_transform(regexp_extract_all(title, '[A-Za-z][A-Za-z0-9]+'),
              lambda x: contains(lower(text), lower(x))), [TRUE])"""
_RELEVANT = f"CASE WHEN len(regexp_extract_all(title, '[A-Za-z][A-Za-z0-9]+')) > 0 THEN {_TOKEN} END"


@REG.query("flag_caption_mismatch", with_inputs("video_titles") + f"""
    SELECT video_id, {_RELEVANT} AS relevant FROM video_titles""")
def _(t):
    return op.flag_caption_mismatch(frame(t, "video_titles"))


@REG.query("classify_subtitle_state", _RESOLVED + f"""
    SELECT r.video_id,
           CASE WHEN kind <> 'none' AND text IS NULL THEN 'error'
                WHEN kind <> 'none' AND {sql_strip('text')} = '' THEN 'api_empty'
                WHEN kind = 'ai' AND {_RELEVANT} = FALSE THEN 'ai_mismatch'
                WHEN kind <> 'none' THEN kind WHEN saw_track THEN 'api_empty' ELSE 'none' END AS subtitle_detail
    FROM resolved r LEFT JOIN (SELECT video_id, title, CASE WHEN video_id % 10 = 9 THEN ' ' ELSE text END AS text
                               FROM video_titles) v ON v.video_id = r.video_id""")
def _(t):
    texts = frame(t, "video_titles").withColumn(
        "text", F.expr("CASE WHEN video_id % 10 = 9 THEN ' ' ELSE text END"))
    return op.classify_subtitle_state(op.resolve_subtitle_probes(frame(t, "probe_tracks")), texts)


def _note_type_sql(course):
    brief = "short" if course else "brief"
    return with_inputs("video_durations") + f"""
    SELECT video_id, CASE WHEN video_id % 2 = 0 THEN 'douyin' ELSE 'bilibili' END AS platform,
           CAST(sum(duration) AS BIGINT) AS seconds, count(*) AS pages,
           CASE WHEN count(*) = 1 AND sum(duration) <= 300 AND video_id % 2 = 0 THEN '{brief}'
                WHEN count(*) = 1 AND sum(duration) <= 600 THEN 'short' ELSE 'lecture' END AS note_type
    FROM video_durations GROUP BY video_id"""


def _note_pages(t):
    return frame(t, "video_durations").withColumn(
        "platform", F.expr("CASE WHEN video_id % 2 = 0 THEN 'douyin' ELSE 'bilibili' END"))


@REG.query("suggest_note_type", _note_type_sql(False))
def _(t):
    return op.suggest_note_type(_note_pages(t), ["douyin", "xiaohongshu"])


@REG.query("suggest_note_type_course", _note_type_sql(True))
def _(t):
    return op.suggest_note_type(_note_pages(t), ["douyin", "xiaohongshu"], course=True)


CHUNK_SQL = with_inputs("doc_lines", recursive=True) + f""",
    p AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS BIGINT) AS i, line,
                 CAST(length(line) AS BIGINT) AS n FROM doc_lines WHERE {sql_strip('line')} <> ''),
    w AS (SELECT *, CAST(sum(n) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) AS cum FROM p),
    r AS (SELECT DISTINCT doc_id, 0::BIGINT AS i, 1::BIGINT AS a, 0::BIGINT AS chars, 1::BIGINT AS no,
                 FALSE AS closed, 0::BIGINT AS ca, 0::BIGINT AS cchars FROM p
          UNION ALL
          SELECT r.doc_id, r.i + 1,
                 CASE WHEN r.chars + w.n >= 1500 THEN greatest(r.a, r.i) ELSE r.a END,
                 CASE WHEN r.chars + w.n >= 1500 THEN w.cum - coalesce(b.cum, 0) ELSE r.chars + w.n END,
                 CASE WHEN r.chars + w.n >= 1500 THEN r.no + 1 ELSE r.no END,
                 r.chars + w.n >= 1500, r.a, r.chars + w.n
          FROM r JOIN w ON w.doc_id = r.doc_id AND w.i = r.i + 1
          LEFT JOIN w b ON b.doc_id = r.doc_id AND b.i = greatest(r.a, r.i) - 1),
    chunks AS (
          SELECT doc_id, no - 1 AS chunk_no, ca AS first_para, i AS last_para, cchars AS chars FROM r WHERE closed
          UNION ALL
          SELECT r.doc_id, no, a, i, chars FROM r JOIN (SELECT doc_id, max(i) AS last FROM p GROUP BY 1) z
          ON z.doc_id = r.doc_id AND z.last = r.i WHERE NOT closed),
    chunk_rows AS (
    SELECT c.doc_id, CAST(chunk_no AS INT) AS chunk_no, CAST(first_para AS INT) AS first_para,
           CAST(last_para AS INT) AS last_para, chars,
           (SELECT string_agg(line, chr(10) ORDER BY i) FROM p WHERE p.doc_id = c.doc_id AND p.i BETWEEN first_para AND last_para) AS text
    FROM chunks c)"""


@REG.query("chunk_transcript", CHUNK_SQL + "SELECT * FROM chunk_rows")
def _(t):
    return op.chunk_transcript(t.documents, budget=1500, overlap=2)


_POINTS = """
    SELECT doc_id, CAST(floor(line_no / 10) AS INT) AS chunk_no, line_no % 10 AS pos,
           CAST((line_no * 7 + doc_id) % 97 AS BIGINT) AS ts_sec, line AS point FROM """


@REG.query("merge_chunk_results", with_inputs("doc_lines") + f""",
    p AS ({_POINTS} doc_lines),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, ts_sec ORDER BY chunk_no, pos) AS n FROM p)
    SELECT doc_id, ts_sec, chunk_no, pos, point FROM r WHERE n = 1""")
def _(t):
    return op.merge_chunk_results(t.sql(_POINTS + "{lines} l", lines=doc_lines(t)))


@REG.query("select_pending_pages", with_inputs("video_pages") + """
    SELECT video_id, page FROM video_pages v
    WHERE NOT (n_chars % 3 <> 0 AND (n_chars % 5 = 0 OR strlen(text) >= 100))""")
def _(t):
    pages = frame(t, "video_pages")
    inventory = pages.filter("n_chars % 3 <> 0").selectExpr(
        "video_id", "page", "octet_length(text) AS bytes", "n_chars % 5 = 0 AS done")
    return op.select_pending_pages(pages, inventory)


@REG.query("resolve_source_language", with_inputs("video_pages") + f"""
    SELECT video_id, page, language, coalesce(n_chars > 600 AND NOT lower(language) LIKE 'zh%', FALSE) AS foreign_lecture
    FROM (SELECT *, coalesce(nullif({sql_strip('asr_lang')}, ''), nullif({sql_strip('audio_lang')}, ''),
                             nullif({sql_strip('subtitle_lang')}, '')) AS language FROM video_pages)""")
def _(t):
    pages = frame(t, "video_pages").withColumn(
        "note_type", F.expr("CASE WHEN n_chars > 600 THEN 'lecture' ELSE 'short' END"))
    return op.resolve_source_language(pages)


@REG.query("transcript_agreement", with_inputs("transcriber_runs") + """,
    pc AS (SELECT file_id, run_no, substring(text, CAST(i AS INT), 3) AS piece, count(*) AS n FROM (SELECT *, unnest(range(1, greatest(length(text) - 2, 1) + 1)) AS i
           FROM transcriber_runs WHERE length(text) > 0) GROUP BY ALL),
    sz AS (SELECT *, CASE WHEN length(text) > 0 THEN greatest(length(text) - 2, 1) ELSE 0 END AS size, min(run_no) OVER (PARTITION BY file_id) AS base_no FROM transcriber_runs),
    cm AS (SELECT a.file_id, a.run_no, sum(least(a.n, b.n)) AS common FROM pc a JOIN pc b ON b.file_id = a.file_id AND b.piece = a.piece
           WHERE b.run_no = (SELECT min(run_no) FROM transcriber_runs r WHERE r.file_id = a.file_id) GROUP BY ALL)
    SELECT sz.file_id, sz.run_no, sz.model, sz.threads, sz.batch, CASE WHEN sz.duration_s > 0 THEN sz.asr_s / sz.duration_s END AS ratio,
           CASE WHEN sz.size + b.size > 0 THEN CAST(2 * coalesce(common, 0) AS DOUBLE) / (sz.size + b.size) ELSE 1.0 END AS similarity
    FROM sz JOIN sz b ON b.file_id = sz.file_id AND b.run_no = sz.base_no LEFT JOIN cm ON cm.file_id = sz.file_id AND cm.run_no = sz.run_no""")
def _(t):
    return op.transcript_agreement(frame(t, "transcriber_runs"))


@REG.query("backend_usage_summary", with_inputs("backend_runs") + """
    SELECT model_used, device_used, batched, count(*) AS runs, count(*) FILTER (status = 'ok') AS ok,
           count(*) FILTER (status = 'error') AS errors, count(fallback_reason) AS fallbacks,
           count(DISTINCT fallback_reason) AS reasons,
           CAST(sum(CAST(round(elapsed_seconds * 10) AS BIGINT)) AS BIGINT) AS tenths
    FROM backend_runs GROUP BY 1, 2, 3""")
def _(t):
    return op.backend_usage_summary(frame(t, "backend_runs"))
