"""Probe, asset and link queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import assets, links, probes
from lectern.operators.markdown import IMAGE
from lectern.plans.inputs import COMMON, frame, with_inputs
from lectern.plans.notes_input import notes
from lectern.plans.registry import Registry

REG = Registry()

COMMON["probe_results"] = """
    SELECT event_id AS probe_id, CASE user_id % 4 WHEN 0 THEN 'bilibili' WHEN 1 THEN 'youtube' WHEN 2 THEN 'douyin' ELSE 'xiaohongshu' END AS platform, ts,
           CASE WHEN event_type = 'error' THEN CASE event_id % 3 WHEN 0 THEN 'RuntimeError: 412' WHEN 1 THEN '链接缺少 xsec_token' ELSE '视频不存在或已删除' || props END ELSE '' END AS error
    FROM {events}"""
_CAT = "CASE WHEN error = '' THEN 'ok' WHEN regexp_matches(error, 'xsec_token|作品不可见|稿件不可见|不存在或已删除|找不到这个内容') THEN 'link' ELSE 'platform' END"
_IN = with_inputs("probe_results") + f", c AS (SELECT *, {_CAT} AS category FROM probe_results)"


@REG.query("classify_failures", _IN + " SELECT * FROM c")
def _(t):
    return probes.classify_failures(frame(t, "probe_results"))


@REG.query("success_rates", _IN + """
    SELECT platform, count(*) AS total, count(*) FILTER (category = 'ok') AS ok, count(*) FILTER (category = 'link') AS link,
           CASE WHEN count(*) > count(*) FILTER (category = 'link') THEN count(*) FILTER (category = 'ok') / (count(*) - count(*) FILTER (category = 'link')) ELSE 0.0 END AS rate
    FROM c GROUP BY GROUPING SETS ((platform), ())""")
def _(t):
    return probes.success_rates(probes.classify_failures(frame(t, "probe_results")))


_FAILURES = """SELECT event_id AS failure_id, CASE WHEN event_id % 2 = 0 THEN 'http' ELSE 'business' END AS source, CASE user_id % 4 WHEN 0 THEN 'bilibili' WHEN 1 THEN 'youtube' WHEN 2 THEN 'other' ELSE 'douyin' END AS platform,
    CAST(CASE WHEN event_id % 2 = 0 THEN CASE event_id % 10 WHEN 0 THEN 403 WHEN 2 THEN 404 WHEN 4 THEN 412 WHEN 6 THEN 500 ELSE 429 END ELSE CASE event_id % 10 WHEN 1 THEN -404 WHEN 3 THEN 62002 WHEN 5 THEN 7 ELSE -101 END END AS INT) AS code FROM {events}"""


def _values(rows, source):
    return ", ".join("('%s', %d, '%s', '%s')" % (source, c, r, n) for c, r, n in rows)


COMMON["probe_runs"] = """
    SELECT CAST(floor(event_id / 500) AS BIGINT) AS run_id, event_id AS pos, CASE user_id % 4 WHEN 0 THEN 'bilibili' WHEN 1 THEN 'youtube' WHEN 2 THEN 'douyin' ELSE 'xiaohongshu' END AS platform,
           CASE WHEN event_type = 'error' THEN CASE event_id % 3 WHEN 0 THEN 'RuntimeError: 412' WHEN 1 THEN '链接缺少 xsec_token' ELSE '视频不存在或已删除' || props END ELSE '' END AS error,
           CAST(floor(value) AS BIGINT) AS seconds, 'https://v/' || CAST(event_id AS STRING) AS url, props || '|x' AS detail
    FROM {events}"""
_PCT = "CAST(round_even(round_even(CASE WHEN total > link THEN ok / (total - link) ELSE 0 END, 3) * 100, 0) AS INT) || '%'"
_REPORT = with_inputs("probe_runs") + f""",
    c AS (SELECT *, {_CAT} AS category FROM probe_runs),
    pe AS (SELECT run_id, platform, count(*) AS total, count(*) FILTER (category = 'ok') AS ok, count(*) FILTER (category = 'link') AS link, min(pos) AS pos FROM c GROUP BY ALL),
    wh AS (SELECT run_id, sum(total)::BIGINT AS total, sum(ok)::BIGINT AS ok, sum(link)::BIGINT AS link FROM pe GROUP BY 1),
    ln AS (SELECT run_id, 0 AS p, 0 AS pos, '**整体成功率 ' || {_PCT} || '**（' || ok || ' / ' || total - link || '，不含链接失效 ' || link || ' 条）' AS line FROM wh
           UNION ALL SELECT run_id, x.p, 0, x.line FROM wh, (VALUES (1, ''), (2, '{probes.REPORT_TABLE[0]}'), (3, '{probes.REPORT_TABLE[1]}'), (5, ''), (6, '{probes.REPORT_DETAIL[0]}'), (7, '{probes.REPORT_DETAIL[1]}')) x(p, line)
           UNION ALL SELECT run_id, 4, pos, '| ' || platform || ' | ' || ok || ' / ' || total - link || ' | ' || {_PCT} || ' | ' || link || ' |' FROM pe
           UNION ALL SELECT run_id, 8, pos, '| ' || platform || ' | ' || CASE category WHEN 'ok' THEN '✅' WHEN 'link' THEN '⚠️ 链接失效' ELSE '❌ 平台故障' END || ' | ' || seconds || ' | ' || url || ' | '
                     || replace(replace(CASE category WHEN 'ok' THEN detail ELSE error END, '|', chr(92) || '|'), chr(10), ' ') || ' |' FROM c
           UNION ALL SELECT run_id, 9, 0, '' FROM wh WHERE link > 0 UNION ALL SELECT run_id, 10, 0, '{probes.REPORT_HINT}' FROM wh WHERE link > 0)
    SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY p, pos) AS line_no, line FROM ln"""


@REG.query("probe_report", _REPORT)
def _(t):
    return probes.probe_report(probes.classify_failures(frame(t, "probe_runs")))


@REG.query("explain_failures", f"""WITH f AS ({_FAILURES.replace('{events}', 'events')}), k(source, code, reason, next_step) AS (VALUES {_values(probes.HTTP_HINTS, 'http')}, {_values(probes.BUSINESS_CODES, 'business')}),
    j AS (SELECT f.*, coalesce(reason, CASE WHEN f.source = 'http' THEN '{probes.HTTP_DEFAULT[0]}' ELSE '{probes.BUSINESS_DEFAULT[0]}' END) AS r,
                 coalesce(next_step, CASE WHEN f.source = 'http' THEN '{probes.HTTP_DEFAULT[1]}' ELSE '{probes.BUSINESS_DEFAULT[1]}' END) AS n FROM f LEFT JOIN k ON k.source = f.source AND k.code = f.code)
    SELECT failure_id, replace(replace(r, '{{p}}', coalesce(platform, 'the platform')), '{{c}}', CAST(code AS VARCHAR)) AS reason, n AS next_step FROM j""")
def _(t):
    return probes.explain_failures(t.sql(_FAILURES))


_LOGS = """SELECT doc_id AS log_id, 'ValueError' AS error_type, CASE WHEN doc_id % 5 = 0 THEN ' ' ELSE text END AS message, CASE WHEN doc_id % 3 = 0 THEN '' ELSE source END AS impact,
    CASE WHEN doc_id % 2 = 0 THEN NULL ELSE 'run ' || CAST(doc_id AS STRING) END AS rerun FROM {documents}"""


@REG.query("failure_records", f"""WITH l AS ({_LOGS.replace('{documents}', 'documents')}),
    r AS (SELECT log_id, error_type, CASE WHEN trim(message) = '' THEN error_type ELSE substring(split_part(trim(message, chr(10) || ' '), chr(10), 1), 1, 200) END AS reason,
                 CASE WHEN impact = '' THEN '{probes.DEFAULT_IMPACT}' ELSE impact END AS impact, '{probes.RETRY_STEP}' || CASE WHEN rerun IS NULL THEN '' ELSE ': ' || rerun END AS next_step, coalesce(rerun, '') AS rerun FROM l)
    SELECT log_id, 'reason: ' || reason || chr(10) || 'impact: ' || impact || chr(10) || 'next: ' || next_step || chr(10) || 'detail: ' || error_type AS error, reason, impact, next_step, rerun FROM r""")
def _(t):
    return probes.failure_records(t.sql(_LOGS))


@REG.query("latest_runs", """
    SELECT event_type AS kind, event_id AS run_id, ts, CAST(row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS INT) AS rank FROM events
    QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 30""")
def _(t):
    return probes.latest_runs(t.events.selectExpr("event_type AS kind", "event_id AS run_id", "ts"), 30)


_FILES = """SELECT page_id, 'v' || CAST(page_id AS STRING) || CASE page_id % 4 WHEN 0 THEN '/a.PNG' WHEN 1 THEN '/b' WHEN 2 THEN '/c.tar.Gz' ELSE '/x.jpg' END AS path, html FROM {pages}"""


@REG.query("content_keys", f"""SELECT path, 'img/' || substring(sha256(html), 1, 16) || lower(regexp_extract(path, '[^/](\\.[^./]*)$', 1)) AS key FROM ({_FILES.replace('{pages}', 'pages')})""")
def _(t):
    return assets.content_keys(t.sql(_FILES).selectExpr("path", "CAST(html AS BINARY) AS content"), "img/")


_REFS = with_inputs("notes") + r""",
    r0 AS (SELECT note_id, text, regexp_extract_all(text, '!\[([^\]]*)\]\(([^)\s]+)\)', 2) AS a FROM notes),
    r1 AS (SELECT note_id, unnest(a) AS path, CAST(generate_subscripts(a, 1) - 1 AS INT) AS pos FROM r0),
    refs AS (SELECT note_id, path, min(pos) AS pos FROM r1 WHERE NOT regexp_matches(path, '^(?:https?:)?//|^data:') GROUP BY ALL)"""


@REG.query("missing_assets", _REFS + " SELECT note_id, pos, path, note_id % 3 > 0 AS found FROM refs")
def _(t):
    n = notes(t)
    have = n.select("note_id", F.explode(F.regexp_extract_all("text", F.lit(IMAGE), F.lit(2))).alias("path")).filter("note_id % 3 > 0")
    return assets.missing_assets(n, have)


@REG.query("rewrite_asset_links", _REFS + r""",
    m AS (SELECT note_id, path, 'https://cdn/' || note_id || '/' || substring(path, 8) AS url FROM refs WHERE note_id % 4 > 0),
    p0 AS (SELECT note_id, regexp_split_to_array(text, '!\[([^\]]*)\]\(([^)\s]+)\)') AS g, regexp_extract_all(text, '!\[([^\]]*)\]\(([^)\s]+)\)') AS x FROM notes),
    p1 AS (SELECT note_id, unnest(g) AS g, unnest(list_append(x, '')) AS x, generate_subscripts(g, 1) AS i FROM p0)
    SELECT p1.note_id, string_agg(g || CASE WHEN m.url IS NOT NULL THEN '![' || regexp_extract(x, '!\[([^\]]*)\]\(([^)\s]+)\)', 1) || '](' || m.url || ')' ELSE x END, '' ORDER BY i) AS text, CAST(count(m.url) AS INT) AS replaced
    FROM p1 LEFT JOIN m ON m.note_id = p1.note_id AND m.path = regexp_extract(x, '!\[([^\]]*)\]\(([^)\s]+)\)', 2) AND x <> '' GROUP BY 1""")
def _(t):
    n = notes(t)
    mapping = n.select("note_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(IMAGE), F.lit(2)))).alias("path")).filter("note_id % 4 > 0")
    return assets.rewrite_asset_links(n, mapping.selectExpr("note_id", "path", "'https://cdn/' || note_id || '/' || substring(path, 8) AS url"))


_MEDIA = """SELECT CAST(floor(l_orderkey / 4) AS BIGINT) AS folder, CASE l_linenumber WHEN 1 THEN '.audio_01.m4s' WHEN 2 THEN 'a.mp4' WHEN 3 THEN 'b.txt.part' WHEN 4 THEN 'c.part' WHEN 5 THEN 'd.m4s.done' WHEN 6 THEN 'x.mkv' ELSE 'note.md' END AS name,
    CAST(floor(l_orderkey / 4) AS BIGINT) * 10 + l_linenumber % 4 AS resolved, l_partkey AS bytes FROM {lineitem}"""
_CANDS = f"""WITH f AS ({_MEDIA.replace('{lineitem}', 'lineitem')}),
    k AS (SELECT * FROM f WHERE (name IN ('.audio_01.m4s', 'c.part') OR (name IN ('a.mp4', 'x.mkv', 'note.md') AND folder % 2 = 0)) AND name <> 'note.md' AND resolved % 7 <> 0),
    c AS (SELECT resolved, min(folder) AS folder, min(name) AS name, max(bytes) AS bytes FROM k GROUP BY 1)"""


def _candidates(t):
    files = t.sql(_MEDIA)
    ref = files.filter("name IN ('a.mp4', 'x.mkv', 'note.md') AND folder % 2 = 0").select("folder", "name")
    return assets.cleanup_candidates(files, ref, files.filter("resolved % 7 = 0").select("resolved"))


@REG.query("cleanup_candidates", _CANDS + " SELECT * FROM c")
def _(t):
    return _candidates(t)


@REG.query("cleanup_totals", _CANDS + " SELECT count(*) AS files, CAST(coalesce(sum(bytes), 0) AS BIGINT) AS bytes FROM c")
def _(t):
    return assets.cleanup_totals(_candidates(t))


@REG.query("scan_unreadable_files", """SELECT 'd' || doc_id AS path, doc_id % 5 = 1 OR doc_id % 5 = 2 AS unreadable FROM documents""")
def _(t):
    body = "CAST(text AS BINARY)"
    files = t.documents.selectExpr("'d' || doc_id AS path", f"""CASE doc_id % 5 WHEN 1 THEN concat(substring({body}, 1, 9), X'00', {body}) WHEN 2 THEN concat(X'C328', {body}, {body})
        WHEN 3 THEN concat(CAST(repeat('a', 4094) AS BINARY), X'E4B8AD', {body}) ELSE {body} END AS content""")
    return assets.scan_unreadable_files(files)


_TEXTS = """SELECT page_id AS text_id, CASE page_id % 8 WHEN 0 THEN '看 https://www.bilibili.com/video/BV1' || lpad(CAST(page_id AS STRING), 9, '0') || '?p=2' WHEN 1 THEN 'https://www.youtube.com/watch?a=1&v=abc-' || lpad(CAST(page_id AS STRING), 7, '_')
    WHEN 2 THEN ' ' || lpad(CAST(page_id AS STRING), 16, '7') || ' ' WHEN 3 THEN 'https://youtu.be/' || lpad(CAST(page_id AS STRING), 11, 'x') WHEN 4 THEN 'https://www.xiaohongshu.com/explore/' || lpad(CAST(page_id AS STRING), 24, 'a') || '?xsec_token=1'
    WHEN 5 THEN 'https://www.douyin.com/video/' || lpad(CAST(page_id AS STRING), 19, '7') WHEN 6 THEN lpad(CAST(page_id AS STRING), 11, 'Q') ELSE url END AS text FROM {pages}"""


@REG.query("extract_video_ids", f"""WITH x AS (SELECT text_id, trim(text) AS t FROM ({_TEXTS.replace('{pages}', 'pages')})),
    y AS (SELECT text_id, CASE WHEN regexp_matches(t, 'BV[0-9A-Za-z]{{10}}') THEN 'bilibili' WHEN regexp_matches(t, '(?:[?&]v=|youtu\\.be/|/shorts/|/live/|/embed/|/v/)[A-Za-z0-9_-]{{11}}') THEN 'youtube'
          WHEN regexp_matches(t, '(?:video/|aweme_id=|/note/)\\d{{15,}}') THEN 'douyin' WHEN regexp_matches(t, 'xiaohongshu\\.com/(?:explore|discovery/item)/[0-9a-f]{{24}}') THEN 'xiaohongshu'
          WHEN regexp_matches(t, '^[A-Za-z0-9_-]{{11}}$') THEN 'youtube' WHEN regexp_matches(t, '^\\d{{15,}}$') THEN 'douyin' END AS platform, t FROM x)
    SELECT text_id, platform, CASE platform WHEN 'bilibili' THEN regexp_extract(t, '(BV[0-9A-Za-z]{{10}})', 1) WHEN 'youtube' THEN coalesce(nullif(regexp_extract(t, '(?:[?&]v=|youtu\\.be/|/shorts/|/live/|/embed/|/v/)([A-Za-z0-9_-]{{11}})', 1), ''), t)
           WHEN 'douyin' THEN regexp_extract(t, '(\\d{{15,}})', 1) ELSE regexp_extract(t, '([0-9a-f]{{24}})', 1) END AS id FROM y WHERE platform IS NOT NULL""")
def _(t):
    return links.extract_video_ids(t.sql(_TEXTS))


_PAGES = """SELECT page_id, 'n' || CAST(page_id AS STRING) AS note_id, CASE page_id % 5 WHEN 4 THEN html ELSE replace(html, '</body>', '<script>window.__INITIAL_STATE__ = ' || CASE page_id % 5
    WHEN 0 THEN '{"a":undefined,"noteData":{"data":{"noteData":{"type":"video","title":"m' || page_id || '"}}}}' WHEN 1 THEN '{"note":{"noteDetailMap":{"zz":{"note":{"type":"normal","title":"z"}},"n' || page_id || '":{"note":{"type":"video","title":"t' || page_id || '"}},"yy":{"note":{"title":"y"}}}}}'
    WHEN 2 THEN '{"note":{"noteDetailMap":{"p":{"note":{"type":"video","title":"first"}},"q":{"note":{"type":"normal","title":"last' || page_id || '"}}}}}' ELSE '{"note":undefined}' END || '</script></body>') END AS html FROM {pages}"""


@REG.query("extract_page_state", """
    SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'video' WHEN 1 THEN 'video' WHEN 2 THEN 'normal' END AS type,
           CASE page_id % 5 WHEN 0 THEN 'm' || page_id WHEN 1 THEN 't' || page_id WHEN 2 THEN 'last' || page_id END AS title FROM pages WHERE page_id % 5 < 4 AND contains(html, '</body>')""")
def _(t):
    return links.extract_page_state(t.sql(_PAGES))


_STREAMS = """SELECT CAST(floor(p_partkey / 6) AS BIGINT) AS video_id, CASE p_size % 4 WHEN 0 THEN 'video' WHEN 1 THEN 'audio' WHEN 2 THEN 'original' ELSE 'stream' END AS kind,
    CASE p_type WHEN 'ECONOMY' THEN 'av1' WHEN 'PROMO' THEN 'h264' WHEN 'LARGE' THEN 'h265' WHEN 'SMALL' THEN 'h264' ELSE 'vp9' END AS codec, p_size AS height, CAST(p_size * 1000 AS INT) AS bandwidth, p_partkey AS stream_id,
    CASE WHEN p_partkey % 7 = 0 THEN '' ELSE p_name END AS url FROM {part}"""


@REG.query("pick_stream_variant", f"""WITH s AS (SELECT *, CASE codec WHEN 'h264' THEN 1 WHEN 'h265' THEN 2 WHEN 'av1' THEN 3 ELSE 0 END AS cr FROM ({_STREAMS.replace('{part}', 'part')}) WHERE url <> ''),
    r AS (SELECT *, CASE WHEN kind = 'original' THEN 'stream' ELSE kind END AS slot FROM s WHERE kind <> 'stream' OR cr > 0),
    n AS (SELECT *, row_number() OVER (PARTITION BY video_id, slot ORDER BY CASE kind WHEN 'original' THEN 99 WHEN 'stream' THEN cr WHEN 'video' THEN -stream_id ELSE 0 END,
              CASE kind WHEN 'stream' THEN -height WHEN 'audio' THEN bandwidth ELSE 0 END, stream_id, url) AS k FROM r)
    SELECT video_id, slot, kind, codec, height, url FROM n WHERE k = 1""")
def _(t):
    return links.pick_stream_variant(t.sql(_STREAMS))


_POSTS = """SELECT l_orderkey * 10 + l_linenumber AS post_id, l_linenumber % 3 AS images, l_partkey % 2 AS play_urls, l_partkey % 3 AS download_urls, CAST(CASE l_suppkey % 9 WHEN 0 THEN 68 WHEN 1 THEN 150 WHEN 2 THEN NULL ELSE 4 END AS INT) AS aweme_type,
    CASE l_suppkey % 8 WHEN 0 THEN 'is_live' WHEN 1 THEN 'was_live' WHEN 2 THEN 'is_upcoming' END AS live_status FROM {lineitem}"""


@REG.query("classify_posts", f"""SELECT post_id, CASE WHEN (images > 0 AND play_urls = 0 AND download_urls = 0) OR coalesce(aweme_type IN (68, 150), FALSE) THEN 'album' ELSE 'video' END AS kind
    FROM ({_POSTS.replace('{lineitem}', 'lineitem')}) WHERE coalesce(live_status NOT IN ('is_live', 'is_upcoming'), TRUE)""")
def _(t):
    return links.classify_posts(t.sql(_POSTS))
