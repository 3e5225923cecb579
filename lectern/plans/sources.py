"""Source parsing queries: JSON and text documents built from the tables, row by row."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lectern.operators import captions, course
from lectern.plans.captions import CHUNK_SQL, sql_strip
from lectern.plans.inputs import frame, stamped_docs, with_inputs
from lectern.plans.registry import Registry
from lectern.session import work_folder
from lectern.sources import readers as rd, writers as wr

REG = Registry()


@REG.query("read_transcripts", with_inputs("stamped_lines") + r"""
    SELECT 'v' || video_id AS video_id, CAST(page AS INT) AS page, line_no, CAST(regexp_extract(line, '^\[(\d{1,3}):(\d{2})\]', 1) AS BIGINT) * 60 + CAST(regexp_extract(line, '^\[(\d{1,3}):(\d{2})\]', 2) AS BIGINT) AS ts_sec,
           regexp_extract(line, '^\[(\d{1,3}):(\d{2})\](.*)', 3) AS text
    FROM stamped_lines WHERE regexp_matches(line, '^\[(\d{1,3}):(\d{2})\]') AND video_id % 5 > 0""")
def _(t):
    files = stamped_docs(t).selectExpr("'file:/x/v' || video_id || '/' || IF(video_id % 5 = 0, 'summary', '0' || page) || '_' || source || '.txt' AS path", "text")
    return captions.parse_ts_lines(rd.transcript_texts(files), "nav")


_META = """SELECT 'p' || page_id AS path, IF(page_id % 9 = 0, '{broken', to_json(named_struct('bvid', IF(page_id % 2 = 0, 'BV' || page_id, NULL), 'video_id', 'y' || page_id, 'platform', IF(page_id % 3 = 0, NULL, 'youtube'),
    'title', url, 'duration', CAST(page_id AS DOUBLE), 'pages', transform(sequence(1, CAST(page_id % 3 + 1 AS INT)), i -> named_struct('page', i, 'part', 'P' || i, 'cid', page_id * 10 + i, 'duration', i * 60, 'asr_lang', 'zh'))))) AS json FROM {pages}"""


@REG.query("read_video_metadata", """
    SELECT CASE WHEN page_id % 2 = 0 THEN 'BV' || page_id ELSE 'y' || page_id END AS video_id, CAST(i AS INT) AS page, 'P' || i AS part, page_id * 10 + i AS cid, CAST(i * 60 AS INT) AS duration, 'zh' AS asr_lang
    FROM pages, (SELECT unnest(range(1, 4)) AS i) WHERE i <= page_id % 3 + 1 AND page_id % 9 > 0""")
def _(t):
    return rd.video_tables(t.sql(_META))[1].select("video_id", "page", "part", "cid", "duration", "asr_lang")


@REG.query("read_videos", """
    SELECT 'p' || page_id AS path, CASE WHEN page_id % 9 = 0 THEN NULL WHEN page_id % 2 = 0 THEN 'BV' || page_id ELSE 'y' || page_id END AS video_id,
           CASE WHEN page_id % 3 = 0 THEN 'bilibili' ELSE 'youtube' END AS platform, CASE WHEN page_id % 9 > 0 THEN url END AS title, CASE WHEN page_id % 9 = 0 THEN '{broken' ELSE '' END AS error FROM pages""")
def _(t):
    return rd.video_tables(t.sql(_META))[0].select("path", "video_id", "platform", "title", "error")


_GLOSS = """SELECT CAST(p_partkey AS INT) AS layer, CASE WHEN p_partkey % 4 < 3 THEN 'g.JSON' ELSE 'g.md' END AS path, CASE p_partkey % 4
    WHEN 0 THEN '{"schema_version":2,"_note":"x","categories":{"' || p_type || '":{"' || p_name || '":{"correct":"' || p_brand || '（x）","hits":' || p_size || ',"disabled":true},"_r":"y","b":"  "},"_c":{"z":"q"}},"candidates":{"C":{"k":"v"}}}'
    WHEN 1 THEN '{"_doc":"n","map":{"' || p_name || '":"' || p_type || '","redis ' || p_size || '":{"correct":"X"}}}'
    WHEN 2 THEN '{"' || p_name || '":"' || p_brand || '","_skip":"1"}'
    ELSE '# head' || chr(10) || '- 错词(对词' || p_size || ')' || chr(10) || 'aa → bb' || chr(10) || '| t |' || chr(10) || 'nothing' END AS text FROM {part}"""


@REG.query("read_glossary", """
    WITH p AS (SELECT *, CAST(p_partkey AS INT) AS layer, p_partkey % 4 AS k FROM part)
    SELECT layer, 'categories' AS area, p_type AS category, p_name AS wrong, p_brand || '（x）' AS correct, p_size AS hits, TRUE AS disabled FROM p WHERE k = 0
    UNION ALL SELECT layer, 'candidates', 'C', 'k', 'v', 0, FALSE FROM p WHERE k = 0
    UNION ALL SELECT layer, 'categories', '通用', p_name, p_type, 0, FALSE FROM p WHERE k = 1
    UNION ALL SELECT layer, 'categories', '编程', 'redis ' || p_size, 'X', 0, FALSE FROM p WHERE k = 1
    UNION ALL SELECT layer, 'categories', '通用', p_name, p_brand, 0, FALSE FROM p WHERE k = 2
    UNION ALL SELECT layer, 'categories', '通用', '错词', '对词' || p_size, 0, FALSE FROM p WHERE k = 3
    UNION ALL SELECT layer, 'categories', '通用', 'aa', 'bb', 0, FALSE FROM p WHERE k = 3""")
def _(t):
    return rd.glossary_entries(t.sql(_GLOSS)).drop("ord", "source")


@REG.query("read_notes", """
    SELECT 'd' || doc_id AS path, CASE WHEN doc_id % 5 = 1 THEN NULL ELSE text END AS text, doc_id % 5 = 1 AS bad FROM documents""")
def _(t):
    files = t.documents.selectExpr("'d' || doc_id AS path", "CASE doc_id % 5 WHEN 1 THEN concat(X'C328', CAST(text AS BINARY)) WHEN 2 THEN concat(X'EFBBBF', CAST(text AS BINARY)) ELSE CAST(text AS BINARY) END AS content")
    return rd.note_texts(files).selectExpr("path", "text", "error <> '' AS bad")


@REG.query("publish_partitions", with_inputs("transcript_lines") + """
    SELECT video_id, page, line_no, CASE WHEN video_id % 3 = 0 THEN 'new ' || text ELSE text END AS text FROM transcript_lines WHERE NOT (video_id % 3 = 0 AND line_no > 1)""")
def _(t):
    root = f"{work_folder(t.spark)}/published-{uuid.uuid4().hex}"
    lines = frame(t, "transcript_lines").select("video_id", "page", "line_no", "text")
    buckets = F.pmod(F.col("video_id"), F.lit(3)).alias("part")
    wr.publish_partitions(lines.select("*", buckets), root, ["part"])
    wr.publish_partitions(lines.filter("video_id % 3 = 0 AND line_no <= 1").withColumn("text", F.concat(F.lit("new "), F.col("text"))).select("*", buckets), root, ["part"])
    return wr.published_partitions(t.spark, root).drop("part")


_COURSE = """SELECT c_custkey AS course_id, to_json(named_struct('version', 1, 'kind', 'pages', 'scope', named_struct('mode', 'range', 'range', '2-' || (c_custkey % 5 + 1)),
    'mastery', map('k' || c_custkey, named_struct('name', c_name, 'mastered', c_custkey % 2 = 0, 'changed_at', '2026')),
    'items', transform(sequence(1, CAST(c_custkey % 3 + 1 AS INT)), i -> named_struct('index', i, 'bvid', 'BV' || c_custkey, 'page', i, 'cid', c_custkey * 10 + i, 'title', 'T' || i, 'duration', CAST(i AS DOUBLE), 'status', 'done')))) AS json FROM {customer}"""


@REG.query("read_course_items", """
    SELECT c_custkey AS course_id, CAST(i AS INT) AS idx, 'BV' || c_custkey AS bvid, CAST(i AS INT) AS page, c_custkey * 10 + i AS cid, 'T' || i AS title, CAST(i AS DOUBLE) AS duration, 'done' AS status
    FROM customer, (SELECT unnest(range(1, 4)) AS i) WHERE i <= c_custkey % 3 + 1""")
def _(t):
    return rd.course_tables(t.sql(_COURSE))["items"].select("course_id", "idx", "bvid", "page", "cid", "title", "duration", "status")


@REG.query("read_course_mastery", "SELECT c_custkey AS course_id, 'k' || c_custkey AS key, c_name AS name, c_custkey % 2 = 0 AS mastered, '2026' AS changed_at FROM customer")
def _(t):
    return rd.course_tables(t.sql(_COURSE))["mastery"]


# Manifests with a history: an item of the past and an earlier state of item 1; fields of other programs are kept.
_STATES = """SELECT c_custkey AS course_id, '{"version":1,"kind":"pages","template":"v4","history":[{"bvid":"OLD","cid":1,"page":1,"status":"done","note":"old.md","pin":{"a":1}},'
    || '{"bvid":"BV' || CAST(c_custkey AS STRING) || '","cid":11,"page":1,"status":"failed","reason":"r","seconds":5,"score":0.5}],"items":['
    || '{"index":1,"bvid":"BV' || CAST(c_custkey AS STRING) || '","cid":11,"page":1,"title":"A","section":"","duration":60,"status":"' || CASE WHEN c_custkey % 3 = 0 THEN 'running' ELSE 'done' END
    || '","note":"a.md","started_at":"2026-01-01T00:00:00+00:00","gate":{"errors":0,"warnings":' || CAST(c_custkey % 4 AS STRING) || ',"sha256":"' || CASE WHEN c_custkey % 2 = 0 THEN 'x' ELSE 'y' END
    || '","template":"v4","checked_at":"t"},"star":true},{"index":2,"bvid":"BV' || CAST(c_custkey AS STRING) || '","cid":12,"page":2,"title":"B","section":"","duration":90,"status":"pending"}]}' AS json FROM {customer}"""
_SQL_STATES = """WITH s AS (
    SELECT c_custkey AS course_id, 'history' AS origin, 0::BIGINT AS ord, NULL::INT AS idx, 'OLD' AS bvid, 1::BIGINT AS cid, 1::INT AS page, 'done' AS status, 'old.md' AS note, NULL::VARCHAR AS started_at, NULL::DOUBLE AS seconds, NULL::VARCHAR AS reason,
           NULL::BIGINT AS gate_warnings, NULL::VARCHAR AS gate_sha, NULL::VARCHAR AS gate_template, 'pin={"a":1}' AS extra FROM customer
    UNION ALL SELECT c_custkey, 'history', 1, NULL, 'BV' || c_custkey, 11, 1, 'failed', NULL, NULL, 5, 'r', NULL, NULL, NULL, 'score=0.5' FROM customer
    UNION ALL SELECT c_custkey, 'items', 4294967296, 1, 'BV' || c_custkey, 11, 1, CASE WHEN c_custkey % 3 = 0 THEN 'running' ELSE 'done' END, 'a.md', '2026-01-01T00:00:00+00:00', NULL, NULL, c_custkey % 4, CASE WHEN c_custkey % 2 = 0 THEN 'x' ELSE 'y' END, 'v4', 'star=true' FROM customer
    UNION ALL SELECT c_custkey, 'items', 4294967297, 2, 'BV' || c_custkey, 12, 2, 'pending', NULL, NULL, NULL, NULL, NULL, NULL, NULL, '' FROM customer)"""


@REG.query("read_item_states", _SQL_STATES + " SELECT * FROM s")
def _(t):
    return rd.item_states(t.sql(_STATES)).select("course_id", "origin", "ord", "idx", "bvid", "cid", "page", "status", "note", "started_at", "seconds", "reason", "gate_warnings",
                                                 "gate_sha", "gate_template", F.array_join(F.transform(F.map_entries("extra"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("extra"))


@REG.query("plan_from_history", _SQL_STATES + """,
    n AS (SELECT c_custkey AS course_id, CAST(i AS INT) AS idx, CASE WHEN i = 3 THEN 'OLD' ELSE 'BV' || c_custkey END AS bvid, CASE WHEN i = 3 THEN 1 ELSE 10 + i END AS cid, CASE WHEN i = 3 THEN 1 ELSE i END::INT AS page FROM customer, (SELECT unnest(range(1, 5)) AS i)),
    l AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY course_id, bvid, cid, page ORDER BY ord DESC) = 1)
    SELECT n.*, coalesce(l.status, 'pending') AS status, l.note, l.gate_sha, l.seconds FROM n LEFT JOIN l USING (course_id, bvid, cid, page)""")
def _(t):
    planned = t.sql("""SELECT c_custkey AS course_id, i AS idx, IF(i = 3, 'OLD', 'BV' || c_custkey) AS bvid, CAST(IF(i = 3, 1, 10 + i) AS BIGINT) AS cid, IF(i = 3, 1, i) AS page, 'pending' AS status
        FROM {customer} LATERAL VIEW explode(sequence(1, 4)) x AS i""")
    return course.merge_item_history(planned, rd.item_states(t.sql(_STATES)).drop("origin", "idx")).select(
        "course_id", "idx", "bvid", "cid", "page", "status", "note", "gate_sha", "seconds")


@REG.query("gate_from_states", _SQL_STATES + """
    SELECT course_id, idx, note AS note_id, gate_sha, gate_template, 'v4' AS template, CASE WHEN course_id % 5 > 0 THEN 'x' END AS sha FROM s
    WHERE origin = 'items' AND status = 'done' AND (course_id % 5 = 0 OR gate_sha <> 'x')""")
def _(t):
    states = rd.item_states(t.sql(_STATES)).filter("origin = 'items' AND status = 'done'")
    done = states.select("course_id", "idx", F.concat_ws("/", F.col("course_id").cast("string"), "note").alias("note_id"), "gate_sha", "gate_template", F.lit("v4").alias("template"))
    notes = t.customer.filter("c_custkey % 5 > 0").selectExpr("c_custkey || '/a.md' AS note_id", "'x' AS sha")
    return course.stale_notes(done, notes).withColumn("note_id", F.substring_index("note_id", "/", -1))


@REG.query("read_shot_lists", """
    SELECT s_suppkey AS video_id, CAST(i AS INT) AS pos, CASE WHEN i = 0 THEN 1 ELSE CAST(i AS INT) END AS page, CASE WHEN i = 1 THEN 's' || s_suppkey || '_a_b-c' ELSE 'Cap' END AS label, 'Cap' AS caption,
           CASE WHEN i = 1 THEN 3723.0 WHEN i = 0 THEN 65.0 END::DOUBLE AS t, i = 2 AS has_range, CASE WHEN i = 2 AND s_suppkey % 2 = 0 THEN 60.0 END::DOUBLE AS r0, CASE WHEN i = 2 AND s_suppkey % 2 = 0 THEN 120.0 END::DOUBLE AS r1,
           CASE WHEN i = 2 THEN 3 END::INT AS pick, CASE WHEN i = 1 THEN s_suppkey END::INT AS section
    FROM supplier, (SELECT unnest(range(0, 3)) AS i)""")
def _(t):
    docs = t.supplier.selectExpr("s_suppkey AS video_id", """'{"shots":[{"caption":" Cap ","t":"01:05","pick":"x"},{"page":1,"section":' || s_suppkey || ',"caption":"Cap","name":"a/b c","t":"1:02:03"},'
        || '{"page":2,"caption":"Cap","range":["' || IF(s_suppkey % 2 = 0, '01:00', '03:00') || '","02:00"],"pick":3,"t":"bad"}]}' AS json""")
    return rd.shot_lists(docs)


@REG.query("read_anchors", "SELECT 'V' || s_suppkey AS video_id, 2 AS page, 0 AS pos, 'L' AS label, s_name AS caption, 'a.b' AS pattern FROM supplier UNION ALL SELECT 'V' || s_suppkey, 2, 0, 'L', s_name, 'c' FROM supplier")
def _(t):
    return rd.anchor_table(t.supplier.selectExpr("""'{"_doc":{"1":[]},"V' || s_suppkey || '":{"2":[["L","' || s_name || '",["a.b","c"]]]}}' AS json"""))


@REG.query("read_frame_manifest", "SELECT s_suppkey AS video_id, 'p1.png' AS file, CAST(s_nationkey AS INT) AS page, s_name AS keyword, CAST(s_suppkey AS DOUBLE) AS t, 'ok' AS qc FROM supplier")
def _(t):
    docs = t.supplier.selectExpr("s_suppkey AS video_id", """'{"frames":[{"file":"p1.png","page":' || s_nationkey || ',"keyword":"' || s_name || '","t":' || s_suppkey || ',"qc":"ok"}],"failed":[]}' AS json""")
    return rd.manifest_frames(docs).select("video_id", "file", "page", "keyword", "t", "qc")


@REG.query("read_link_catalog", "SELECT 'youtube' AS platform, 0 AS pos, url FROM pages UNION ALL SELECT 'douyin', 1, url || '#2' FROM pages WHERE page_id % 2 = 0")
def _(t):
    docs = t.pages.selectExpr("""'{"youtube":["' || url || '",""],"douyin":[{"note":1},' || IF(page_id % 2 = 0, '{"url":"' || url || '#2"}', '{"url":""}') || '],"other":["z"]}' AS json""")
    return rd.link_catalog(docs, ["youtube", "douyin"])


@REG.query("write_chunks", CHUNK_SQL + " SELECT doc_id, chunk_no, CAST(doc_id AS VARCHAR) || '.chunk-' || CASE WHEN chunk_no < 10 THEN '0' ELSE '' END || chunk_no || '.txt' AS file, chars, text FROM chunk_rows")
def _(t):
    return wr.chunk_files(captions.chunk_transcript(t.documents, budget=1500, overlap=2))


@REG.query("write_report_docs", "SELECT o_custkey AS course_id, string_agg('+ ' || o_orderkey || ' ' || o_orderpriority, chr(10) ORDER BY o_orderkey) AS text FROM orders GROUP BY 1")
def _(t):
    lines = t.orders.selectExpr("o_custkey AS course_id", "o_orderkey", "'+ ' || o_orderkey || ' ' || o_orderpriority AS line")
    return wr.report_documents(lines, "course_id", ["o_orderkey"])
