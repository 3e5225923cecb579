"""Course manifest and progress queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import ordered
from lectern.operators import captions, course as op
from lectern.plans.captions import _RESOLVED
from lectern.plans.inputs import COMMON, DUCK, frame, with_inputs
from lectern.plans.registry import Registry

REG = Registry()

_ITEM = """o_custkey AS course_id, idx, 'BV' || CAST(CAST(floor(o_orderkey / 3) AS BIGINT) AS STRING) AS bvid, CAST(o_orderkey % 3 + 1 AS INT) AS page,
    o_orderkey AS cid, CASE WHEN o_orderkey % 6 = 0 THEN '1.2 ' || o_orderpriority WHEN o_orderkey % 6 = 1 THEN 'A:b' ELSE lower(o_orderpriority) END AS title,
    CASE WHEN o_orderkey % 2 = 0 THEN 'S1' ELSE '' END AS section, CAST(floor(o_totalprice / 10) AS DOUBLE) AS duration,
    CASE o_orderkey % 4 WHEN 0 THEN 'has' WHEN 1 THEN 'none' WHEN 2 THEN 'unknown' ELSE 'track_only' END AS subtitle_hint,
    CASE WHEN o_orderkey % 13 = 0 THEN 'failed' WHEN o_orderkey % 17 = 0 THEN 'out_of_scope' WHEN o_orderstatus = 'F' THEN 'done' WHEN o_orderstatus = 'O' THEN 'pending' ELSE 'running' END AS status,
    CAST(CASE WHEN o_orderstatus = 'F' THEN CAST(floor(o_totalprice) AS BIGINT) % 500 END AS BIGINT) AS seconds, o_orderdate AS started_at,
    CAST(NULL AS TIMESTAMP) AS finished_at, 'notes/' || CAST(o_orderkey AS STRING) || ' x.md' AS note, CAST(NULL AS STRING) AS reason"""
DUCK["items"] = f"""SELECT {_ITEM} FROM (SELECT *, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INT) AS idx FROM orders)"""


def items(t):
    numbered = ordered.row_numbers(t.orders, ["o_custkey"], "o_orderkey", "idx", F.floor(F.col("o_orderkey") / 65536))
    return t.sql(f"SELECT {_ITEM} FROM {{numbered}}", numbered=numbered)


_SCOPES = """SELECT c_custkey AS course_id, CASE c_custkey % 5 WHEN 0 THEN 'all' WHEN 1 THEN 'first' WHEN 2 THEN 'range' WHEN 3 THEN 'range' ELSE NULL END AS mode,
    CAST(c_custkey % 7 AS INT) AS first, CAST(2 AS INT) AS lo, CAST(c_custkey % 9 + 1 AS INT) AS hi FROM {customer}"""
IN = with_inputs("items") + f""",
    sc AS ({_SCOPES.replace('{customer}', 'customer')}),
    bd AS (SELECT z.course_id, CASE WHEN mode = 'range' THEN lo ELSE 1 END AS lo, CASE WHEN mode = 'range' THEN hi WHEN mode = 'first' THEN least(first, n) ELSE n END AS hi,
                  coalesce(mode = 'range' AND NOT (lo <= hi AND hi <= n), FALSE) OR coalesce(mode = 'first' AND first < 1, FALSE) AS bad
           FROM (SELECT course_id, max(idx) AS n FROM items GROUP BY 1) z LEFT JOIN sc USING (course_id))"""

_SEASON = """
    SELECT c_custkey AS course_id, transform(sequence(1, CAST(c_custkey % 3 + 1 AS INT)), s -> named_struct('title', 'S' || s, 'episodes',
        transform(sequence(1, CAST((c_custkey + s) % 3 + 1 AS INT)), e -> named_struct('bvid', IF((c_custkey + e) % 11 = 0, NULL, 'BV' || c_custkey || '_' || s || '_' || e),
            'title', 'E' || e, 'duration', CAST(e * 100 AS DOUBLE), 'pages', transform(sequence(1, CAST((c_custkey + e) % 2 + 1 AS INT)), p -> named_struct(
                'page', p, 'cid', IF((c_custkey + s + p) % 13 = 0, CAST(0 AS BIGINT), CAST(c_custkey * 1000 + s * 100 + e * 10 + p AS BIGINT)),
                'part', IF(p = 1, '', 'P' || p), 'duration', CAST(IF((c_custkey + p) % 2 = 0, 0, p * 60) AS DOUBLE))))))) AS sections
    FROM {customer}"""


@REG.query("expand_course_items", """
    WITH x AS (SELECT c_custkey AS c, s, e, p FROM customer, (SELECT unnest(range(1, 4)) AS s), (SELECT unnest(range(1, 4)) AS e), (SELECT unnest(range(1, 3)) AS p)
               WHERE s <= c_custkey % 3 + 1 AND e <= (c_custkey + s) % 3 + 1 AND p <= (c_custkey + e) % 2 + 1),
    y AS (SELECT *, CASE WHEN (c + e) % 11 = 0 THEN NULL ELSE 'BV' || c || '_' || s || '_' || e END AS bvid,
                 CASE WHEN (c + s + p) % 13 = 0 THEN 0 ELSE c * 1000 + s * 100 + e * 10 + p END AS cid FROM x)
    SELECT c AS course_id, CAST(row_number() OVER (PARTITION BY c ORDER BY s, e, p) AS INT) AS idx, bvid, CAST(p AS INT) AS page, cid, CASE WHEN p = 1 THEN 'E' || e ELSE 'P' || p END AS title,
           'S' || s AS section, CAST(CASE WHEN (c + p) % 2 = 1 THEN p * 60 WHEN (c + e) % 2 = 0 THEN e * 100 ELSE 0 END AS DOUBLE) AS duration, 'pending' AS status,
           CASE WHEN bvid IS NULL THEN 'no video id' WHEN cid = 0 THEN 'no cid' ELSE '' END AS error FROM y""")
def _(t):
    return op.expand_course_items(t.sql(_SEASON))


@REG.query("expand_course_pages", """
    SELECT c_custkey AS course_id, CAST(p AS INT) AS idx, 'BV' || c_custkey AS bvid, CAST(p AS INT) AS page, c_custkey * 10 + p AS cid, CASE WHEN p = 1 THEN c_name ELSE 'P' || p END AS title,
           '' AS section, CAST(p * 60 AS DOUBLE) AS duration, 'pending' AS status, '' AS error
    FROM customer, (SELECT unnest(range(1, 5)) AS p) WHERE p <= c_custkey % 4 + 1""")
def _(t):
    pages = t.customer.selectExpr("c_custkey AS course_id", "'BV' || c_custkey AS bvid", "c_name AS title", """transform(sequence(1, CAST(c_custkey % 4 + 1 AS INT)), p ->
        named_struct('page', p, 'cid', CAST(c_custkey * 10 + p AS BIGINT), 'part', IF(p = 1, '', 'P' || p), 'duration', CAST(p * 60 AS DOUBLE))) AS pages""")
    return op.expand_course_items(pages, "pages")


_HISTORY = """SELECT course_id, bvid, cid, page, CASE WHEN k = 0 THEN 'failed' ELSE 'done' END AS status, 'old' || CAST(k AS STRING) AS extra, k AS ord FROM {items}, (VALUES (0), (1)) v(k) WHERE cid % 3 = k"""


@REG.query("merge_item_history", IN + """
    SELECT course_id, bvid, cid, page, idx, title, CASE WHEN cid % 3 = 0 THEN 'failed' WHEN cid % 3 = 1 THEN 'done' ELSE 'pending' END AS status,
           CASE WHEN cid % 3 < 2 THEN 'old' || cid % 3 END AS extra FROM items""")
def _(t):
    it = items(t).select("course_id", "bvid", "cid", "page", "idx", "title")
    history = it.filter("cid % 3 < 2").selectExpr("course_id", "bvid", "cid", "page", "IF(cid % 3 = 0, 'failed', 'done') AS status", "'old' || cid % 3 AS extra", "1 AS ord")
    older = it.filter("cid % 3 < 2").selectExpr("course_id", "bvid", "cid", "page", "'running' AS status", "'older' AS extra", "0 AS ord")
    return op.merge_item_history(it.withColumn("status", F.lit("pending")), history.unionByName(older))


@REG.query("select_scope", IN + " SELECT i.course_id, i.idx, i.cid FROM items i JOIN bd ON bd.course_id = i.course_id AND NOT bad AND idx BETWEEN lo AND hi")
def _(t):
    return op.select_scope(items(t), t.sql(_SCOPES)).select("course_id", "idx", "cid")


@REG.query("scope_bounds", IN + " SELECT course_id, lo, hi, CASE WHEN bad THEN 'invalid scope' ELSE '' END AS error FROM bd")
def _(t):
    return op.scope_bounds(t.sql(_SCOPES), items(t))


@REG.query("apply_scope_state", IN + """
    SELECT i.course_id, i.idx, CASE WHEN NOT (idx BETWEEN lo AND hi) AND status IN ('pending', 'running') THEN 'out_of_scope'
           WHEN idx BETWEEN lo AND hi AND status = 'out_of_scope' THEN 'pending' ELSE status END AS status
    FROM items i LEFT JOIN bd ON bd.course_id = i.course_id AND NOT bad""")
def _(t):
    return op.apply_scope_state(items(t), t.sql(_SCOPES)).select("course_id", "idx", "status")


@REG.query("estimate_effort", IN + """
    SELECT course_id, count(DISTINCT bvid) AS videos, count(*) AS items, count(*) FILTER (subtitle_hint <> 'has') AS asr_items, sum(duration) AS duration, sum(duration) / 3600 AS hours,
           coalesce(sum(duration) FILTER (subtitle_hint <> 'has'), 0) * 0.2::DOUBLE AS asr_seconds, count(*) * 60 AS note_seconds, count(*) * 5 AS fetch_seconds,
           coalesce(sum(duration) FILTER (subtitle_hint <> 'has'), 0) * 0.2::DOUBLE + count(*) * 65 AS total_seconds, count(*) > 200 OR sum(duration) / 3600 > 100 AS oversize
    FROM items GROUP BY 1""")
def _(t):
    return op.estimate_effort(items(t))


@REG.query("remaining_effort", IN + """,
    g AS (SELECT course_id, sum(seconds) FILTER (status = 'done' AND seconds > 0) AS spent, count(*) FILTER (status = 'done' AND seconds > 0) AS d, count(*) FILTER (status IN ('pending', 'running')) AS o,
                 coalesce(sum(duration) FILTER (status IN ('pending', 'running') AND subtitle_hint <> 'has'), 0) AS a FROM items GROUP BY 1)
    SELECT course_id, o AS open, CASE WHEN d > 0 THEN spent / d * o ELSE a * 0.2::DOUBLE + o * 65 END AS remaining_seconds FROM g""")
def _(t):
    return op.remaining_effort(items(t))


_HINT = "CASE WHEN failed > 0 AND succeeded = 0 THEN 'unknown' WHEN kind <> 'none' THEN 'has' WHEN saw_track THEN 'track_only' ELSE 'none' END"


@REG.query("probe_hints", _RESOLVED + f" SELECT video_id, {_HINT} AS subtitle_hint FROM resolved")
def _(t):
    return op.probe_hints(captions.resolve_subtitle_probes(frame(t, "probe_tracks"))).select("video_id", "subtitle_hint")


@REG.query("login_hints", _RESOLVED + f""", h AS (SELECT video_id % 100 AS course_id, {_HINT} AS hint FROM resolved)
    SELECT course_id, count(*) FILTER (hint = 'none') AS "none", count(*) FILTER (hint <> 'unknown') AS known, count(*) FILTER (hint = 'none') * 2 > count(*) FILTER (hint <> 'unknown') AS login_hint FROM h GROUP BY 1""")
def _(t):
    hinted = op.probe_hints(captions.resolve_subtitle_probes(frame(t, "probe_tracks")))
    return op.login_hints(hinted.withColumn("course_id", F.col("video_id") % 100))


@REG.query("course_progress", IN + " SELECT course_id, " + ", ".join(f"count(*) FILTER (status = '{s}') AS {s}" for s in op.STATES) + ", count(*) AS total FROM items GROUP BY 1")
def _(t):
    return op.course_progress(items(t))


@REG.query("course_index_lines", IN + """
    SELECT course_id, section, idx, '| ' || idx || ' | ' || title || ' | ' ||
           CASE WHEN duration >= 3600 THEN CAST(CAST(floor(duration / 3600) AS BIGINT) AS VARCHAR) || ':' ELSE '' END || lpad(CAST(CAST(floor(duration % 3600 / 60) AS BIGINT) AS VARCHAR), 2, '0') || ':' || lpad(CAST(CAST(duration % 60 AS BIGINT) AS VARCHAR), 2, '0')
           || ' | ' || CASE status WHEN 'pending' THEN '待处理' WHEN 'running' THEN '进行中' WHEN 'done' THEN '已完成' WHEN 'failed' THEN '失败' ELSE '未选' END || ' | ' ||
           CASE WHEN status = 'done' THEN '[笔记](' || replace(note, ' ', '%20') || ')' ELSE '' END || ' |' AS line FROM items""")
def _(t):
    return op.course_index_lines(items(t))


_COURSES = """SELECT c_custkey AS course_id, c_name || ' | ' || c_mktsegment AS title, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_mktsegment END AS owner, 'https://s/' || CAST(c_custkey AS STRING) AS source_url,
    CASE WHEN c_custkey % 3 = 0 THEN 'pages' ELSE 'season' END AS kind, '/courses/' || CAST(c_custkey AS STRING) AS root, CASE WHEN c_custkey % 2 = 0 THEN 'a b.md' END AS concepts_file, 'q.md' AS quiz_file,
    CAST(c_custkey % 20 AS BIGINT) AS concepts, CAST(c_custkey % 30 AS BIGINT) AS questions, CAST(c_custkey % 25 AS BIGINT) AS mastered FROM {customer}"""
_LISTED = """SELECT course_id, idx, bvid, page, CASE WHEN cid % 5 = 0 THEN title || ' | x' ELSE title END AS title, CASE WHEN cid % 10 = 1 THEN NULL ELSE section END AS section, duration, status,
    CASE WHEN status IN ('done', 'running') THEN note END AS note, CASE WHEN status = 'failed' THEN 'why' WHEN cid % 3 = 0 THEN 'gate failed: V4-X' END AS reason, 'again' AS next_step,
    CASE WHEN cid % 2 = 0 THEN 'run ' || CAST(idx AS STRING) END AS rerun, cid % 7 > 0 AS chosen FROM {items}"""
_INDEX_TEXT = "replace(replace(coalesce({}, ''), chr(92), chr(92) || chr(92)), '|', chr(92) || '|')"
_LABEL = "CASE WHEN status = 'pending' AND starts_with(coalesce(reason, ''), 'gate failed') THEN '⏳ 待修改' WHEN status = 'done' THEN '✅ 完成' WHEN status = 'failed' THEN '❌ 失败' WHEN status = 'running' THEN '🔄 进行中' ELSE '⏳ 待做' END"
_CLOCK = "CASE WHEN duration >= 3600 THEN CAST(CAST(floor(duration / 3600) AS BIGINT) AS VARCHAR) || ':' ELSE '' END || lpad(CAST(CAST(floor(duration % 3600 / 60) AS BIGINT) AS VARCHAR), 2, '0') || ':' || lpad(CAST(CAST(duration % 60 AS BIGINT) AS VARCHAR), 2, '0')"
_LISTS = ", ".join(f"({p}, {i}, '{x}')" for p, texts in ((0, {4: "", 5: "## 目录", 6: ""}), (2, {0: "", 1: "## 失败与补跑", 2: ""}), (4, {0: "", 1: "## 未选择的集", 2: ""})) for i, x in texts.items())


@REG.query("course_index", IN + f""",
    li AS ({_LISTED.replace('{items}', 'items')}), co AS ({_COURSES.replace('{customer}', 'customer')}),
    he AS (SELECT co.*, z.* EXCLUDE (course_id) FROM co JOIN (SELECT course_id, count(*) AS total, round_even(sum(duration) / 360, 0) / 10 AS hours, count(*) FILTER (chosen) AS n, count(*) FILTER (chosen AND status = 'done') AS done,
            count(*) FILTER (chosen AND status = 'failed') AS failed, count(*) FILTER (chosen AND status = 'pending') AS pending, count(*) FILTER (chosen AND status = 'running') AS running FROM li GROUP BY 1) z USING (course_id)),
    ch AS (SELECT li.*, kind, lag(coalesce(section, '')) OVER (PARTITION BY course_id ORDER BY idx) AS was FROM li JOIN co USING (course_id) WHERE chosen),
    op AS (SELECT * FROM ch WHERE kind = 'season' AND (was IS NULL OR was <> coalesce(section, ''))),
    ln AS (SELECT course_id, 0 AS p, 0 AS i, 0 AS s, '> 课程：' || {_INDEX_TEXT.format('title')} || '（' || CASE kind WHEN 'pages' THEN 'B站' ELSE '合集' END || '，UP主：' || {_INDEX_TEXT.format('owner')} || '）' AS line FROM he
      UNION ALL SELECT course_id, 0, 0, 1, '> 来源：' || source_url FROM he
      UNION ALL SELECT course_id, 0, 0, 2, '> 进度：完成 ' || done || '/' || n || '，失败 ' || failed || '，待做 ' || pending || '，进行中 ' || running || '；总集 ' || total || '，约 ' || CAST(hours AS DECIMAL(18,1)) || ' 小时；更新时间：now' FROM he
      UNION ALL SELECT course_id, 0, 0, 3, '> 复习：[概念表](' || replace(concepts_file, ' ', '%20') || ')（' || concepts || ' 个概念，已掌握 ' || least(mastered, concepts) || '）｜[课程自测](' || quiz_file || ')（' || questions || ' 题）' FROM he WHERE concepts_file IS NOT NULL
      UNION ALL SELECT course_id, x.p, 0, x.s, x.line FROM he, (VALUES {_LISTS}) x(p, s, line)
      UNION ALL SELECT course_id, 0, 0, x.s, x.line FROM he, (VALUES (7, '{op.INDEX_HEADER[0]}'), (8, '{op.INDEX_HEADER[1]}')) x(s, line) WHERE kind = 'pages'
      UNION ALL SELECT course_id, 1, idx, 0, '### ' || CASE WHEN coalesce(section, '') <> '' THEN section ELSE '未分组' END FROM op
      UNION ALL SELECT course_id, 1, idx, x.s, x.line FROM op, (VALUES (1, ''), (2, '{op.INDEX_HEADER[0]}'), (3, '{op.INDEX_HEADER[1]}')) x(s, line)
      UNION ALL SELECT course_id, 1, idx, 4, '| ' || idx || ' | ' || {_INDEX_TEXT.format('title')} || ' | ' || {_CLOCK} || ' | ' || {_LABEL} || ' | ' || CASE WHEN note IS NOT NULL THEN '[笔记](' || replace(note, ' ', '%20') || ')' ELSE '—' END
                || ' | [视频]({op.INDEX_VIDEO}' || bvid || '?p=' || page || ') |' FROM ch
      UNION ALL SELECT course_id, 3, idx, 0, '+ 第 ' || idx || ' 集 ' || {_INDEX_TEXT.format('title')} || '；原因：' || coalesce(reason, '') || '；下一步：' || next_step FROM ch WHERE status = 'failed'
      UNION ALL SELECT course_id, 3, idx, 1, '  补跑：`' || coalesce(rerun, '') || '`' FROM ch WHERE status = 'failed'
      UNION ALL SELECT course_id, 3, 0, 0, '无失败集。' FROM he WHERE failed = 0
      UNION ALL SELECT course_id, 4, 0, 3, '共 ' || total - n || ' 集；可运行 start ' || root || ' --range A-B 选择范围。' FROM he)
    SELECT course_id, row_number() OVER (PARTITION BY course_id ORDER BY p, i, s) AS line_no, line FROM ln""")
def _(t):
    return op.course_index(t.sql(_COURSES), t.sql(_LISTED, items=items(t)), "now")


_DONE = """SELECT course_id, idx, cid AS note_id, CASE WHEN cid % 4 = 0 THEN 'stale' ELSE sha2(note, 256) END AS gate_sha, CASE WHEN cid % 9 = 0 THEN 'v3' ELSE 'v4' END AS gate_template, 'v4' AS template FROM {items} WHERE status = 'done'"""
_CURRENT = "SELECT cid AS note_id, sha2(note, 256) AS sha FROM {items} WHERE cid % 7 > 0"
_STALE = IN + f""",
    dn AS ({_DONE.replace('{items}', 'items').replace('sha2(note, 256)', 'sha256(note)')}), cu AS ({_CURRENT.replace('{items}', 'items').replace('sha2(note, 256)', 'sha256(note)')}),
    st AS (SELECT dn.*, cu.sha FROM dn LEFT JOIN cu USING (note_id) WHERE sha IS NULL OR NOT (sha = gate_sha AND template = gate_template))"""


@REG.query("stale_notes", _STALE + " SELECT * FROM st")
def _(t):
    it = items(t)
    return op.stale_notes(t.sql(_DONE, items=it), t.sql(_CURRENT, items=it))


@REG.query("incremental_gate", _STALE + """
    SELECT course_id, idx, note_id, 'pending' AS status, note_id AS planned_note, CASE WHEN sha IS NULL THEN 'note missing' ELSE 'gate failed: V4-X' END AS reason
    FROM st WHERE sha IS NULL OR note_id % 2 = 1""")
def _(t):
    it = items(t)
    stale = op.stale_notes(t.sql(_DONE, items=it), t.sql(_CURRENT, items=it))
    verdicts = stale.selectExpr("note_id", "CAST(note_id % 2 AS BIGINT) AS errors", "'V4-X' AS first_errors").distinct()
    return op.reopen_items(stale, verdicts)


_EVENTS = """SELECT e.event_id, o.o_custkey AS course_id, i.idx, e.ts, CASE e.event_type WHEN 'view' THEN 'done' WHEN 'click' THEN 'failed' WHEN 'signup' THEN 'pending' WHEN 'purchase' THEN 'done' ELSE 'odd' END AS state,
    CASE WHEN e.event_id % 5 = 0 THEN NULL ELSE 'n' || CAST(e.event_id AS STRING) END AS note, e.event_id % 3 AS gate_errors, CASE WHEN e.event_id % 4 = 0 THEN ' ' ELSE ' why ' || CAST(e.event_id AS STRING) END AS reason
    FROM (SELECT *, event_id % (SELECT max(o_orderkey) + 1 FROM {orders}) AS k FROM {events}) e JOIN {orders} o ON o.o_orderkey = e.k JOIN {items} i ON i.cid = o.o_orderkey"""
_MARKED = IN + f""", ev AS ({_EVENTS.replace('{events}', 'events').replace('{orders}', 'orders').replace('{items}', 'items')}),
    er AS (SELECT *, CASE WHEN state = 'odd' THEN 'unknown state' WHEN state = 'done' AND note IS NULL THEN 'no note' WHEN state = 'done' AND gate_errors > 0 THEN 'gate failed'
                     WHEN state = 'failed' AND trim(reason) = '' THEN 'no reason' END AS error FROM ev)"""


@REG.query("mark_outcome", _MARKED + " SELECT event_id, error FROM er")
def _(t):
    return op.mark_outcome(t.sql(_EVENTS, items=items(t))).select("event_id", "error")


@REG.query("apply_marks", _MARKED + """,
    la AS (SELECT * FROM er WHERE error IS NULL QUALIFY row_number() OVER (PARTITION BY course_id, idx ORDER BY ts DESC, event_id DESC) = 1)
    SELECT i.course_id, i.idx, coalesce(la.state, i.status) AS status,
           CASE WHEN la.state = 'pending' THEN NULL WHEN la.state = 'done' THEN la.note ELSE i.note END AS note,
           CASE WHEN la.state = 'pending' THEN NULL ELSE i.started_at END AS started_at,
           CASE WHEN la.state = 'pending' THEN NULL WHEN la.state IS NOT NULL THEN la.ts ELSE i.finished_at END AS finished_at,
           CASE WHEN la.state = 'pending' THEN NULL WHEN la.state IS NOT NULL THEN greatest(0, CAST(floor(epoch(la.ts)) AS BIGINT) - CAST(floor(epoch(i.started_at)) AS BIGINT)) ELSE i.seconds END AS seconds,
           CASE WHEN la.state = 'failed' THEN trim(la.reason) WHEN la.state IS NOT NULL THEN NULL ELSE i.reason END AS reason
    FROM items i LEFT JOIN la ON la.course_id = i.course_id AND la.idx = i.idx""")
def _(t):
    it = items(t)
    return op.apply_marks(it, t.sql(_EVENTS, items=it))


_RESERVED = """SELECT course_id, CASE WHEN cid % 3 = 0 THEN upper(substring(lpad(CAST(idx AS STRING), 3, '0') || '-' || title, 1, 60)) || '.md' ELSE lpad(CAST(idx AS STRING), 3, '0') || '-' || title || '-' || lpad(CAST(idx AS STRING), 3, '0') || '-1.md' END AS name FROM {items} WHERE cid % 2 = 0"""


@REG.query("assign_unique_names", IN + rf""",
    rs AS (SELECT course_id, lower(name) AS r FROM ({_RESERVED.replace('{items}', 'items')})),
    nm AS (SELECT course_id, idx, lpad(CAST(idx AS VARCHAR), CAST(greatest(3, length(CAST(idx AS VARCHAR))) AS INT), '0') AS i3, trim(replace(title, ':', '_')) AS s FROM items),
    bs AS (SELECT *, CASE WHEN regexp_matches(s, '^(\d+\.\d+)(?:[\s.、_\-]+|$)(.*)') THEN regexp_extract(s, '^(\d+\.\d+)', 1) ELSE i3 END || '-' ||
                  CASE WHEN regexp_matches(s, '^(\d+\.\d+)(?:[\s.、_\-]+|$)(.*)') THEN trim(regexp_extract(s, '^(\d+\.\d+)(?:[\s.、_\-]+|$)(.*)', 2)) ELSE s END || '.md' AS b FROM nm),
    cn AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY course_id, lower(b)) > 1 THEN i3 || '-' || b ELSE b END AS n FROM bs),
    tk AS (SELECT *, EXISTS (SELECT 1 FROM rs WHERE rs.course_id = cn.course_id AND r = lower(n)) AS hit, replace(n, '.md', '') || '-' || i3 AS stem FROM cn)
    SELECT course_id, idx, CASE WHEN NOT hit THEN n ELSE stem || '-' || (SELECT min(k) FROM (SELECT unnest(range(1, 20)) AS k) WHERE NOT EXISTS
        (SELECT 1 FROM rs WHERE rs.course_id = tk.course_id AND r = lower(stem) || '-' || k || '.md')) || '.md' END AS name FROM tk""")
def _(t):
    it = items(t)
    return op.assign_unique_names(it, t.sql(_RESERVED, items=it))


_MANIFEST = """SELECT c_custkey AS course_id, CASE WHEN c_custkey % 31 = 0 THEN 2 ELSE 1 END AS version, CASE c_custkey % 3 WHEN 0 THEN 'pages' WHEN 1 THEN 'season' ELSE CASE WHEN c_custkey % 29 = 0 THEN NULL ELSE 'pages' END END AS kind,
    CASE WHEN c_custkey % 23 = 0 THEN NULL ELSE c_name END AS source_url, CASE WHEN c_custkey % 19 = 0 THEN 'some' ELSE 'all' END AS probe, CASE WHEN c_custkey % 17 = 0 THEN 'v2' ELSE NULL END AS template,
    CASE WHEN c_custkey % 13 = 0 THEN 'fr' ELSE 'zh' END AS asr_lang, CASE WHEN c_custkey % 11 = 0 THEN 'XYZ' ELSE NULL END AS review_digest FROM {customer}"""
_BAD_ITEMS = """SELECT course_id, CASE WHEN cid % 41 = 0 THEN idx + 1 ELSE idx END AS idx, CASE WHEN cid % 37 = 0 THEN '' ELSE bvid END AS bvid, cid, page, CASE WHEN cid % 43 = 0 THEN 'lost' ELSE status END AS status,
    CASE WHEN cid % 47 = 0 THEN -1.0 ELSE duration END AS duration, CASE WHEN cid % 53 = 0 THEN 'bad' END AS gate_sha, 0 AS gate_errors FROM {items}"""


@REG.query("validate_manifests", IN + f""", cs AS ({_MANIFEST.replace('{customer}', 'customer')}), bi AS ({_BAD_ITEMS.replace('{items}', 'items')})
    SELECT course_id, CAST(NULL AS INT) AS idx, unnest(list_filter([CASE WHEN version <> 1 THEN 'version' END, CASE WHEN kind IS NULL THEN 'kind' END, CASE WHEN source_url IS NULL THEN 'source_url' END,
        CASE WHEN probe = 'some' THEN 'probe' END, CASE WHEN template = 'v2' THEN 'template' END, CASE WHEN asr_lang = 'fr' THEN 'asr_lang' END, CASE WHEN review_digest = 'XYZ' THEN 'review_digest' END], lambda x: x IS NOT NULL)) AS "check" FROM cs
    UNION ALL SELECT course_id, idx, unnest(list_filter([CASE WHEN bvid = '' OR cid = 0 THEN 'identity' END, CASE WHEN status = 'lost' THEN 'status' END, CASE WHEN duration < 0 THEN 'duration' END, CASE WHEN gate_sha = 'bad' THEN 'gate' END], lambda x: x IS NOT NULL)) FROM bi
    UNION ALL SELECT course_id, NULL, 'index' FROM bi GROUP BY 1 HAVING count(*) <> count(DISTINCT idx) OR min(idx) <> 1 OR max(idx) <> count(*)
    UNION ALL SELECT course_id, NULL, 'no items' FROM cs WHERE course_id NOT IN (SELECT course_id FROM bi)""")
def _(t):
    return op.validate_manifests(t.sql(_MANIFEST), t.sql(_BAD_ITEMS, items=items(t)))


@REG.query("course_backlog", IN + """,
    b AS (SELECT * FROM items WHERE status IN ('running', 'pending') QUALIFY row_number() OVER (PARTITION BY course_id ORDER BY CASE status WHEN 'running' THEN 0 ELSE 1 END, idx) = 1)
    SELECT course_id, idx, bvid, page, cid, status, EXISTS (SELECT 1 FROM items z WHERE z.bvid = b.bvid AND z.cid % 5 = 0) AS skip_fetch,
           EXISTS (SELECT 1 FROM items z WHERE z.bvid = b.bvid AND z.page = b.page AND z.cid % 4 = 0) AS skip_transcribe FROM b""")
def _(t):
    it = items(t)
    return op.course_backlog(it, it.filter("cid % 5 = 0").select("bvid"), it.filter("cid % 4 = 0").select("bvid", "page"))
