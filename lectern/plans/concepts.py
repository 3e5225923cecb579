"""Course concept model queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions.ordered import sorted_numbers
from lectern.operators import concepts as op, markdown as md, review
from lectern.plans.inputs import COMMON, frame, with_inputs
from lectern.plans.markdown import BASE, CARDS, NAV, QUIZ
from lectern.plans.notes_input import notes
from lectern.plans.registry import Registry

REG = Registry()

_CARD = "CAST(l_partkey * 10000000 + l_orderkey * 10 + l_linenumber AS BIGINT)"
_FROM = "FROM {lineitem} JOIN {part} ON p_partkey = l_partkey"
COMMON.update({
    "cards": f"""
        SELECT l_suppkey % 10 AS course_id, CAST(l_suppkey AS INT) AS idx, {_CARD} AS card_no,
               CASE l_linenumber % 3 WHEN 0 THEN upper(p_type) || ' ' || CAST(p_size AS STRING) WHEN 1 THEN p_type || '  ' || lower(CAST(p_size AS STRING))
                    ELSE '概念 ' || CAST(p_size AS STRING) END AS name,
               CASE WHEN l_partkey % 9 = 0 THEN '' ELSE ' ' || p_name || ' ' || CAST(l_partkey % 3 AS STRING) END AS definition,
               CASE WHEN l_partkey % 4 = 0 THEN '' WHEN l_partkey % 4 = 1 THEN p_type || 's' WHEN l_partkey % 4 = 2 THEN lower(p_type) ELSE p_brand END AS original
        {_FROM}""",
    "card_refs": f"""
        SELECT l_suppkey % 10 AS course_id, CAST(l_suppkey AS INT) AS idx, {_CARD} AS card_no, 'depends' AS field, 0 AS pos,
               p_type || ' ' || CAST(p_size % 53 + 1 AS STRING) AS ref {_FROM}
        UNION ALL
        SELECT l_suppkey % 10, CAST(l_suppkey AS INT), {_CARD}, 'confusable', 0, '概念 ' || CAST(p_size + 4 AS STRING) || '、' || lower(p_brand) || '——why' {_FROM}
        WHERE l_linenumber = 2""",
    "card_appears": f"""
        SELECT l_suppkey % 10 AS course_id, CAST(l_suppkey AS INT) AS idx, {_CARD} AS card_no, CAST(0 AS INT) AS pos,
               l_linenumber AS section, 'part ' || CAST(l_linenumber AS STRING) AS section_name
        {_FROM} WHERE l_linenumber < 6""",
    "course_nav": """
        SELECT s_suppkey % 10 AS course_id, CAST(s_suppkey AS INT) AS idx, CAST(k AS INT) AS section, '0' || CAST(k AS STRING) || ':00' AS time,
               CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE 'https://v/' || CAST(s_suppkey AS STRING) || '?t=' || CAST(k * 60 AS STRING) END AS url
        FROM {supplier}, (VALUES (1), (2), (3), (4)) v(k)""",
    "course_questions": """
        SELECT l_suppkey % 10 AS course_id, CAST(l_suppkey AS INT) AS idx, l_orderkey * 10 + l_linenumber AS no,
               'why ' || CAST(l_partkey AS STRING) AS stem,
               CASE WHEN l_partkey % 7 = 0 THEN NULL ELSE p_type || CAST(p_size + l_partkey % 2 * 10 AS STRING) END AS correspond,
               p_name AS answer
        FROM {lineitem} JOIN {part} ON p_partkey = l_partkey WHERE l_linenumber = 1""",
    "review_items": """
        SELECT s_suppkey % 10 AS course_id, CAST(s_suppkey AS INT) AS idx, CASE WHEN s_suppkey % 17 = 3 THEN 'no card section' ELSE '' END AS parse_error,
               s_suppkey % 19 <> 4 AS note_exists, s_suppkey % 50 = 7 AS stale, 'notes/' || CAST(s_suppkey AS STRING) || '.md' AS note,
               s_name AS title, CAST(s_acctbal AS STRING) AS sha, 'course ' || CAST(s_suppkey % 10 AS STRING) AS course_title
        FROM {supplier}""",
})
_KEY = "lower(regexp_replace({}, '\\s+', '', 'g'))"

MODEL = with_inputs("cards", "card_refs", "card_appears", "course_nav", "course_questions", "review_items") + f""",
    ck AS (SELECT *, {_KEY.format('name')} AS key, trim(definition) AS def FROM cards),
    con AS (SELECT course_id, key, arg_min(name, (idx, card_no)) AS name, arg_min(def, (idx, card_no)) AS definition, min(idx) AS first_idx,
                   arg_min(card_no, (idx, card_no)) AS first_card, count(*) AS cards, max(idx) <> min(idx) AS multi_item
            FROM ck GROUP BY 1, 2),
    app AS (SELECT ck.course_id, ck.key, ck.idx, ck.card_no, a.pos, a.section, a.section_name, n.time, n.url FROM ck
            LEFT JOIN card_appears a ON a.course_id = ck.course_id AND a.idx = ck.idx AND a.card_no = ck.card_no
            LEFT JOIN course_nav n ON n.course_id = ck.course_id AND n.idx = ck.idx AND n.section = a.section),
    ori AS (SELECT course_id, key, trim(original) AS value, count(*) AS n, min(idx * 1000000000000000::HUGEINT + card_no) AS o, lower(trim(original)) AS folded,
                   regexp_replace(lower(trim(original)), 's$', '') AS grp FROM ck WHERE trim(original) <> '' GROUP BY ALL),
    fa AS (SELECT course_id, key, idx, arg_min(coalesce(time, ''), (section IS NULL, section, card_no, pos)) AS time, arg_min(coalesce(url, ''), (section IS NULL, section, card_no, pos)) AS url FROM app GROUP BY ALL),
    qk AS (SELECT q.*, {_KEY.format("coalesce(correspond, '')")} AS k FROM course_questions q),
    qs AS (SELECT q.course_id, q.idx, q.no, stem, correspond, answer, c.key AS concept, CASE WHEN fa.time <> '' THEN fa.time END AS time,
                  CASE WHEN fa.time <> '' THEN nullif(fa.url, '') END AS url FROM qk q LEFT JOIN con c ON c.course_id = q.course_id AND c.key = q.k
           LEFT JOIN fa ON fa.course_id = q.course_id AND fa.key = q.k AND fa.idx = q.idx),
    rf AS (SELECT r.course_id, ck.key, r.field, {_KEY.format('r.ref')} AS ref_key, arg_min(r.ref, (r.idx, r.card_no, r.pos)) AS ref FROM card_refs r
           JOIN ck ON ck.course_id = r.course_id AND ck.idx = r.idx AND ck.card_no = r.card_no GROUP BY ALL),
    marks AS (SELECT course_id, key, length(key) % 3 = 0 AS mastered FROM con)"""


def _cards(t):
    return frame(t, "cards")


def _nav(t):
    return t.supplier.selectExpr("s_suppkey", "explode(array(1, 2, 3, 4)) AS section").selectExpr(
        "s_suppkey % 10 AS course_id", "CAST(s_suppkey AS INT) AS idx", "section", "'0' || section || ':00' AS time",
        "CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE 'https://v/' || s_suppkey || '?t=' || section * 60 END AS url")


def _apps(t):
    return op.concept_appearances(_cards(t), frame(t, "card_appears"), _nav(t))


def _questions(t):
    return op.attribute_questions(frame(t, "course_questions"), _apps(t))


def _model(t):
    return review.course_model(_cards(t), frame(t, "card_refs"), frame(t, "card_appears"), _nav(t), frame(t, "course_questions"))


def _model_marks(model):
    return model.concepts.selectExpr("course_id", "key", "length(key) % 3 = 0 AS mastered")


# Concepts in course order: item, section (none last) and card of the first appearance.
PLACED = MODEL + """,
    fs AS (SELECT app.course_id, app.key, min(coalesce(section, 2147483647)) AS sec FROM app JOIN con ON con.course_id = app.course_id AND con.key = app.key AND con.first_idx = app.idx GROUP BY ALL),
    og AS (SELECT course_id, key, grp, sum(n) AS gn, min(o) AS go FROM ori GROUP BY ALL),
    ob AS (SELECT *, row_number() OVER (PARTITION BY course_id, key ORDER BY gn DESC, go) AS r, count(*) OVER (PARTITION BY course_id, key) AS groups FROM og),
    os AS (SELECT ori.course_id, ori.key, value, groups, row_number() OVER (PARTITION BY ori.course_id, ori.key ORDER BY n DESC, o) AS r2 FROM ori JOIN ob USING (course_id, key, grp) WHERE r = 1),
    pl AS MATERIALIZED (SELECT con.course_id, con.key, con.name, con.definition, first_idx AS c1, fs.sec AS c2, first_card AS c3, multi_item, coalesce(os.value, '') AS original, coalesce(groups, 0) AS groups,
               coalesce(m.mastered, FALSE) AS mastered FROM con JOIN fs USING (course_id, key) LEFT JOIN (SELECT * FROM os WHERE r2 = 1) os USING (course_id, key) LEFT JOIN marks m USING (course_id, key)),
    cc AS (SELECT i.*, coalesce(concepts, 0) AS concepts, coalesce(multi, 0) AS multi, coalesce(done, 0) AS done, coalesce(questions, 0) AS questions, coalesce(focus, 0) AS focus FROM
             (SELECT course_id, max(course_title) AS title, count(*) AS notes FROM review_items GROUP BY 1) i
             LEFT JOIN (SELECT course_id, count(*) AS concepts, count(*) FILTER (multi_item) AS multi, count(*) FILTER (mastered) AS done FROM pl GROUP BY 1) USING (course_id)
             LEFT JOIN (SELECT qs.course_id, count(*) AS questions, count(*) FILTER (NOT pl.mastered) AS focus FROM qs LEFT JOIN pl ON pl.course_id = qs.course_id AND pl.key = qs.concept GROUP BY 1) USING (course_id))"""


def _esc(c):
    return f"replace(replace(replace(replace(coalesce({c}, ''), chr(92), chr(92) || chr(92)), '|', chr(92) || '|'), chr(13), ' '), chr(10), ' ')"


def _document(blocks):
    """Lines of the blocks in order, numbered per course; an empty last line goes."""
    return f""", ln AS ({" UNION ALL ".join(blocks)}),
    nu AS (SELECT course_id, row_number() OVER (PARTITION BY course_id ORDER BY p, c1, c2, c3, c4, bl, a, b, d, t) AS line_no, line, count(*) OVER (PARTITION BY course_id) AS total FROM ln)
    SELECT course_id, line_no, line FROM nu WHERE line_no < total OR line <> ''"""


def _block(p, c, bl, line, source, a="0", b="0", d="0", t="''"):
    c = c or ("0", "0", "0", "''")
    names = ("p", "c1", "c2", "c3", "c4", "bl", "a", "b", "d", "t")
    values = (str(p), *c, str(bl), a, b, d, t)
    return "SELECT course_id, " + ", ".join(f"{v} AS {n}" for v, n in zip(values, names)) + f", {line} AS line FROM {source}"


_HERE, _BEFORE = ("c1", "c2", "c3", "key"), ("c1", "-1", "0", "''")
_SUFFIX = f"CASE WHEN original <> '' THEN '（' || {_esc('original')} || '）' ELSE '' END"
UPDATED = "2026-12-01T00:00:00+00:00"
CONCEPT_DOCUMENT = PLACED + """,
    ti AS (SELECT course_id, idx, title AS item_title, note FROM review_items),
    gr AS (SELECT DISTINCT pl.course_id, c1, item_title FROM pl LEFT JOIN ti ON ti.course_id = pl.course_id AND ti.idx = pl.c1),
    ap AS (SELECT pl.course_id, c1, c2, c3, pl.key, app.idx, app.card_no, app.pos, section, section_name, time, url, note FROM app JOIN pl USING (course_id, key) LEFT JOIN ti ON ti.course_id = app.course_id AND ti.idx = app.idx),
    dd AS (SELECT course_id, key, def, min(idx * 1000000000000000::HUGEINT + card_no) AS o, min(idx) AS idx FROM ck GROUP BY ALL),
    de AS (SELECT course_id, c1, c2, c3, key, def, o, idx FROM (SELECT *, min(o) OVER (PARTITION BY course_id, key) AS lo FROM dd) JOIN pl USING (course_id, key) WHERE def <> '' AND o <> lo),
    rr AS (SELECT r.course_id, ck.key, r.field, """ + _KEY.format("r.ref") + """ AS ref_key, arg_min(r.ref, (r.idx, r.card_no, r.pos)) AS ref, min((r.idx, r.card_no, r.pos)) AS o FROM card_refs r
           JOIN ck ON ck.course_id = r.course_id AND ck.idx = r.idx AND ck.card_no = r.card_no GROUP BY ALL),
    rk AS (SELECT course_id, key, field, string_agg(""" + _esc("ref") + """, '、' ORDER BY o, ref) AS names FROM rr GROUP BY ALL),
    re AS (SELECT course_id, c1, c2, c3, key, string_agg(CASE field WHEN 'depends' THEN '依赖：' ELSE '易混：' END || names, '｜' ORDER BY field DESC) AS names FROM rk JOIN pl USING (course_id, key) GROUP BY ALL),
    qa AS (SELECT pl.course_id, c1, c2, c3, pl.key, string_agg('第 ' || qs.idx || ' 集第 ' || qs.no || ' 题', '、' ORDER BY qs.idx, qs.no, qs.stem) AS names FROM qs JOIN pl ON pl.course_id = qs.course_id AND pl.key = qs.concept GROUP BY ALL)""" + _document([
    _block(0, None, 0, f"'> 课程：' || {_esc('title')} || '｜概念 ' || concepts || ' 个（跨集出现 ' || multi || ' 个）｜已掌握 ' || done || ' / ' || concepts || '｜来自 ' || notes || ' 篇已完成的笔记｜更新于 {UPDATED}'", "cc"),
    _block(0, None, 1, f"'{review.TABLE_USAGE}'", "cc"), _block(0, None, 2, "''", "cc"),
    _block(1, _BEFORE, 0, f"'## 第 ' || c1 || ' 集 · ' || {_esc('item_title')}", "gr"), _block(1, _BEFORE, 1, "''", "gr"),
    _block(1, _HERE, 0, f"'+ [' || CASE WHEN mastered THEN 'x' ELSE ' ' END || '] **' || {_esc('name')} || '**' || {_SUFFIX}", "pl"),
    _block(1, _HERE, 1, f"'  + 定义：' || {_esc('definition')}", "pl"), _block(1, _HERE, 2, "'  + 出现：'", "pl"),
    _block(1, _HERE, 3, f"""'    + 第 ' || idx || ' 集' || CASE WHEN section IS NOT NULL THEN ' 第 ' || section || ' 节「' || {_esc('section_name')} || '」' ELSE '' END || '：[笔记](' || note || ') · '
        || CASE WHEN coalesce(time, '') <> '' AND coalesce(url, '') <> '' THEN '[▶ ' || time || '](' || url || ')' WHEN coalesce(time, '') <> '' THEN '[' || time || ']' ELSE '（无时间点）' END""",
           "ap", "idx", "coalesce(section, 2147483647)", "card_no", "CAST(coalesce(pos, 0) AS VARCHAR)"),
    _block(1, _HERE, 4, "'  + 其它集的说法：'", "(SELECT DISTINCT course_id, c1, c2, c3, key FROM de)"),
    _block(1, _HERE, 5, f"'    + 第 ' || idx || ' 集：' || {_esc('def')}", "de", "idx", "CAST(o % 1000000000000000 AS BIGINT)", "0", "def"),
    _block(1, _HERE, 6, "'  + ' || names", "re"), _block(1, _HERE, 7, "'  + 自测：' || names", "qa"), _block(1, _HERE, 8, "''", "pl")])

_QUIZ_SOURCE = "'第 ' || idx || ' 集第 ' || no || ' 题'"
_BACK = "CASE WHEN coalesce(time, '') <> '' AND coalesce(url, '') <> '' THEN '[▶ 回看 ' || time || '](' || url || ') · ' ELSE '' END || '[笔记](' || note || ')'"


def _asked(p, c, source, suffix):
    head = f"number || '. ' || {_esc('stem')} || '（' || {suffix} || '）'"
    lines = (head, "''", "'**答案：** ' || coalesce(answer, '')", "''", _BACK, "''")
    return [_block(p, c, 2, line, source, "number", str(i)) for i, line in enumerate(lines)]


QUIZ_DOCUMENT = PLACED + """,
    ev AS (SELECT qs.*, ti.title AS item_title, ti.note, qs.idx AS c1, row_number() OVER (PARTITION BY qs.course_id, qs.idx ORDER BY no, stem) AS number FROM qs LEFT JOIN review_items ti ON ti.course_id = qs.course_id AND ti.idx = qs.idx),
    fo AS (SELECT ev.course_id, ev.idx, ev.no, ev.stem, ev.answer, ev.time, ev.url, ev.note, pl.c1, pl.c2, pl.c3, pl.key, pl.name, pl.original, row_number() OVER (PARTITION BY ev.course_id, ev.concept ORDER BY ev.idx, no, stem) AS number
           FROM ev JOIN pl ON pl.course_id = ev.course_id AND pl.key = ev.concept JOIN cc ON cc.course_id = ev.course_id WHERE NOT mastered AND done > 0)""" + _document([
    _block(0, None, 0, f"'> 课程：' || {_esc('title')} || '｜共 ' || questions || ' 题，来自 ' || notes || ' 篇笔记｜没掌握的概念涉及 ' || focus || ' 题｜答案不折叠，先遮住答案再自测'", "cc"),
    _block(0, None, 1, f"'{review.QUIZ_USAGE}'", "cc"), _block(0, None, 2, "''", "cc"),
    _block(0, None, 3, f"CASE WHEN done > 0 THEN '## 先复习：还没掌握的概念（' || focus || ' 题）' ELSE '{review.QUIZ_UNMARKED}' END", "cc"), _block(0, None, 4, "''", "cc"),
    _block(1, _HERE, 0, f"'### ' || {_esc('name')} || {_SUFFIX}", "fo WHERE number = 1"), _block(1, _HERE, 1, "''", "fo WHERE number = 1"),
    *_asked(1, _HERE, "fo", _QUIZ_SOURCE),
    _block(2, None, 0, "'## 全部题目（按集）'", "cc"), _block(2, None, 1, "''", "cc"),
    _block(3, _BEFORE, 0, f"'### 第 ' || c1 || ' 集 · ' || {_esc('item_title')}", "ev WHERE number = 1"), _block(3, _BEFORE, 1, "''", "ev WHERE number = 1"),
    *_asked(3, _BEFORE, "ev", f"'对应：' || {_esc('correspond')} || '；' || {_QUIZ_SOURCE}")])


@REG.query("concept_document", CONCEPT_DOCUMENT)
def _(t):
    model = _model(t)
    return review.concept_document(model, frame(t, "review_items"), _model_marks(model), UPDATED)


@REG.query("quiz_document", QUIZ_DOCUMENT)
def _(t):
    model = _model(t)
    return review.quiz_document(model, frame(t, "review_items"), _model_marks(model))


@REG.query("course_concepts", PLACED + """
    SELECT course_id, key, name, definition, c1 AS first_idx, CAST(c2 AS INT) AS first_section, c3 AS first_card, multi_item, original, CAST(groups AS BIGINT) AS groups,
           row_number() OVER (PARTITION BY course_id ORDER BY c1, c2, c3, key) AS place FROM pl""")
def _(t):
    return sorted_numbers(_model(t).concepts, "course_id", "first", "place").select(
        "course_id", "key", "name", "definition", F.col("first.idx").alias("first_idx"), F.col("first.section_order").alias("first_section"),
        F.col("first.card_no").alias("first_card"), "multi_item", "original", F.col("groups").cast("bigint").alias("groups"), "place")


@REG.query("concept_key", MODEL + " SELECT DISTINCT name, key FROM ck")
def _(t):
    return op.concept_key(_cards(t).select("name").distinct())


@REG.query("merge_concepts", MODEL + " SELECT * FROM con")
def _(t):
    return op.merge_concepts(_cards(t))


@REG.query("concept_definitions", MODEL + """,
    d AS (SELECT course_id, key, def, min(idx * 1000000000000000::HUGEINT + card_no) AS o, min(idx) AS idx FROM ck GROUP BY ALL)
    SELECT course_id, key, def AS definition, idx FROM d WHERE def <> '' AND o <> (SELECT min(o) FROM d z WHERE z.course_id = d.course_id AND z.key = d.key)""")
def _(t):
    return op.concept_definitions(_cards(t))


@REG.query("concept_references", MODEL + " SELECT * FROM rf")
def _(t):
    return op.concept_references(_cards(t), frame(t, "card_refs"))


@REG.query("choose_original", MODEL + """,
    g AS (SELECT course_id, key, grp, sum(n) AS gn, min(o) AS go FROM ori GROUP BY ALL),
    b AS (SELECT *, row_number() OVER (PARTITION BY course_id, key ORDER BY gn DESC, go) AS r, count(*) OVER (PARTITION BY course_id, key) AS groups FROM g),
    s AS (SELECT ori.course_id, ori.key, value, groups, row_number() OVER (PARTITION BY ori.course_id, ori.key ORDER BY n DESC, o) AS r2 FROM ori JOIN b USING (course_id, key, grp) WHERE r = 1)
    SELECT course_id, key, value AS original, groups FROM s WHERE r2 = 1""")
def _(t):
    return op.choose_original(_cards(t))


@REG.query("concept_appearances", MODEL + " SELECT * FROM app")
def _(t):
    return _apps(t)


@REG.query("attribute_questions", MODEL + " SELECT * FROM qs")
def _(t):
    return _questions(t)


@REG.query("course_checks", PLACED + """,
    held AS (SELECT DISTINCT ori.course_id, ori.folded, pl.key, pl.name, pl.c1 AS first_idx, pl.c2, pl.c3 FROM ori JOIN pl USING (course_id, key)),
    hr AS (SELECT *, row_number() OVER (PARTITION BY course_id, folded ORDER BY first_idx, c2, c3, key) AS r FROM held),
    nm AS (SELECT rf.course_id, rf.key, rf.field, trim(unnest(CASE WHEN field = 'confusable' THEN regexp_split_to_array(split_part(ref, '——', 1), '、') ELSE [ref] END)) AS n FROM rf)
    SELECT course_id, 'CR-PARSE' AS "check", 'error' AS severity, idx, NULL::VARCHAR AS concept, parse_error AS message FROM review_items WHERE parse_error <> ''
    UNION ALL SELECT course_id, 'CR-LINK', 'error', idx, NULL, 'note missing' FROM review_items WHERE NOT note_exists
    UNION ALL SELECT course_id, 'CR-STALE', 'error', NULL, NULL, 'review is stale' FROM review_items GROUP BY 1 HAVING bool_or(stale)
    UNION ALL SELECT app.course_id, 'CR-JUMP', 'warning', app.idx, con.name, coalesce(CAST(section AS VARCHAR), '-') FROM app JOIN con USING (course_id, key) WHERE coalesce(time, '') = '' OR coalesce(url, '') = ''
    UNION ALL SELECT course_id, 'CR-ORIG', 'warning', first_idx, name, CAST(g AS VARCHAR) FROM (SELECT course_id, key, count(DISTINCT grp) AS g FROM ori GROUP BY ALL) JOIN con USING (course_id, key) WHERE g > 1
    UNION ALL SELECT course_id, 'CR-SAME', 'warning', first_idx, name, folded FROM hr WHERE r > 1
    UNION ALL SELECT nm.course_id, 'CR-DEP', 'warning', con.first_idx, con.name, field || ': ' || n FROM nm JOIN con USING (course_id, key)
        WHERE n <> '' AND NOT EXISTS (SELECT 1 FROM con z WHERE z.course_id = nm.course_id AND z.key = lower(regexp_replace(n, '\\s+', '', 'g')))
    UNION ALL SELECT course_id, 'CR-QUIZ', 'warning', idx, correspond, CAST(no AS VARCHAR) FROM qs WHERE concept IS NULL""")
def _(t):
    return review.model_checks(_model(t), frame(t, "review_items"))


@REG.query("review_summary", MODEL + """
    SELECT c.course_id, c.concepts, c.multi_episode, q.questions, c.mastered, c.concepts - c.mastered AS unmastered, a.jump_rate
    FROM (SELECT course_id, count(*) AS concepts, count(*) FILTER (multi_item) AS multi_episode, count(*) FILTER (length(key) % 3 = 0) AS mastered FROM con GROUP BY 1) c
    JOIN (SELECT course_id, count(*) AS questions FROM qs GROUP BY 1) q USING (course_id)
    JOIN (SELECT course_id, count(*) FILTER (time <> '' AND url <> '') / count(*) AS jump_rate FROM app GROUP BY 1) a USING (course_id)""")
def _(t):
    model = _model(t)
    return review.model_summary(model, frame(t, "review_items"), _model_marks(model))


@REG.query("source_digest", with_inputs("review_items") + """,
    h AS (SELECT course_id, course_title, sha256(CAST(idx AS VARCHAR) || chr(1) || note || chr(1) || title || chr(1) || sha) AS h FROM review_items),
    l AS (SELECT course_id, max(course_title) AS t, count(*) AS n, """ + ", ".join(
        f"sum(CAST(CAST('0x' || substring(h, {1 + 15 * i}, 15) AS BIGINT) AS HUGEINT)) AS l{i}" for i in range(4)) + """ FROM h GROUP BY 1)
    SELECT course_id, sha256(t || '|' || n || '|' || l0 || '|' || l1 || '|' || l2 || '|' || l3) AS digest FROM l""")
def _(t):
    return op.source_digest(frame(t, "review_items"))


_BACKUP = "SELECT course_id, key, name || '!' AS name, cards % 2 = 0 AS mastered, CAST('2026-01-01 00:00:00' AS TIMESTAMP) AS changed_at FROM {con} WHERE cards % 3 = 0"
_TABLE = "SELECT course_id, key, cards % 4 < 2 AS mastered FROM {con} WHERE cards % 5 < 2"
_COMMANDS = "SELECT course_id, CASE WHEN cards % 7 = 1 THEN key || 'x' ELSE key END AS key, cards % 2 = 1 AS mastered, first_idx AS ord FROM {con} WHERE cards % 7 < 2"


@REG.query("merge_mastery", MODEL + f""", b AS ({_BACKUP.replace('{con}', 'con')}), tb AS ({_TABLE.replace('{con}', 'con')}),
    cm AS (SELECT c.* FROM ({_COMMANDS.replace('{con}', 'con')}) c JOIN con USING (course_id, key)),
    j AS (SELECT con.course_id, con.key, con.name, b.mastered AS was, coalesce(cm.mastered, tb.mastered, b.mastered, FALSE) AS mastered, b.changed_at
          FROM con LEFT JOIN b USING (course_id, key) LEFT JOIN tb USING (course_id, key) LEFT JOIN cm USING (course_id, key))
    SELECT course_id, key, name, mastered, CASE WHEN was = mastered THEN changed_at ELSE TIMESTAMP '2026-12-01 00:00:00' END AS changed_at FROM j""")
def _(t):
    con = op.merge_concepts(_cards(t))
    return op.merge_mastery(con, t.sql(_BACKUP, con=con), t.sql(_TABLE, con=con), t.sql(_COMMANDS, con=con), "2026-12-01 00:00:00")


@REG.query("unknown_commands", MODEL + f""", cm AS (SELECT c.course_id, c.key AS asked FROM ({_COMMANDS.replace('{con}', 'con')}) c
        WHERE NOT EXISTS (SELECT 1 FROM con z WHERE z.course_id = c.course_id AND z.key = c.key)),
    r AS (SELECT cm.course_id, asked, con.key, CAST(row_number() OVER (PARTITION BY cm.course_id, asked ORDER BY levenshtein(asked, con.key), con.key) AS INT) AS rank
          FROM (SELECT DISTINCT * FROM cm) cm JOIN con ON con.course_id = cm.course_id)
    SELECT course_id, asked, rank, key FROM r WHERE rank <= 3""")
def _(t):
    con = op.merge_concepts(_cards(t))
    return op.unknown_commands(con, t.sql(_COMMANDS, con=con))


_MARK_LINES = """
    SELECT s_suppkey % 10 AS course_id, s_suppkey AS line_no,
           CASE WHEN s_suppkey % 10 = 3 THEN 'broken ' || s_name WHEN s_suppkey % 4 = 0 THEN 'x' ELSE '+ [' || CASE s_suppkey % 3 WHEN 0 THEN 'x' WHEN 1 THEN ' ' ELSE 'X' END || '] **' || s_name || ' a|b** rest' END AS line
    FROM {supplier}"""


@REG.query("read_marks", f"""WITH l AS ({_MARK_LINES.replace('{supplier}', 'supplier')})
    SELECT course_id, lower(replace(regexp_extract(line, '\\*\\*(.+?)\\*\\*', 1), ' ', '')) AS key,
           arg_max(lower(substring(line, 4, 1)) = 'x', line_no) AS mastered
    FROM l WHERE starts_with(line, '+ [') GROUP BY 1, 2""")
def _(t):
    return op.read_marks(t.sql(_MARK_LINES))


@REG.query("refused_tables", f"""WITH l AS ({_MARK_LINES.replace('{supplier}', 'supplier')})
    SELECT course_id FROM l GROUP BY 1 HAVING count(*) FILTER (starts_with(line, '+ [')) = 0""")
def _(t):
    return op.refused_tables(t.sql(_MARK_LINES))


@REG.query("unmastered_queue", PLACED + """,
    pe AS (SELECT *, row_number() OVER (PARTITION BY course_id ORDER BY c1, c2, c3, key) AS pos, count(*) OVER (PARTITION BY course_id) AS total FROM pl WHERE NOT mastered)
    SELECT pe.course_id, CAST(pos AS INT) AS pos, name, original, definition, total > 50 AS truncated, qs.idx, qs.no, qs.stem, qs.answer, qs.url
    FROM pe LEFT JOIN qs ON qs.course_id = pe.course_id AND qs.concept = pe.key WHERE pos <= 50""")
def _(t):
    model = _model(t)
    return review.model_queue(model, _model_marks(model))


def _heads(model):
    return model.concepts.select("course_id", "key", "name", "definition", F.col("first.idx").alias("first_idx"), F.col("first.card_no").alias("first_card"))


@REG.query("quiz_document_lines", MODEL + """,
    fo AS (SELECT qs.*, con.first_idx, row_number() OVER (PARTITION BY qs.course_id, concept ORDER BY qs.idx, no, stem) AS number FROM qs JOIN con ON con.course_id = qs.course_id AND con.key = qs.concept
           WHERE length(con.key) % 3 <> 0 AND EXISTS (SELECT 1 FROM con z WHERE z.course_id = qs.course_id AND length(z.key) % 3 = 0)),
    al AS (SELECT *, row_number() OVER (PARTITION BY course_id, idx ORDER BY no, stem) AS number FROM qs)
    SELECT course_id, 1::INT AS part, CAST(first_idx AS BIGINT) AS a, concept AS b, CAST(number AS INT) AS number, number || '. ' || stem || '（第 ' || idx || ' 集第 ' || no || ' 题）' AS line FROM fo
    UNION ALL SELECT course_id, 2, CAST(idx AS BIGINT), '', CAST(number AS INT), number || '. ' || stem || '（对应：' || coalesce(correspond, '') || '；第 ' || idx || ' 集第 ' || no || ' 题）' FROM al""")
def _(t):
    model = _model(t)
    return op.quiz_document_lines(model.questions, _heads(model), _model_marks(model))


@REG.query("concept_table_lines")
def _(t):
    model = _model(t)
    definitions = model.of_kind("definition")
    opening = definitions.groupBy("course_id", "key").agg(F.min("o").alias("opening"))
    others = definitions.filter("vkey <> ''").join(opening, ["course_id", "key"]).filter("o <> opening")
    references = model.values.filter("kind IN ('depends', 'confusable')")
    return op.concept_table_lines(
        _heads(model), model.concepts, others.select("course_id", "key", F.col("value").alias("definition"), "o.idx"),
        references.select("course_id", "key", F.col("kind").alias("field"), F.col("vkey").alias("ref_key"), F.col("value").alias("ref")),
        model.appearances, _model_marks(model))


@REG.query("note_course_nav")
def _(t):
    return md.course_nav(notes(t))


@REG.query("parse_course_notes")
def _(t):
    return md.parse_course_notes(notes(t))
