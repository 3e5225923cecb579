"""Markdown shredding queries."""

from __future__ import annotations

from lectern.operators import markdown as op
from lectern.plans.captions import sql_strip
from lectern.plans.inputs import with_inputs
from lectern.plans.notes_input import notes
from lectern.plans.registry import Registry

REG = Registry()

# One shared chain for the check: lines, fences, headings, sections, front matter, all by windows.
BASE = with_inputs("notes") + rf""",
    al AS (SELECT note_id, CAST(generate_subscripts(string_split(regexp_replace(text, '\n$', ''), chr(10)), 1) AS INT) AS a, unnest(string_split(regexp_replace(text, '\n$', ''), chr(10))) AS s FROM notes),
    fc AS (SELECT note_id, min(a) FILTER (a >= 3 AND regexp_matches(s, '^---\s*$')) AS c FROM al GROUP BY 1
           HAVING bool_or(a = 1 AND regexp_matches(s, '^---\s*$'))),
    fmr AS (SELECT al.note_id, a, regexp_extract(trim(s), '^([A-Za-z_][A-Za-z0-9_-]*)\s*:\s*(.*)$', 1) AS k,
                   trim(trim(trim(regexp_extract(trim(s), '^([A-Za-z_][A-Za-z0-9_-]*)\s*:\s*(.*)$', 2)), '"'), '''') AS v
            FROM al JOIN fc ON fc.note_id = al.note_id AND a > 1 AND a < c
            WHERE regexp_matches(trim(s), '^([A-Za-z_][A-Za-z0-9_-]*)\s*:\s*(.*)$')),
    fm AS (SELECT note_id, k AS key, arg_max(v, a) AS value FROM fmr GROUP BY ALL),
    tv AS (SELECT n.*, fc.c, (SELECT value FROM fm WHERE fm.note_id = n.note_id AND key = 'template_version') AS tv FROM notes n
           LEFT JOIN fc ON fc.note_id = n.note_id),
    kd AS (SELECT *, CASE WHEN template IS NULL AND tv = 'v4-obsidian' THEN 'v4-obsidian' WHEN template = 'v4' OR c IS NULL THEN 'v4'
                     WHEN tv = 'v3' THEN 'v3' ELSE 'unknown' END AS kind FROM tv),
    kz AS (SELECT *, CASE WHEN kind = 'v4-obsidian' THEN coalesce((SELECT min(a) FROM al WHERE al.note_id = kd.note_id AND s = '---' AND a >= 2), 0) ELSE 0 END AS off FROM kd),
    l0 AS (SELECT al.note_id, kind, off, a - off AS n, s, regexp_matches(s, '^\s*```') AS isf, regexp_matches(s, '^##\s+.') AS ish
           FROM al JOIN kz ON kz.note_id = al.note_id AND a > off),
    l1 AS (SELECT *, sum(CASE WHEN isf THEN 1 ELSE 0 END) OVER w % 2 = 1 AS f,
                  coalesce(max(CASE WHEN ish THEN n END) OVER w, 0) AS h,
                  count(*) OVER (PARTITION BY note_id) AS total
           FROM l0 WINDOW w AS (PARTITION BY note_id ORDER BY n ROWS UNBOUNDED PRECEDING)),
    lx AS (SELECT *, coalesce(max(CASE WHEN ish AND NOT f THEN n END) OVER (PARTITION BY note_id ORDER BY n ROWS UNBOUNDED PRECEDING), 0) AS g FROM l1),
    h2 AS (SELECT note_id, kind, n, CAST(coalesce(lead(n) OVER (PARTITION BY note_id ORDER BY n), total + 1) AS INT) AS e,
                  trim(regexp_extract(s, '^##\s+(.+?)\s*$', 1)) AS t,
                  TRY_CAST(nullif(regexp_extract(s, '^##\s+(\d{{1,2}})\s*[.、．)）]', 1), '') AS INT) AS num, f FROM lx WHERE ish),
    sec AS (SELECT w, note_id, min(n) AS n, arg_min(e, n) AS e FROM h2, (VALUES ('概念卡片'), ('自测题'), ('视频时间索引'), ('知识地图'), ('本讲小结')) v(w)
            WHERE contains(t, w) GROUP BY ALL),
    inn AS (SELECT lx.*, w FROM lx JOIN sec ON sec.note_id = lx.note_id AND lx.n > sec.n AND lx.n < sec.e)"""

# Each of these is read several times.
for _name in ("al", "fc", "fm", "kz", "l0", "l1", "lx", "h2", "sec", "inn"):
    BASE = BASE.replace(f"    {_name} AS (", f"    {_name} AS MATERIALIZED (", 1)

CARDS = BASE + r""",
    cl AS (SELECT *, sum(CASE WHEN regexp_matches(s, '^###\s+\S') THEN 1 ELSE 0 END) OVER (PARTITION BY note_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS no
           FROM inn WHERE w = '概念卡片' AND NOT f),
    cf AS (SELECT *, CASE WHEN kind = 'v3' THEN regexp_extract(s, '^\s*[-*]\s*(定义|出现|依赖|易混)\s*[：:]\s*(.*)$', 1)
                     ELSE regexp_extract(s, '^\s*[-*+]\s*(定义|出现|依赖|易混|原文)\s*[：:]\s*(.*)$', 1) END AS k,
                  trim(regexp_extract(s, '^\s*[-*+]\s*(定义|出现|依赖|易混|原文)\s*[：:]\s*(.*)$', 2)) AS v FROM cl WHERE no > 0),
    cards AS (SELECT note_id, any_value(kind) AS kind, CAST(no AS INT) AS card_no, min(n) AS line_no, trim(arg_min(substring(s, 4), n)) AS name,
            arg_min(v, n) FILTER (k = '定义') AS definition, arg_min(v, n) FILTER (k = '出现') AS appears,
            arg_min(v, n) FILTER (k = '依赖') AS depends, arg_min(v, n) FILTER (k = '易混') AS confusable,
            arg_min(v, n) FILTER (k = '原文') AS original, min(n) FILTER (k = '出现') AS appears_line,
            min(n) FILTER (k = '依赖') AS depends_line, min(n) FILTER (k = '易混') AS confusable_line FROM cf GROUP BY note_id, no)"""

QUIZ = CARDS + r""",
    ql AS (SELECT *, sum(CASE WHEN regexp_matches(s, '^\s*\d{1,2}\s*[.、．)）]\s*\S') THEN 1 ELSE 0 END) OVER w AS no,
                  regexp_matches(s, '^\s*\d{1,2}\s*[.、．)）]\s*\S') AS isq,
                  regexp_matches(s, '(?i)<details\b') AS op, regexp_matches(s, '(?i)</details>') AS cl, regexp_matches(s, '^\s*\*\*答案：?\*\*') AS an
           FROM inn WHERE w = '自测题' WINDOW w AS (PARTITION BY note_id ORDER BY n ROWS UNBOUNDED PRECEDING)),
    qb AS (SELECT *, coalesce(max(CASE WHEN op THEN n END) OVER p, 0) AS lo,
                  coalesce(max(CASE WHEN cl AND NOT op AND NOT an THEN n END) OVER p, 0) AS lc
           FROM ql WHERE no > 0 AND NOT isq WINDOW p AS (PARTITION BY note_id, no ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    qe AS (SELECT * FROM qb WHERE kind <> 'v3' OR (lo > lc AND NOT op)),
    qa AS (SELECT note_id, no, min(n) AS an FROM qe WHERE an GROUP BY ALL),
    qx AS (SELECT qe.note_id, qe.no, qe.n, qe.s, qe.an AS is_answer, qa.an AS first_answer,
                  qe.n > qa.an AND trim(s) <> '' AND CASE WHEN kind = 'v3' THEN NOT qe.an AND NOT cl
                  ELSE trim(s) <> '---' AND NOT regexp_matches(s, '(?i)^\s*</?(details|summary)\b') END AS extra
           FROM qe LEFT JOIN qa ON qa.note_id = qe.note_id AND qa.no = qe.no),
    quiz AS (SELECT q.note_id, any_value(q.kind) AS kind, CAST(q.no AS INT) AS no, q.n AS line_no,
               trim(regexp_replace(q.s, '^\s*\d{1,2}\s*[.、．)）]\s*', '')) AS stem,
               nullif(regexp_extract(q.s, '[（(]\s*对应\s*[：:]\s*([^）)]+?)\s*[）)]', 1), '') AS correspond,
               EXISTS (SELECT 1 FROM qa WHERE qa.note_id = q.note_id AND qa.no = q.no) AS answered,
               EXISTS (SELECT 1 FROM qb WHERE qb.note_id = q.note_id AND qb.no = q.no AND op) AS folded,
               CAST((SELECT count(*) FROM qx WHERE qx.note_id = q.note_id AND qx.no = q.no AND extra) AS INT) AS extra_lines,
               coalesce((SELECT regexp_extract(s, '^\s*\*\*答案：?\*\*\s*(.*)$', 1) FROM qx WHERE qx.note_id = q.note_id AND qx.no = q.no AND n = first_answer), '') AS answer
             FROM ql q WHERE isq GROUP BY q.note_id, q.no, q.n, q.s)"""

_ENTRY = r"""'^\s*[-*+]\s+\[(\d{1,3}):(\d{2})\](?:\(([^)\s]*)\))?\s+(\S.*?)\s*$'"""
NAV = rf""",
    nav AS (SELECT note_id, kind, n AS line_no,
               CAST(regexp_extract(s, {_ENTRY}, 1) AS INT) * 60 + CAST(regexp_extract(s, {_ENTRY}, 2) AS INT) AS ts_sec,
               nullif(regexp_extract(s, {_ENTRY}, 3), '') AS url, regexp_extract(s, {_ENTRY}, 4) AS title
            FROM inn WHERE w = '视频时间索引' AND regexp_matches(s, {_ENTRY}) AND (kind <> 'v3' OR regexp_matches(s, '^\s*[-*]')))"""

# Mermaid blocks: a language fence opens a block, any fence closes it; a recursion over fences.
MAP = r""",
    ff AS (SELECT *, row_number() OVER (PARTITION BY note_id ORDER BY n) AS i, regexp_extract(s, '^\s*```(\S*)\s*$', 1) AS lang,
                  regexp_matches(s, '^\s*```(\S*)\s*$') AS isl FROM inn WHERE w = '知识地图' AND isf),
    fr AS (SELECT note_id, i, lower(lang) AS lang, n AS o, isl AS opened, n FROM ff WHERE i = 1
           UNION ALL
           SELECT ff.note_id, ff.i, CASE WHEN fr.opened THEN fr.lang ELSE lower(ff.lang) END, CASE WHEN fr.opened THEN fr.o ELSE ff.n END,
                  NOT fr.opened AND ff.isl, ff.n
           FROM fr JOIN ff ON ff.note_id = fr.note_id AND ff.i = fr.i + 1),
    blk AS (SELECT r.note_id, r.lang, r.o, coalesce((SELECT min(n) FROM fr z WHERE z.note_id = r.note_id AND z.n > r.o),
                   (SELECT e FROM sec WHERE sec.note_id = r.note_id AND w = '知识地图')) AS c FROM fr r WHERE r.opened),
    kmb AS (SELECT note_id, o, c, row_number() OVER (PARTITION BY note_id ORDER BY o) AS i FROM blk WHERE lang = 'mermaid'),
    kml AS (SELECT inn.note_id, n, trim(s) AS s FROM inn JOIN kmb ON kmb.note_id = inn.note_id AND kmb.i = 1 AND inn.n > o AND inn.n < c
            WHERE w = '知识地图' AND trim(s) <> '' AND NOT starts_with(trim(s), '%%') AND NOT regexp_matches(trim(s), '^(?:mindmap|graph|flowchart)\b') AND trim(s) <> 'end'),
    kme AS (SELECT * FROM kml WHERE NOT regexp_matches(s, '^\s*subgraph\b')),
    nodes AS (SELECT note_id, trim(unnest(regexp_extract_all(regexp_replace(s, '\|[^|]*\|', ' ', 'g'), '[\[\(\{]+([^\[\]\(\)\{\}|]+?)[\]\)\}]+', 1))) AS label FROM kme),
    groups AS (SELECT note_id, coalesce(nullif(trim(regexp_extract(s, '[\[\(\{]+([^\[\]\(\)\{\}|]+?)[\]\)\}]+', 1)), ''), trim(substring(s, 9))) AS label
               FROM kml WHERE regexp_matches(s, '^\s*subgraph\b')),
    edges AS (SELECT m.note_id, CAST(coalesce(sum(len(regexp_extract_all(s, '-->|---|-\.->|-\.-|\.->|==>|==='))), 0) AS INT) AS edges,
               CAST(coalesce(sum(len(regexp_extract_all(s, '(?:-->|---|-\.->|-\.-|==>|===)\s*\|[^|]+\|')) + len(regexp_extract_all(s, '--\s+[^-|>\s][^|>]*?\s+-->'))
                  + len(regexp_extract_all(s, '-\.\s+[^|.][^|]*?\s+\.->')) + len(regexp_extract_all(s, '==\s+[^|=][^|]*?\s+==>'))), 0) AS INT) AS labeled_edges
              FROM kmb m LEFT JOIN kme ON kme.note_id = m.note_id WHERE m.i = 1 GROUP BY 1)"""
RECURSIVE_BASE = BASE.replace("WITH ", "WITH RECURSIVE ", 1)


@REG.query("fence_state", BASE + " SELECT note_id, n AS line_no, f AS in_fence FROM lx")
def _(t):
    return op.fence_state(notes(t))


@REG.query("note_sections", BASE + r""",
    s0 AS (SELECT note_id, 0 AS n, min(CASE WHEN ish THEN n END) AS e, CAST(NULL AS VARCHAR) AS t FROM lx GROUP BY 1
           UNION ALL SELECT note_id, n, e, t FROM h2)
    SELECT s0.note_id, CAST(row_number() OVER (PARTITION BY s0.note_id ORDER BY s0.n) - 1 AS INT) AS sec_no, t AS title, s0.n AS line_no,
           CAST((SELECT count(*) FROM lx WHERE lx.note_id = s0.note_id AND lx.n > s0.n AND lx.h = s0.n AND trim(lx.s) NOT IN ('', '---')) AS INT) AS lines
    FROM s0""")
def _(t):
    return op.note_sections(notes(t))


@REG.query("section_span", BASE + """
    SELECT note_id, n AS head, e AS "end" FROM sec WHERE w = '概念卡片'""")
def _(t):
    return op.section_span(notes(t), "概念卡片")


@REG.query("note_frontmatter", BASE + " SELECT note_id, key, value FROM fm")
def _(t):
    return op.note_frontmatter(notes(t))


@REG.query("concept_cards", CARDS + """
    SELECT note_id, card_no, line_no, name, definition, appears, depends, confusable, original FROM cards""")
def _(t):
    return op.concept_cards(notes(t))


@REG.query("card_appearances", CARDS + r""",
    p AS (SELECT note_id, card_no, name, regexp_extract_all(appears, '第\s*(\d{1,2})\s*节\s*「([^」]*)」', 1) AS a,
                 regexp_extract_all(appears, '第\s*(\d{1,2})\s*节\s*「([^」]*)」', 2) AS b FROM cards)
    SELECT note_id, card_no, name, CAST(generate_subscripts(a, 1) - 1 AS INT) AS pos, CAST(unnest(a) AS INT) AS section, unnest(b) AS title FROM p""")
def _(t):
    return op.card_appearances(notes(t))


@REG.query("quiz_items", QUIZ + """
    SELECT note_id, no, line_no, stem, correspond, answered, folded, extra_lines, answer FROM quiz""")
def _(t):
    return op.quiz_items(notes(t))


@REG.query("nav_entries", BASE + NAV + " SELECT note_id, line_no, ts_sec, url, title FROM nav")
def _(t):
    return op.nav_entries(notes(t))


@REG.query("km_nodes", RECURSIVE_BASE + MAP + """
    SELECT note_id, 'node' AS kind, label FROM nodes UNION ALL SELECT note_id, 'group', label FROM groups""")
def _(t):
    return op.km_nodes(notes(t))


@REG.query("km_edges", RECURSIVE_BASE + MAP + " SELECT * FROM edges")
def _(t):
    return op.km_edges(notes(t))


@REG.query("image_refs", BASE + r""",
    i0 AS (SELECT note_id, n, g, regexp_extract_all(s, '!\[([^\]]*)\]\(([^)\s]+)\)', 1) AS a, regexp_extract_all(s, '!\[([^\]]*)\]\(([^)\s]+)\)', 2) AS b FROM lx WHERE NOT f),
    i1 AS (SELECT note_id, n, g, unnest(a) AS alt, unnest(b) AS path FROM i0)
    SELECT i1.note_id, i1.n AS line_no, trim(alt) AS alt, path, h2.num AS section FROM i1 LEFT JOIN h2 ON h2.note_id = i1.note_id AND h2.n = i1.g
    WHERE starts_with(path, 'images/')""")
def _(t):
    return op.image_refs(notes(t))
