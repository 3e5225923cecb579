"""Quality gate queries: one per rule, plus the whole gate and its summary."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions.text import BLANK
from lectern.operators import lint as op, markdown as md
from lectern.plans.inputs import frame, stamped_docs, with_inputs
from lectern.plans.markdown import BASE, CARDS, MAP, NAV, QUIZ
from lectern.plans.notes_input import notes
from lectern.plans.registry import Registry

REG = Registry()

PREP = r""",
    fw AS (SELECT note_id, max(value) FILTER (key = 'note_type') AS f_nt, max(value) FILTER (key = 'platform') AS f_pl,
                  max(value) FILTER (key = 'bvid') AS f_bv, max(value) FILTER (key = 'video_id') AS f_vid FROM fm GROUP BY 1),
    mk AS (SELECT note_id, min(CASE WHEN regexp_matches(s, '<!--\s*NAV:BEGIN') THEN n END) AS nb, min(CASE WHEN regexp_matches(s, '<!--\s*NAV:END') THEN n END) AS ne,
                  count(*) FILTER (regexp_matches(s, '<!--\s*NAV:BEGIN')) AS cb, count(*) FILTER (regexp_matches(s, '<!--\s*NAV:END')) AS ce FROM lx GROUP BY 1),
    p0 AS (SELECT k.*, lower(CASE WHEN kind = 'v3' THEN coalesce(f_nt, '') WHEN kind = 'v4-obsidian' THEN f_nt ELSE coalesce(k.note_type, 'lecture') END) AS nt,
                  CASE WHEN kind = 'v3' THEN coalesce(f_pl, '') WHEN kind = 'v4-obsidian' THEN f_pl ELSE coalesce(k.platform, '') END AS plat,
                  CASE WHEN kind = 'v3' THEN coalesce(CASE WHEN f_pl = 'youtube' THEN f_vid ELSE f_bv END, '') WHEN kind = 'v4-obsidian' THEN coalesce(f_bv, f_vid) ELSE coalesce(k.vid, '') END AS ident,
                  nb, ne, cb, ce, sn.n AS nav_n, sn.e AS nav_e, sq.n AS quiz_n, sm.n AS map_n, ss.n AS sum_n, sc.n AS cards_n, (SELECT max(total) FROM lx WHERE lx.note_id = k.note_id) AS total
           FROM kz k LEFT JOIN fw USING (note_id) LEFT JOIN mk USING (note_id)
           LEFT JOIN sec sn ON sn.note_id = k.note_id AND sn.w = '视频时间索引' LEFT JOIN sec sq ON sq.note_id = k.note_id AND sq.w = '自测题'
           LEFT JOIN sec sm ON sm.note_id = k.note_id AND sm.w = '知识地图' LEFT JOIN sec ss ON ss.note_id = k.note_id AND ss.w = '本讲小结'
           LEFT JOIN sec sc ON sc.note_id = k.note_id AND sc.w = '概念卡片'),
    p AS (SELECT *, kind LIKE 'v4%' AND nt = 'brief' AS brief, kind LIKE 'v4%' AND nt = 'lecture' AND NOT source_lang LIKE 'zh%' AS foreigner,
                 cb = 1 AND ce = 1 AND nb < ne AS paired FROM p0),
    ln AS (SELECT lx.*, p.nt, p.brief, p.foreigner, CASE WHEN lx.kind = 'v3' THEN lx.n <= coalesce(p.c, 0) OR coalesce(p.nb <= p.ne AND lx.n BETWEEN p.nb AND p.ne, FALSE)
                        ELSE coalesce(lx.n >= p.nav_n AND lx.n < p.nav_e, FALSE) END AS ex FROM lx JOIN p ON p.note_id = lx.note_id),
    hs AS (SELECT h2.*, p.nt, p.brief, p.off, (SELECT count(*) FROM lx WHERE lx.note_id = h2.note_id AND lx.h = h2.n AND lx.n > h2.n AND trim(s) NOT IN ('', '---')) AS subs,
                  coalesce((SELECT arg_max(s, n) FROM lx WHERE lx.note_id = h2.note_id AND lx.h = h2.n AND lx.n > h2.n AND trim(s) NOT IN ('', '---')), '') AS last_sub,
                  coalesce((SELECT arg_min(s, n) FROM lx WHERE lx.note_id = h2.note_id AND lx.h = h2.n AND lx.n > h2.n AND trim(s) NOT IN ('', '---')), '') AS first_sub,
                  trim(regexp_replace(t, '^\s*\d{1,2}\s*[.、．)）]\s*', '')) AS norm FROM h2 JOIN p ON p.note_id = h2.note_id)"""


def rec(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


LINES = BASE + PREP
CARD = CARDS + PREP + r""",
    cs AS (SELECT c.*, p.off, p.nt, p.brief, p.foreigner FROM cards c JOIN p ON p.note_id = c.note_id),
    ap0 AS (SELECT note_id, kind, off, brief, name, appears, appears_line,
                CASE WHEN kind = 'v3' THEN regexp_extract_all(appears, '(\d{1,2})\s*(?:[（(]([^）)]*)[）)])?', 1) ELSE regexp_extract_all(appears, '第\s*(\d{1,2})\s*节\s*「([^」]*)」', 1) END AS a,
                CASE WHEN kind = 'v3' THEN [] ELSE regexp_extract_all(appears, '第\s*(\d{1,2})\s*节\s*「([^」]*)」', 2) END AS b
            FROM cs WHERE coalesce(appears, '') <> ''),
    ap AS (SELECT note_id, kind, off, brief, name, appears_line, CAST(unnest(a) AS INT) AS sec, unnest(b) AS title FROM ap0)"""
QUIZZES = QUIZ + PREP + """,
    qs AS (SELECT q.*, p.off, p.nt, p.brief FROM quiz q JOIN p ON p.note_id = q.note_id)"""
NAVS = BASE + NAV + PREP + """,
    es AS (SELECT nav.*, p.off, p.nt, p.plat, p.ident, p.brief FROM nav JOIN p ON p.note_id = nav.note_id)"""
MAPS = rec(CARDS + MAP + PREP)


def sel(check: str, severity: str, line: str, message: str, rest: str, who: str = "note_id") -> str:
    return (f" SELECT {who} AS note_id, '{check}' AS \"check\", '{severity}' AS severity, CAST({line} AS INT) AS line, "
            f"CAST({message} AS VARCHAR) AS message FROM {rest}")


def u(*parts: str) -> str:
    return " UNION ALL ".join(parts)


def skip(words) -> str:
    return "NOT regexp_matches(t, '" + "|".join(words) + "')"


def ok(kind: str) -> str:
    return "kind = 'v3'" if kind == "V3" else "kind LIKE 'v4%'"


TIME = r"\[\d{1,3}:\d{2}(?::\d{2})?\]|[（(]\d{1,3}:\d{2}(?::\d{2})?[）)]"
TAGS = r"\*\*(核心必考|重点掌握|了解即可)\*\*|[（(](核心必考|重点掌握|了解即可)[）)]"


def times(k: str) -> str:
    return LINES + sel(f"{k}-E1", "error", "n + off", "'time mark: ' || z", f"(SELECT note_id, n, off, unnest(regexp_extract_all(s, '{TIME}')) AS z FROM ln WHERE {ok(k)} AND NOT ex)")


def residue(k: str) -> str:
    bullets = "[-*]" if k == "V3" else "[-*+]"
    return LINES + sel(f"{k}-E4", "error", "n + off", "'label residue'", rf"""ln WHERE {ok(k)} AND NOT ex AND NOT f AND
        (regexp_matches(s, '^\s*(?:{bullets}\s*)?(?:{TAGS})') OR regexp_matches(s, '^###\s+.+?[（(](核心必考|重点掌握|了解即可)[）)]\s*$'))""")


def cards(k: str) -> str:
    c, own = f"{k}-E6", f"{ok(k)}" + ("" if k == "V3" else " AND NOT brief")
    known = "EXISTS (SELECT 1 FROM h2 WHERE h2.note_id = ap.note_id AND h2.num = ap.sec)"
    return CARD + u(
        sel(c, "error", "line_no + off", "'no definition: ' || name", f"cs WHERE {ok(k)} AND coalesce(definition, '') = ''"),
        sel(c, "error", "line_no + off", "'no appearance: ' || name", f"cs WHERE {own} AND coalesce(appears, '') = ''"),
        sel(c, "error", "appears_line + off", "'time in appearance: ' || name", f"ap0 WHERE {own} AND regexp_matches(appears, '{TIME}')"),
        sel(c, "error", "appears_line + off", "'bad appearance: ' || name", f"ap0 WHERE {own} AND len(a) = 0"),
        sel(c, "error", "appears_line + off", "'unknown section ' || sec || ': ' || name", f"ap WHERE {own} AND NOT {known}"),
        sel(c, "warning", "appears_line + off", "'single section: ' || name", f"ap0 WHERE {own} AND len(a) > 0 AND len(list_distinct(list_transform(a, lambda q: CAST(q AS INT)))) < 2"),
        sel(c, "warning", "depends_line + off", "'unknown dependency: ' || r", f"(SELECT *, trim(unnest(regexp_split_to_array(depends, '[、,，;；]'))) AS r FROM cs WHERE {ok(k)}) d WHERE r <> '' AND NOT EXISTS (SELECT 1 FROM cards z WHERE z.note_id = d.note_id AND z.name = r)"),
        sel(c, "warning", "confusable_line + off", "'unknown confusable: ' || r", f"(SELECT *, trim(regexp_split_to_array(confusable, '——|--')[1]) AS r FROM cs WHERE {ok(k)}) d WHERE r <> '' AND NOT EXISTS (SELECT 1 FROM cards z WHERE z.note_id = d.note_id AND z.name = r)"),
        *([] if k == "V3" else [sel(c, "warning", "appears_line + off", "'title differs: ' || title", rf"""ap WHERE {own} AND {known} AND trim(regexp_replace(title, '^\s*\d{{1,2}}\s*[.、．)）]\s*', '')) <>
            (SELECT arg_max(norm, n) FROM hs WHERE hs.note_id = ap.note_id AND hs.num = ap.sec)""")]))


def quizzes(k: str) -> str:
    c = f"{k}-E5"
    nb = "" if k == "V3" else " AND NOT brief"
    fold = " AND folded" if k == "V3" else ""
    unknown = "NOT EXISTS (SELECT 1 FROM cards z WHERE z.note_id = qs.note_id AND z.name = correspond)"
    cnt = "(SELECT note_id, any_value(p.kind) AS kind, any_value(nt) AS nt, any_value(brief) AS brief, (SELECT count(*) FROM quiz WHERE quiz.note_id = p.note_id) AS c FROM p WHERE quiz_n IS NOT NULL GROUP BY note_id)"
    raw = "EXISTS (SELECT 1 FROM qx WHERE qx.note_id = qs.note_id AND qx.no = qs.no AND (extra OR {first}) AND regexp_matches(s, '{t}'))"
    parts = [
        sel(c, "error", "NULL", "'no quiz'", f"p WHERE {ok(k)}{nb} AND quiz_n IS NULL"),
        sel(c, "error", "NULL", "'quiz count ' || c", f"{cnt} WHERE {ok(k)}{nb} AND NOT (CASE WHEN nt = 'short' THEN c BETWEEN 2 AND 3 ELSE c BETWEEN 4 AND 7 END)"),
        sel(c, "error", "line_no + off", "'no concept: ' || no", f"qs WHERE {ok(k)} AND nt = 'lecture' AND correspond IS NULL"),
        sel(c, "error", "line_no + off", "'unknown concept: ' || correspond", f"qs WHERE {ok(k)} AND nt = 'lecture' AND correspond IS NOT NULL AND {unknown}"),
        sel(c, "warning", "line_no + off", "'yes/no stem: ' || no", rf"qs WHERE {ok(k)} AND regexp_matches(stem, '^(?:是否|是不是|对吗)|吗\s*[？?]\s*$')"),
        sel(c, "warning", "line_no + off", "'answer has ' || extra_lines || ' more lines: ' || no", f"qs WHERE {ok(k)} AND answered AND extra_lines > 0{fold}"),
    ]
    if k == "V3":
        parts += [sel(c, "error", "line_no + off", "'not folded: ' || no", f"qs WHERE {ok(k)} AND NOT folded"),
                  sel(c, "error", "line_no + off", "'no answer: ' || no", f"qs WHERE {ok(k)} AND folded AND NOT answered"),
                  sel(c, "error", "line_no + off", "'time in answer: ' || no", f"qs WHERE {ok(k)} AND folded AND answered AND " + raw.format(first="is_answer", t=r"（\d{1,3}:\d{2}(?::\d{2})?）"))]
    else:
        parts += [sel(c, "error", "line_no + off", "'folded: ' || no", f"qs WHERE {ok(k)} AND folded"),
                  sel(c, "error", "line_no + off", "'no answer: ' || no", f"qs WHERE {ok(k)} AND NOT answered"),
                  sel(c, "error", "line_no + off", "'time in answer: ' || no", f"qs WHERE {ok(k)} AND " + raw.format(first="n = first_answer", t=TIME.replace("{", "{{").replace("}", "}}")).replace("{{", "{").replace("}}", "}"))]
    return QUIZZES + u(*parts)


def titles(k: str) -> str:
    words = md.STRUCTURAL_V3 if k == "V3" else md.STRUCTURAL_V4
    return sel(f"{k}-E2", "warning", "line_no + off", "'title differs: ' || title", rf"""es WHERE {ok(k)} AND NOT EXISTS (SELECT 1 FROM hs WHERE hs.note_id = es.note_id AND {skip(words)}
        AND hs.norm = trim(regexp_replace(es.title, '^\s*\d{{1,2}}\s*[.、．)）]\s*', '')))""")


EMPTY = "(SELECT * FROM p WHERE nav_n IS NOT NULL AND NOT EXISTS (SELECT 1 FROM nav WHERE nav.note_id = p.note_id))"
VALID = r"""CASE WHEN plat = 'youtube' OR (kind LIKE 'v4%' AND plat = '' AND contains(url, 'youtube.com'))
    THEN regexp_full_match(url, 'https://www\.youtube\.com/watch\?v=' || CASE WHEN ident = '' THEN '[A-Za-z0-9_-]{11}' ELSE ident END || '&t=\d+s')
    ELSE regexp_full_match(url, 'https://www\.bilibili\.com/video/' || CASE WHEN ident = '' THEN '\S+' ELSE ident END || '\?p=\d+&t=\d+') END"""


def links(k: str) -> str:
    return NAVS + u(
        sel(f"{k}-E3", "error", "line_no + off", "'link format: ' || left(url, 60)", f"es WHERE {ok(k)} AND url IS NOT NULL AND NOT {VALID}"),
        sel(f"{k}-E3", "warning", "line_no + off", "'no link'", f"es WHERE {ok(k)} AND url IS NULL AND nt = 'lecture' AND plat IN ('bilibili', 'youtube')"))


def sources(k: str) -> str:
    langs = ", ".join(f"'{x}'" for x in op.CODE_LANGS)
    return LINES + r""", fl AS (SELECT note_id, kind, off, n, lower(regexp_extract(s, '^\s*```(\S*)\s*$', 1)) AS lang, row_number() OVER (PARTITION BY note_id ORDER BY n) AS i,
            lead(n) OVER (PARTITION BY note_id ORDER BY n) AS c FROM lx WHERE regexp_matches(s, '^\s*```(\S*)\s*$'))""" + u(
        sel(f"{k}-E7", "error", "lx.n + lx.off", "'source with time'", f"fl JOIN lx ON lx.note_id = fl.note_id AND lx.n > fl.n AND lx.n <= fl.c + 2 AND lx.n <> fl.c WHERE lx.{ok(k)} AND i % 2 = 1 AND lang IN ({langs}) AND contains(s, '来源') AND regexp_matches(s, '{TIME}')", "lx.note_id"),
        sel(f"{k}-E7", "error", "NULL", "'open fence'", f"(SELECT note_id, any_value(kind) AS kind, count(*) AS m FROM fl GROUP BY 1) WHERE {ok(k)} AND m % 2 = 1"))


KM_FIRST = r""",
    kf AS (SELECT k.note_id, k.o, coalesce((SELECT arg_min(trim(s), n) FROM lx WHERE lx.note_id = k.note_id AND lx.n > k.o AND lx.n < k.c AND trim(s) <> ''), '') AS first,
                  coalesce((SELECT max(length(s) - length(ltrim(s))) FROM (SELECT s, row_number() OVER (ORDER BY n) AS r FROM lx WHERE lx.note_id = k.note_id AND lx.n > k.o AND lx.n < k.c AND trim(s) <> '') WHERE r > 1), 0) AS ind
           FROM kmb k),
    kb AS (SELECT *, NOT regexp_matches(first, '^(?:mindmap|graph|flowchart)\b') AS bad, starts_with(first, 'mindmap') AND ind < 2 AS flat FROM kf)"""


def maps(k: str) -> str:
    return MAPS + KM_FIRST + u(
        sel(f"{k}-KM", "error", "NULL", "'no map section'", f"p WHERE {ok(k)} AND nt = 'lecture' AND map_n IS NULL"),
        sel(f"{k}-KM", "error", "NULL", "'no mermaid block'", f"p WHERE {ok(k)} AND nt = 'lecture' AND map_n IS NOT NULL AND NOT EXISTS (SELECT 1 FROM kmb WHERE kmb.note_id = p.note_id)"),
        sel(f"{k}-KM", "error", "NULL", "'bad first line: ' || left(first, 30)", f"kb JOIN p USING (note_id) WHERE {ok(k)} AND nt = 'lecture' AND bad"),
        sel(f"{k}-KM", "error", "NULL", "'mindmap without children'", f"kb JOIN p USING (note_id) WHERE {ok(k)} AND nt = 'lecture' AND flat"))


def empty_sections(k: str) -> str:
    brief = "" if k == "V3" else " AND NOT brief"
    return LINES + sel(f"{k}-SEC", "error", "NULL", "t || ': ' || subs", f"hs WHERE {ok(k)}{brief} AND {skip(md.STRUCTURAL_V3)} AND subs < 3")


def labels(k: str) -> str:
    return rec(BASE) + r""",
    fa AS (SELECT note_id, n, lower(regexp_extract(s, '^\s*```(\S*)\s*$', 1)) AS lang, regexp_matches(s, '^\s*```(\S*)\s*$') AS isl, row_number() OVER (PARTITION BY note_id ORDER BY n) AS i FROM lx WHERE isf),
    fr AS (SELECT note_id, i, lang, n AS o, isl AS opened, n FROM fa WHERE i = 1
           UNION ALL SELECT fa.note_id, fa.i, fa.lang, fa.n, NOT fr.opened AND fa.isl, fa.n FROM fr JOIN fa ON fa.note_id = fr.note_id AND fa.i = fr.i + 1),
    ab AS (SELECT note_id, lang, o, coalesce((SELECT min(n) FROM fr z WHERE z.note_id = r.note_id AND z.n > r.o), 1000000) AS c FROM fr r WHERE opened),
    bl AS (SELECT ab.*, coalesce((SELECT arg_min(trim(s), n) FROM lx WHERE lx.note_id = ab.note_id AND lx.n > o AND lx.n < c AND trim(s) <> ''), '') AS first FROM ab WHERE lang = 'mermaid'),
    mb AS (SELECT lx.note_id, lx.kind, lx.off, lx.n, trim(s) AS s, starts_with(first, 'mindmap') AS mind FROM bl JOIN lx ON lx.note_id = bl.note_id AND lx.n > o AND lx.n < c
           WHERE regexp_matches(first, '^(?:mindmap|graph|flowchart)\b') AND trim(s) <> '' AND NOT starts_with(trim(s), '%%')),
    lb AS (SELECT note_id, kind, off, n, CASE WHEN regexp_matches(s, '^(?:\w+\s*)?\(\((.+)\)\)$') THEN regexp_extract(s, '^(?:\w+\s*)?\(\((.+)\)\)$', 1)
                WHEN regexp_matches(s, '^\{\{(.+)\}\}$') THEN regexp_extract(s, '^\{\{(.+)\}\}$', 1) WHEN regexp_matches(s, '^\((.+)\)$') THEN regexp_extract(s, '^\((.+)\)$', 1)
                WHEN regexp_matches(s, '^\[(.+)\]$') THEN regexp_extract(s, '^\[(.+)\]$', 1) ELSE s END AS label FROM mb WHERE mind AND NOT starts_with(s, '::')
           UNION ALL SELECT note_id, kind, off, n, trim(unnest(regexp_extract_all(s, '\[([^\[\]]+)\]', 1))) FROM mb WHERE NOT mind),
    lw AS (SELECT *, regexp_matches(label, '[()\[\]{}"]') AS has_brackets,
                  (length(label) + len(regexp_extract_all(label, '""" + md.WIDE + r"""'))) / 2.0::DOUBLE AS width FROM lb)"""


SQL: dict[str, str] = {}
for _k in ("V3", "V4"):
    SQL[f"{_k}-E1"] = times(_k)
    SQL[f"{_k}-E4"] = residue(_k)
    SQL[f"{_k}-E6"] = cards(_k)
    SQL[f"{_k}-E5"] = quizzes(_k)
    SQL[f"{_k}-E3"] = links(_k)
    SQL[f"{_k}-E7"] = sources(_k)
    SQL[f"{_k}-KM"] = maps(_k)
    SQL[f"{_k}-SEC"] = empty_sections(_k)
    SQL[f"{_k}-KM-LABEL"] = labels(_k) + sel(f"{_k}-KM-LABEL", "warning", "n + off", "'label: ' || left(label, 30)", f"lw WHERE {ok(_k)} AND (has_brackets OR width > 12)")
SQL["V4-NT"] = LINES + sel("V4-NT", "error", "NULL", "'note type: ' || nt", "p WHERE kind LIKE 'v4%' AND nt NOT IN ('lecture', 'short', 'brief')")
SQL["V3-NT"] = LINES + sel("V3-NT", "error", "NULL", "'note type: ' || nt", "p WHERE kind = 'v3' AND nt <> '' AND nt NOT IN ('lecture', 'short')")
SQL["V4-FM"] = LINES + sel("V4-FM", "error", "1", "'front matter'", "p WHERE kind = 'v4' AND c IS NOT NULL")
SQL["V4-HEAD"] = LINES + r""",
    fb AS (SELECT p.*, (SELECT min(n) FROM lx WHERE lx.note_id = p.note_id AND trim(s) <> '') AS b FROM p WHERE kind LIKE 'v4%'),
    fq AS (SELECT fb.*, regexp_matches((SELECT s FROM lx WHERE lx.note_id = fb.note_id AND lx.n = b), '^>\s*核心主线[：:]') AS q,
                  coalesce((SELECT min(n) FROM lx WHERE lx.note_id = fb.note_id AND n > b AND trim(s) = ''), 1000000) AS stop FROM fb)""" + u(
    sel("V4-HEAD", "error", "n + off", "'top heading'", r"ln WHERE kind LIKE 'v4%' AND NOT f AND regexp_matches(s, '^#\s+\S')"),
    sel("V4-HEAD", "error", "coalesce(b, 1) + off", "'no main thread'", "fq WHERE NOT coalesce(q, FALSE) AND NOT (kind = 'v4' AND c IS NOT NULL)"),
    sel("V4-HEAD", "error", "b + off", "'no source'", "fq WHERE q AND NOT EXISTS (SELECT 1 FROM lx WHERE lx.note_id = fq.note_id AND lx.n >= b AND lx.n < stop AND contains(s, '课程来源'))"))
SQL["V4-NAME"] = LINES + sel("V4-NAME", "warning", "NULL", "'file name: ' || split_part(path, '/', 2)", r"p WHERE kind LIKE 'v4%' AND NOT regexp_matches(split_part(path, '/', 2), '^\d+(?:\.\d+)*-\S.*\.md$')")
SQL["V4-LIST"] = LINES + sel("V4-LIST", "warning", "min(n) + any_value(off)", "count(*) || ' lines'", r"ln WHERE kind LIKE 'v4%' AND NOT f AND regexp_matches(s, '^\s*[-*]\s+\S') GROUP BY note_id")
SQL["V4-IDEA"] = LINES + sel("V4-IDEA", "warning", "n + off", "t", rf"hs WHERE kind LIKE 'v4%' AND NOT brief AND NOT f AND {skip(md.STRUCTURAL_V4)} AND NOT regexp_matches(last_sub, '^\s*>\s*\*\*记住这个就够了(?:\*\*\s*[：:]|[：:]\*\*)\s*\S')")
SQL["V3-IDEA"] = LINES + sel("V3-IDEA", "error", "NULL", "t", f"hs WHERE kind = 'v3' AND {skip(md.STRUCTURAL_IDEA)} AND NOT starts_with(first_sub, '**核心思想：**')")
SQL["V4-ANALOGY"] = LINES + sel("V4-ANALOGY", "warning", "n + off", "'analogy label'", r"""ln WHERE kind LIKE 'v4%' AND NOT ex AND NOT f AND regexp_matches(s, '^\s*(?:[+>]\s*)?\*\*打个比方')
    AND NOT regexp_matches(s, '^\s*(?:[+>]\s*)?\*\*打个比方(?:（笔记补充）)?(?:[：:]\*\*|\*\*\s*[：:])')""")
SQL["V4-YUQUE"] = LINES + u(
    sel("V4-YUQUE", "warning", "n + off", "'subgraph'", r"ln WHERE kind LIKE 'v4%' AND f AND regexp_matches(s, '^\s*subgraph\s+[^\s\[]+\s*\[')"),
    sel("V4-YUQUE", "warning", "n + off", "'text fence'", r"ln WHERE kind LIKE 'v4%' AND regexp_matches(s, '^\s*```\s*text\s*$')"))
SQL["V4-TERM"] = CARD + r""",
    hc AS (SELECT note_id, off, line_no, trim(replace(name, '**', '')) AS name, original FROM cs WHERE foreigner AND regexp_matches(replace(name, '**', ''), '[\x{3400}-\x{9fff}]')),
    tl AS (SELECT lx.note_id, lx.n, replace(s, '**', '') AS s FROM lx WHERE NOT f AND g > 0 AND n > g AND EXISTS (SELECT 1 FROM h2 WHERE h2.note_id = lx.note_id AND h2.n = lx.g AND h2.num IS NOT NULL)),
    fu AS (SELECT hc.note_id, hc.off, hc.name, hc.line_no, min(tl.n) AS n, arg_min(tl.s, tl.n) AS s FROM hc JOIN tl ON tl.note_id = hc.note_id AND contains(tl.s, hc.name) GROUP BY ALL)""" + u(
    sel("V4-TERM", "warning", "line_no + off", "'no original: ' || name", "hc WHERE trim(coalesce(original, '')) = ''"),
    sel("V4-TERM", "warning", "n + off", "'first use: ' || name", r"fu WHERE NOT regexp_matches(substring(s, instr(s, name) + length(name)), '^(?:（[^（）]*\S[^（）]*）|\([^()]*\S[^()]*\))')"))
SQL["V4-QA"] = QUIZZES + sel("V4-QA", "warning", "line_no + off", r"'answer length ' || length(regexp_replace(answer, '[\s*`]', '', 'g'))", r"qs WHERE kind LIKE 'v4%' AND answered AND length(regexp_replace(answer, '[\s*`]', '', 'g')) < 40")
SQL["V4-SUM"] = LINES + r""",
    su AS (SELECT p.note_id, p.off, p.sum_n,
              (SELECT count(*) FROM inn WHERE inn.note_id = p.note_id AND w = '本讲小结' AND NOT f AND regexp_matches(s, '^\s*\|.*\|\s*$') AND NOT regexp_matches(s, '^\s*\|?\s*:?-{3,}:?\s*(?:\|\s*:?-{3,}:?\s*)*\|?\s*$')
                AND NOT regexp_matches(s, '^\|---\|:-:\|---\|$')) AS r,
              (SELECT min(n) FROM inn WHERE inn.note_id = p.note_id AND w = '本讲小结' AND NOT f AND regexp_matches(s, '学完能说的\s*(?:3|三)\s*句话')) AS m
           FROM p WHERE kind LIKE 'v4%' AND NOT brief AND sum_n IS NOT NULL),
    sk AS (SELECT su.*, (SELECT count(*) FROM inn WHERE inn.note_id = su.note_id AND w = '本讲小结' AND n > m AND NOT f AND regexp_matches(s, '^\s*\d{1,2}\s*[.、．)）]\s*\S')) AS k FROM su)""".replace("AND NOT regexp_matches(s, '^\\|---\\|:-:\\|---\\|$')", "") + u(
    sel("V4-SUM", "warning", "NULL", "'no summary'", "p WHERE kind LIKE 'v4%' AND nt = 'lecture' AND sum_n IS NULL"),
    sel("V4-SUM", "warning", "sum_n + off", "'table rows'", "su WHERE r < 3"),
    sel("V4-SUM", "warning", "sum_n + off", "'no three sentences'", "su WHERE m IS NULL"),
    sel("V4-SUM", "warning", "m + off", "'sentence count'", "sk WHERE m IS NOT NULL AND k <> 3"))
SQL["V4-E2"] = NAVS + u(
    sel("V4-E2", "error", "n + off", "'marker'", r"ln WHERE kind LIKE 'v4%' AND regexp_matches(s, '<!--\s*NAV:(BEGIN|END)')"),
    sel("V4-E2", "error", "nav_n + off", "'index not last'", "p WHERE kind LIKE 'v4%' AND nav_n IS NOT NULL AND nav_e <> total + 1"),
    sel("V4-E2", "error", "n + off", "'folded index'", r"inn WHERE kind LIKE 'v4%' AND w = '视频时间索引' AND regexp_matches(s, '(?i)<details\b')"),
    sel("V4-E2", "error", "nav_n + off", "'no entries'", EMPTY + " WHERE kind LIKE 'v4%'"),
    sel("V4-E2", "error", "NULL", "'no index'", "p WHERE kind LIKE 'v4%' AND nav_n IS NULL AND nt = 'lecture'"), titles("V4"))
SQL["V3-E2"] = NAVS + u(
    sel("V3-E2", "error", "NULL", "'markers not paired'", "p WHERE kind = 'v3' AND nav_n IS NOT NULL AND NOT coalesce(paired, FALSE)"),
    sel("V3-E2", "error", "NULL", "'index outside markers'", "p WHERE kind = 'v3' AND nav_n IS NOT NULL AND paired AND NOT nav_n BETWEEN nb AND ne"),
    sel("V3-E2", "error", "NULL", "'no entries'", EMPTY + " WHERE kind = 'v3'"),
    sel("V3-E2", "error", "NULL", "'no index'", "p WHERE kind = 'v3' AND nav_n IS NULL AND nt = 'lecture'"), titles("V3"))
_NORM = r"""lower(regexp_replace({}, '[（(][^）)]*[）)]|\s|[“”"''`]', '', 'g'))"""
SQL["V4-KM-REL"] = MAPS + KM_FIRST + rf""",
    okm AS (SELECT p.*, (SELECT labeled_edges FROM edges WHERE edges.note_id = p.note_id) AS lab FROM p WHERE kind LIKE 'v4%' AND nt = 'lecture' AND EXISTS (SELECT 1 FROM kb WHERE kb.note_id = p.note_id)
            AND NOT EXISTS (SELECT 1 FROM kb WHERE kb.note_id = p.note_id AND (bad OR flat))),
    cn AS (SELECT DISTINCT note_id, name, {_NORM.format('name')} AS cnorm FROM cards),
    nn AS (SELECT note_id, {_NORM.format('label')} AS l FROM nodes WHERE label <> ''),
    sn AS (SELECT DISTINCT note_id, {_NORM.format('norm')} AS l FROM hs WHERE {skip(md.STRUCTURAL_V4)} AND t <> ''),
    th AS (SELECT okm.note_id, (SELECT count(*) FROM nn WHERE nn.note_id = okm.note_id AND l IN (SELECT l FROM sn WHERE sn.note_id = okm.note_id) AND l NOT IN (SELECT cnorm FROM cn WHERE cn.note_id = okm.note_id)) AS hits,
                  (SELECT count(*) FROM sn WHERE sn.note_id = okm.note_id) AS m FROM okm)""" + u(
    sel("V4-KM-REL", "error", "NULL", "'not on the map: ' || cn.name", "okm JOIN cn ON cn.note_id = okm.note_id WHERE NOT EXISTS (SELECT 1 FROM nn WHERE nn.note_id = cn.note_id AND (contains(l, cnorm) OR (length(l) >= 2 AND contains(cnorm, l))))", "okm.note_id"),
    sel("V4-KM-REL", "error", "NULL", "'labelled edges ' || lab", "okm WHERE lab < greatest(1, (SELECT count(*) FROM cn WHERE cn.note_id = okm.note_id) - 1)"),
    sel("V4-KM-REL", "warning", "NULL", "'section nodes ' || hits", "th WHERE m > 0 AND hits >= greatest(2, 0.5 * m)"))
SQL["V4-SHOT"] = LINES + r""",
    i0 AS (SELECT note_id, off, n, g, unnest(regexp_extract_all(s, '!\[([^\]]*)\]\(([^)\s]+)\)', 2)) AS path FROM lx WHERE NOT f AND kind LIKE 'v4%'),
    i1 AS (SELECT i0.*, h2.num, row_number() OVER (PARTITION BY i0.note_id, path ORDER BY i0.n) AS k FROM i0 LEFT JOIN h2 ON h2.note_id = i0.note_id AND h2.n = g WHERE starts_with(path, 'images/'))""" + u(
    sel("V4-SHOT", "warning", "n + off", "'repeated: ' || path", "i1 WHERE k > 1"), sel("V4-SHOT", "warning", "n + off", "'outside a section: ' || path", "i1 WHERE k = 1 AND num IS NULL"))
SQL["V4B-POINTS"] = LINES + r""",
    pb AS (SELECT p.*, (SELECT min(n) FROM h2 WHERE h2.note_id = p.note_id AND NOT f AND t = '要点') AS pn FROM p WHERE brief),
    pt AS (SELECT pb.note_id, pb.off, pb.pn, lx.n, length(regexp_replace(regexp_extract(s, '^\s*\+\s+(\S.*)$', 1), '[\s*`]', '', 'g')) AS len FROM pb JOIN lx ON lx.note_id = pb.note_id AND lx.h = pb.pn AND lx.n > pb.pn
           WHERE NOT f AND regexp_matches(s, '^\s*\+\s+(\S.*)$'))""" + u(
    sel("V4B-POINTS", "error", "NULL", "'no points section'", "pb WHERE pn IS NULL"), sel("V4B-POINTS", "error", "n + off", "'short point ' || len", "pt WHERE len < 8"),
    sel("V4B-POINTS", "error", "pn + off", "'points ' || c", "(SELECT pb.*, (SELECT count(*) FROM pt WHERE pt.note_id = pb.note_id) AS c FROM pb) WHERE pn IS NOT NULL AND c NOT BETWEEN 3 AND 7"))
SQL["V4B-EMPTY"] = LINES + sel("V4B-EMPTY", "error", "NULL", "t", "hs WHERE brief AND NOT contains(t, '视频时间索引') AND NOT EXISTS (SELECT 1 FROM lx WHERE lx.note_id = hs.note_id AND lx.h = hs.n AND lx.n > hs.n AND trim(s) NOT IN ('', '---') AND NOT starts_with(ltrim(s), '#'))")
SQL["V4B-NUM"] = LINES + sel("V4B-NUM", "warning", "min(n) + any_value(off)", "'numbered sections ' || count(*)", "hs WHERE brief AND NOT f AND num IS NOT NULL GROUP BY note_id")
SQL["V4B-CARDS"] = CARD + sel("V4B-CARDS", "warning", "any_value(cards_n) + any_value(p.off)", "'cards ' || count(*)", "p JOIN cards c ON c.note_id = p.note_id WHERE brief GROUP BY p.note_id HAVING count(*) > 3", "p.note_id")
SQL["V4B-QUIZ"] = QUIZZES + sel("V4B-QUIZ", "warning", "any_value(quiz_n) + any_value(p.off)", "'questions ' || count(*)", "p JOIN quiz c ON c.note_id = p.note_id WHERE brief GROUP BY p.note_id HAVING count(*) > 2", "p.note_id")
SQL["V4O-TOC"] = LINES + r""",
    tc AS (SELECT p.note_id, p.off, (SELECT min(n) FROM h2 WHERE h2.note_id = p.note_id AND NOT f AND t = '目录') AS tn FROM p WHERE kind = 'v4-obsidian'),
    ti AS (SELECT tc.note_id, tc.off, lx.n, s, regexp_matches(s, '^\s*[-+*]\s+') AS item, regexp_matches(s, '^\s*[-+*]\s+\[\[#([^\]|]+)\]\]\s*$') AND EXISTS (SELECT 1 FROM h2 WHERE h2.note_id = tc.note_id AND NOT h2.f AND t <> '目录'
              AND t = regexp_extract(s, '^\s*[-+*]\s+\[\[#([^\]|]+)\]\]\s*$', 1)) AS good FROM tc JOIN lx ON lx.note_id = tc.note_id AND lx.g = tn AND lx.n > tn WHERE NOT f)""" + u(
    sel("V4O-TOC", "warning", "n + off", "'classic anchor'", "ti WHERE contains(s, '](#')"), sel("V4O-TOC", "error", "n + off", "'bad toc entry'", "ti WHERE item AND NOT good"),
    sel("V4O-TOC", "error", "coalesce(tn, 1) + off", "'no toc entry'", "tc WHERE NOT EXISTS (SELECT 1 FROM ti WHERE ti.note_id = tc.note_id AND good)"))
SQL["V3-FM"] = LINES + sel("V3-FM", "error", "NULL", "'missing ' || k", """(SELECT p.note_id, k FROM p, (VALUES ('template_version'), ('note_type'), ('platform'), ('source'), ('created'), ('duration'), ('bvid'), ('video_id')) v(k)
    WHERE kind = 'v3' AND (k <> 'bvid' OR plat <> 'youtube') AND (k <> 'video_id' OR plat = 'youtube')) x WHERE NOT EXISTS (SELECT 1 FROM fm WHERE fm.note_id = x.note_id AND fm.key = k AND value <> '')""")
SQL["VERSION"] = LINES + sel("VERSION", "error", "1", "'template version: ' || coalesce(tv, '')", "p WHERE kind = 'unknown'")


def _register(rule: str) -> None:
    @REG.query("lint_" + rule.lower().replace("-", "_"), SQL.get(rule))
    def _(t):
        return op.text_findings(op.parse_notes(notes(t), [rule]), [rule])


for _rule in (*op.RULES, *op.FILE_RULES):
    _register(_rule)


@REG.query("dispatch_template", BASE + " SELECT note_id, kind FROM kz")
def _(t):
    return op.dispatch_template(notes(t))


@REG.query("mermaid_label_check", labels("V4") + " SELECT note_id, n AS line_no, label, has_brackets, width FROM lw WHERE has_brackets OR width > 12")
def _(t):
    return md.mermaid_label_check(notes(t))


def _transcripts(t):
    return stamped_docs(t).filter("video_id % 6 <> 4").select("video_id", "page", "text")


_HEARD = NAVS.replace("notes AS (", "notes AS (", 1).replace("WITH doc_lines", "WITH doc_lines", 1) + """,
    heard AS (SELECT video_id, page, line_no, CAST(regexp_extract(line, '^\\[(\\d{1,3}):(\\d{2})\\]', 1) AS INT) * 60 + CAST(regexp_extract(line, '^\\[(\\d{1,3}):(\\d{2})\\]', 2) AS INT) AS ts
              FROM stamped_lines WHERE video_id % 6 <> 4 AND regexp_matches(line, '^\\[(\\d{1,3}):(\\d{2})\\]')),
    en AS (SELECT es.*, p.video_id, p.only_page FROM es JOIN p ON p.note_id = es.note_id WHERE es.kind <> 'unknown'),
    pre AS (SELECT *, upper(left(kind, 2)) AS pre FROM p WHERE kind <> 'unknown'),
    lc AS (SELECT en.note_id, en.line_no, h.ts, row_number() OVER (PARTITION BY en.note_id, en.line_no ORDER BY h.page, h.line_no) AS r
           FROM en JOIN heard h ON h.video_id = en.video_id AND abs(h.ts - en.ts_sec) <= 5 AND (only_page IS NULL OR only_page = h.page)),
    spoken AS (SELECT video_id, sum(length(regexp_replace(line, '""" + BLANK + """+', '', 'g'))) AS sp FROM stamped_lines WHERE video_id % 6 <> 4 GROUP BY 1),
    ra AS (SELECT pre.note_id, pre.pre, sp, (SELECT sum(length(regexp_replace(s, '""" + BLANK + """+', '', 'g'))) FROM lx WHERE lx.note_id = pre.note_id) AS wr FROM pre LEFT JOIN spoken ON spoken.video_id = pre.video_id)"""
_HEARD = _HEARD.replace("notes AS (", "stamped_lines AS (" + with_inputs("stamped_lines").split("stamped_lines AS (", 1)[1] + ",\n notes AS (", 1)


def _f(check: str, severity: str, line: str, message: str, rest: str) -> str:
    return f" SELECT note_id, {check} AS \"check\", '{severity}' AS severity, CAST({line} AS INT) AS line, CAST({message} AS VARCHAR) AS message FROM {rest}"


@REG.query("lint_transcript_rules", _HEARD + u(
    _f("upper(left(kind, 2)) || '-E2'", "error", "line_no + off", "'off whitelist: ' || ts_sec", "en WHERE EXISTS (SELECT 1 FROM heard h WHERE h.video_id = en.video_id) AND NOT EXISTS (SELECT 1 FROM heard h WHERE h.video_id = en.video_id AND abs(h.ts - en.ts_sec) <= 5)"),
    _f("pre || '-E2'", "warning", "NULL", "'no transcript times'", "pre WHERE EXISTS (SELECT 1 FROM en WHERE en.note_id = pre.note_id) AND NOT EXISTS (SELECT 1 FROM heard h WHERE h.video_id = pre.video_id)"),
    _f("pre || '-E3'", "warning", "NULL", "'links not verifiable'", "pre WHERE EXISTS (SELECT 1 FROM en WHERE en.note_id = pre.note_id AND url IS NOT NULL) AND NOT EXISTS (SELECT 1 FROM heard h WHERE h.video_id = pre.video_id)"),
    _f("upper(left(kind, 2)) || '-E3'", "error", "line_no + off", r"'link second ' || CAST(regexp_extract(url, '&t=(\d+)s?$', 1) AS BIGINT) || ' should be ' || ts",
       rf"en JOIN (SELECT note_id, line_no, ts FROM lc WHERE r = 1) USING (note_id, line_no) WHERE url IS NOT NULL AND {VALID} AND CAST(regexp_extract(url, '&t=(\d+)s?$', 1) AS BIGINT) <> ts"),
    _f("pre || '-RATIO'", "warning", "NULL", "CASE WHEN wr < sp * 0.03 THEN 'too short' ELSE 'too long' END", "ra WHERE sp > 0 AND NOT (wr / sp BETWEEN 0.03 AND 1.2)"),
    _f("pre || '-RATIO'", "warning", "NULL", "'no transcript'", "ra WHERE coalesce(sp, 0) = 0")))
def _(t):
    return op.transcript_findings(op.parse_notes(notes(t), [op.TRANSCRIPTS]), _transcripts(t))


# The generated inventory and manifest list images of the notes, which are written and parsed once for them and the rules.
def _manifest(facts):
    refs = md.image_refs(facts).filter("line_no % 5 > 0")
    return refs.selectExpr(
        "note_id", "substring_index(path, '/', -1) AS file", "IF(line_no % 2 = 0, 'cap', 'other') AS keyword",
        "CAST(line_no * 10 AS DOUBLE) AS t", "CAST(section + line_no % 2 AS INT) AS section").dropDuplicates(["note_id", "file"])


def _inventory(facts):
    return md.local_images(facts).filter("note_id % 3 > 0").select("note_id", "path")


_IMAGES = LINES + r""",
    i0 AS (SELECT note_id, kind, off, n, f, g, unnest(regexp_extract_all(s, '!\[([^\]]*)\]\(([^)\s]+)\)', 1)) AS alt, unnest(regexp_extract_all(s, '!\[([^\]]*)\]\(([^)\s]+)\)', 2)) AS path FROM lx WHERE kind <> 'unknown'),
    i1 AS (SELECT i0.*, h2.num FROM i0 LEFT JOIN h2 ON h2.note_id = i0.note_id AND h2.n = i0.g WHERE NOT i0.f AND starts_with(path, 'images/')),
    bare AS (SELECT note_id, kind, unnest(regexp_extract_all(s, '(?:^|[^(\w])(images/[\w./-]+\.(?:png|jpe?g|gif))\b', 1)) AS path FROM lx WHERE kind <> 'unknown'),
    refs AS (SELECT DISTINCT note_id, kind, path FROM (SELECT note_id, kind, path FROM i0 WHERE NOT regexp_matches(path, '^https?://') UNION ALL SELECT * FROM bare)),
    mf AS (SELECT DISTINCT note_id, n, path, CASE WHEN n % 2 = 0 THEN 'cap' ELSE 'other' END AS kw, num + n % 2 AS section FROM i1 WHERE n % 5 > 0)"""


@REG.query("lint_image_rules", _IMAGES + u(
    _f("upper(left(kind, 2)) || '-IMG'", "error", "NULL", "'missing image: ' || path", "refs WHERE note_id % 3 = 0"),
    _f("'V4-SHOT'", "warning", "n + off", "'belongs to section ' || section", "i1 JOIN (SELECT note_id, path, section FROM mf) m USING (note_id, path) WHERE kind LIKE 'v4%' AND num IS NOT NULL AND section <> num"),
    _f("upper(left(kind, 2)) || '-MANIFEST'", "warning", "NULL", "'caption without keyword: ' || split_part(path, '/', 2)", "i1 JOIN (SELECT note_id, path, kw FROM mf) m USING (note_id, path) WHERE NOT contains(alt, kw)")))
def _(t):
    facts = op.note_facts(op.parse_notes(notes(t), [op.IMAGES]), (op.IMAGES,))
    return op.image_findings(facts, _inventory(facts), _manifest(facts))


@REG.query("lint_notes")
def _(t):
    facts = op.note_facts(op.parse_notes(notes(t)), rules=None)
    return op.lint_notes(facts, _transcripts(t), _inventory(facts), _manifest(facts))


@REG.query("gate_summary", LINES + """,
    fs AS (""" + sel("V4-LIST", "warning", "min(n) + any_value(off)", "count(*) || ' lines'", r"ln WHERE kind LIKE 'v4%' AND NOT f AND regexp_matches(s, '^\s*[-*]\s+\S') GROUP BY note_id")
    + " UNION ALL " + sel("V4-E1", "error", "n + off", "'time mark: ' || z", f"(SELECT note_id, n, off, unnest(regexp_extract_all(s, '{TIME}')) AS z FROM ln WHERE kind LIKE 'v4%' AND NOT ex)") + """),
    r AS (SELECT *, row_number() OVER (PARTITION BY note_id, severity ORDER BY coalesce(line, 0), "check", message) AS k FROM fs)
    SELECT n.note_id, sha256(text) AS sha, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings,
           count(*) FILTER (severity = 'error') = 0 AS ok, coalesce(string_agg("check" || ': ' || message, '; ' ORDER BY k) FILTER (severity = 'error' AND k <= 3), '') AS first_errors
    FROM notes n LEFT JOIN r ON r.note_id = n.note_id GROUP BY n.note_id, text""")
def _(t):
    n = notes(t)
    return op.gate_summary(n, op.text_findings(op.parse_notes(n, ["V4-LIST", "V4-E1"]), ["V4-LIST", "V4-E1"]))
