"""Quality gate for notes: findings ``(note_id, check, severity, line, message)``.

Rules that need only the note are expressions over the parsed note and run in one pass
without a shuffle. Rules that need transcripts, images or a manifest join small tables cut
from the notes (entries, image references) to those, never the note texts.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from lectern.functions import text as tx
from lectern.operators import markdown as md
from lectern.operators.captions import parse_ts_lines
from lectern.operators.markdown import _with, all_matches, first, has_any, norm_title, rx, span, strip_sql, substantive
from lectern.operators.timeindex import locate_page, near_lines
from lectern.session import durable_checkpoint

# Words, limits and formats of the gate.
TAGS = ("核心必考", "重点掌握", "了解即可")
TAG_WORDS = f"(?:{'|'.join(TAGS)})"
TAG_V3 = rf"^\s*(?:[-*]\s*)?(?:\*\*{TAG_WORDS}\*\*|[（(]{TAG_WORDS}[）)])"
TAG_V4 = rf"^\s*(?:[-*+]\s*)?(?:\*\*{TAG_WORDS}\*\*|[（(]{TAG_WORDS}[）)])"
CARD_TAGGED = rf"^###\s+.+?[（(]{TAG_WORDS}[）)]\s*$"
MAIN_QUOTE = r"^>\s*核心主线[：:]"
FILE_NAME = r"^\d+(?:\.\d+)*-\S.*\.md$"
DASH_LIST = r"^\s*[-*]\s+\S"
RECALL = r"^\s*>\s*\*\*记住这个就够了(?:\*\*\s*[：:]|[：:]\*\*)\s*\S"
ANALOGY = r"^\s*(?:[+>]\s*)?\*\*打个比方"
ANALOGY_OK = r"^\s*(?:[+>]\s*)?\*\*打个比方(?:（笔记补充）)?(?:[：:]\*\*|\*\*\s*[：:])"
SUBGRAPH_BOX = r"^\s*subgraph\s+[^\s\[]+\s*\["
TEXT_FENCE = r"^\s*```\s*text\s*$"
THREE_LINES = r"学完能说的\s*(?:3|三)\s*句话"
TABLE_ROW = r"^\s*\|.*\|\s*$"
TABLE_RULE = r"^\s*\|?\s*:?-{3,}:?\s*(?:\|\s*:?-{3,}:?\s*)*\|?\s*$"
YES_NO = r"^(?:是否|是不是|对吗)|吗\s*[？?]\s*$"
TIME_FULLWIDTH = r"（\d{1,3}:\d{2}(?::\d{2})?）"
ORIGINAL_AFTER = r"^(?:（[^（）]*\S[^（）]*）|\([^()]*\S[^()]*\))"
PLUS_ITEM = r"^\s*\+\s+(\S.*)$"
ANCHOR_LINE = r"^\s*(?:[-*]\s+)?(?:★{1,3}|\*\*(?:核心必考|重点掌握|了解即可)\*\*|[（(](?:核心必考|重点掌握|了解即可)[）)])"
TIME_LINE = r"\[(\d{1,3}):(\d{2})\]"
CODE_LANGS = (
    "java", "python", "py", "js", "javascript", "ts", "typescript", "c", "cpp", "xml", "sql",
    "properties", "yaml", "yml", "json", "bash", "shell", "sh", "html", "css",
)
NOTE_TYPES = ("lecture", "short", "brief")
STRICT_FIELDS = ("template_version", "title", "note_type", "platform", "source", "duration", "created", "tags")
ANSWER_MIN = 40
RATIO_MIN, RATIO_MAX = 0.03, 1.2

V4 = "kind IN ('v4', 'v4-obsidian')"
V3 = "kind = 'v3'"
ANY = "kind <> 'unknown'"


def finding(check: str, severity: str, line: str, message: str) -> str:
    return (f"named_struct('check', '{check}', 'severity', '{severity}', 'line', CAST({line} AS INT), "
            f"'message', {message})")


def one(cond: str, check: str, severity: str, line: str, message: str) -> str:
    return f"filter(array({finding(check, severity, line, message)}), w -> coalesce({cond}, false))"


def each(items: str, check: str, severity: str, line: str, message: str) -> str:
    """One finding per element ``x`` of an array expression."""
    return f"transform({items}, x -> {finding(check, severity, line, message)})"


def _in(values: Sequence[str]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def _lines(cond: str) -> str:
    return f"filter(lx, x -> {cond})"


def _prepared() -> tuple[dict[str, str], ...]:
    """Note type, platform and the other facts several rules share, in steps that build on each other."""
    fm = md.fm_value
    return (dict(
        nt=f"""lower(trim(CASE WHEN {V3} THEN coalesce({fm('note_type')}, '')
            WHEN kind = 'v4-obsidian' AND coalesce(strict_type, '') <> '' THEN strict_type
            ELSE coalesce(note_type, 'lecture') END))""",
        plat=f"""lower(trim(CASE WHEN {V3} THEN coalesce({fm('platform')}, '')
            WHEN kind = 'v4-obsidian' THEN coalesce(strict_platform, platform, '') ELSE coalesce(platform, '') END))""",
        ident=f"""trim(CASE WHEN {V3} THEN coalesce(IF(lower({fm('platform')}) = 'youtube', {fm('video_id')}, {fm('bvid')}), '')
            WHEN kind = 'v4-obsidian' THEN coalesce(strict_vid, vid, '') ELSE coalesce(vid, '') END)""",
        fname="substring_index(path, '/', -1)",
        blanks=f"transform(filter(lx, x -> {strip_sql('x.s')} <> ''), x -> x.n)",
        marks=f"filter(lx, x -> contains(x.s, 'NAV:') AND (x.s rlike {rx(md.NAV_BEGIN)} OR x.s rlike {rx(md.NAV_END)}))",
    ), dict(
        brief=f"({V4} AND nt = 'brief')",
        foreign=f"({V4} AND nt = 'lecture' AND coalesce(trim(source_lang), '') <> '' AND NOT startswith(lower(trim(source_lang)), 'zh'))",
        names="transform(cards, c -> c.name)",
        nb=f"transform(filter(marks, x -> x.s rlike {rx(md.NAV_BEGIN)}), x -> x.n)",
        ne=f"transform(filter(marks, x -> x.s rlike {rx(md.NAV_END)}), x -> x.n)",
    ), dict(
        paired="(size(nb) = 1 AND size(ne) = 1 AND try_element_at(nb, 1) < try_element_at(ne, 1))",
        # Lines that may hold time marks: the index (v4), front matter and marker region (v3).
        ex0=f"CASE WHEN {V3} THEN 1 WHEN s_nav IS NULL THEN 0 ELSE s_nav.n END",
        ex1=f"CASE WHEN {V3} THEN coalesce(fmc, 0) WHEN s_nav IS NULL THEN -1 ELSE s_nav.e - 1 END",
        ey0=f"IF({V3} AND try_element_at(nb, 1) <= try_element_at(ne, 1), element_at(nb, 1), 0)",
        ey1=f"IF({V3} AND try_element_at(nb, 1) <= try_element_at(ne, 1), element_at(ne, 1), -1)",
    ))


def _strict(df: DataFrame) -> DataFrame:
    """Strict front matter of the obsidian form: typed lines ``sf`` and values."""
    key = rx(md.STRICT_KEY)
    df = _with(df, sf0=f"""filter(transform(IF(off = 0, array(), slice(al, 2, off - 2)), (l, i) -> named_struct('n', i + 2, 's', l,
        'k', IF(l rlike {key}, regexp_extract(l, {key}, 1), ''), 'v', regexp_extract(l, {key}, 2), 'item', startswith(l, '  - '))),
        x -> {strip_sql('x.s')} <> '')""")
    df = _with(df, sf1="""transform(sf0, x -> named_struct('n', x.n, 's', x.s, 'k', x.k, 'v', x.v, 'item', x.item,
        'dup', x.k <> '' AND exists(sf0, y -> y.n < x.n AND y.k = x.k),
        'head', array_max(transform(filter(sf0, y -> y.n < x.n AND NOT y.item), y -> y.n))))""")
    # An item belongs to the last line that is no item, if that is a new key without value.
    # Nested lambdas capture the array again, so the owner is looked up by line number.
    df = _with(df, sf=f"""transform(sf1, x -> named_struct('n', x.n, 'k', x.k, 'dup', x.dup,
        'owner', IF(x.item, {first("filter(sf1, y -> y.n = x.head AND y.k <> '' AND NOT y.dup AND y.v = '')")}.k, NULL),
        'item', x.item, 'raw', rtrim(IF(x.item, substring(x.s, 5, length(x.s)), x.v))))""")
    quoted = "x.raw rlike r'^\"(?:[^\"\\\\\\x00-\\x1f]|\\\\(?:[\"\\\\/bfnrt]|u[0-9a-fA-F]{4}))*\"$'"
    quoted = quoted.replace("\\\\\\x00", "\\\\\\x00")
    single = '''x.raw rlike r"^'(?:[^']|'')*'$" AND length(x.raw) >= 2'''
    df = _with(df, sv=f"""transform(sf, x -> named_struct('n', x.n, 'k', x.k, 'owner', x.owner, 'raw', x.raw, 'kind',
        CASE WHEN x.item AND x.owner IS NULL THEN 'line' WHEN NOT x.item AND x.k = '' THEN 'line' WHEN x.dup THEN 'dup'
             WHEN startswith(x.raw, '"') AND NOT ({quoted}) THEN 'double'
             WHEN startswith(x.raw, "'") AND NOT ({single}) THEN 'single'
             WHEN NOT startswith(x.raw, '"') AND NOT startswith(x.raw, "'") AND (x.raw rlike {rx(r'^\s')} OR x.raw rlike r'[:#\\[{{]') THEN 'quote'
             ELSE 'ok' END,
        'val', CASE WHEN startswith(x.raw, '"') THEN IF({quoted}, try_element_at(from_json(concat('[', x.raw, ']'), 'array<string>'), 1), '')
                    WHEN startswith(x.raw, "'") THEN IF({single}, replace(substring(x.raw, 2, length(x.raw) - 2), "''", "'"), '') ELSE x.raw END))""")

    def value(key: str) -> str:
        return first(f"filter(sv, z -> z.k = '{key}' AND z.owner IS NULL AND z.kind NOT IN ('dup', 'line') AND z.raw <> '')") + ".val"

    cols = {f"sv_{k}": value(k) for k in ("template_version", "title", "note_type", "platform", "source", "duration", "created", "bvid", "video_id", "page", "tags")}
    cols["sv_items"] = "transform(filter(sv, z -> z.owner = 'tags'), z -> z.val)"
    df = _with(df, **cols)
    return _with(df, strict_type="sv_note_type", strict_platform="sv_platform",
                 strict_vid="coalesce(nullif(sv_bvid, ''), nullif(sv_video_id, ''))")


# Parsing steps that only some rules read, with a word that marks their columns.
_OPTIONAL_STEPS = (("quiz", md.add_quiz), ("nav", md.add_nav), ("km", md.add_map), ("lab", md.add_label_problems), ("img", md.add_images))
# What the rules that join other tables read of a note.
TRANSCRIPTS, IMAGES = "transcripts", "images"


def parse_notes(notes: DataFrame, rules: Sequence[str] | None = None) -> DataFrame:
    """Notes with everything the rules (all by default) need, computed once per row.

    ``rules`` are names of rules, ``TRANSCRIPTS`` or ``IMAGES``: only the steps that they read are done. A barrier of
    ``staged`` is computed even where nothing reads it, so that steps are left out here, not by the optimizer.
    """
    known = {**RULES, **FILE_RULES, **{k: ("", " ".join(_facts((k,)).values())) for k in (TRANSCRIPTS, IMAGES)}}
    steps = _prepared()
    if rules is not None:
        wanted, kept = " ".join(known[r][1] for r in rules), []
        for step in reversed(steps):
            kept.insert(0, {k: v for k, v in step.items() if re.search(rf"\b{k}\b", wanted)})
            wanted = " ".join([wanted, *kept[0].values()])
        steps = kept
    df = md.outline(notes)
    if rules is None or re.search(r"\bcards\b", wanted):
        df = md.add_cards(df)
    for word, step in _OPTIONAL_STEPS:
        if rules is None or word in wanted:
            df = step(df)
    if rules is None or re.search(r"\bstrict_|\bsv", wanted):
        df = _strict(df)
    for step in steps:
        df = _with(df, **step) if step else df
    return df


def _facts(families: Sequence[str]) -> dict[str, str]:
    """What the rules of the families read of a parsed note, without its lines."""
    facts = {}
    if TRANSCRIPTS in families:
        facts["nav"] = f"""transform(nav, x -> named_struct('line', x.n + off, 'sec', x.sec, 'url', x.url,
            'valid', coalesce(x.url IS NOT NULL AND {_link_format()}, false)))"""
        facts["written"] = f"length(regexp_replace(array_join(ln, ''), r'{tx.BLANK}+', ''))"
    if IMAGES in families:
        above = f"""filter(slice(lx, greatest(x.n - 5, 1), least(x.n - 1, 5)), y -> NOT y.f AND y.s rlike {rx(ANCHOR_LINE)})"""
        facts["img"] = f"""transform(img, x -> named_struct('n', x.n, 'o', x.o, 'alt', x.alt, 'path', x.path, 'num', x.num, 'title', x.title,
            'file', substring_index(x.path, '/', -1), 'again', exists(img, y -> y.path = x.path AND y.o < x.o), 'mark', try_element_at({above}, -1).s))"""
        facts["refs"] = md.LOCAL_REFS
    return facts


def note_facts(parsed: DataFrame, families: Sequence[str] = (TRANSCRIPTS, IMAGES), rules: Sequence[str] | None = ()) -> DataFrame:
    """What the gate reads of parsed notes, stored once: small values of each note, never its lines.

    ``found`` holds the findings of the text ``rules`` (None: all); :func:`transcript_findings` and
    :func:`image_findings` take these facts in place of parsed notes.
    """
    kept = [c for c in ("note_id", "video_id", "kind", "off", "only_page") if c in parsed.columns]
    found = [_found_in_text(rules).alias("found")] if rules is None or rules else []
    return durable_checkpoint(parsed.select(*kept, *[F.expr(v).alias(k) for k, v in _facts(families).items()], *found))


def _not_exempt(n: str = "x.n") -> str:
    return f"NOT ({n} BETWEEN ex0 AND ex1) AND NOT ({n} BETWEEN ey0 AND ey1)"


def _sections(skip: Sequence[str], extra: str = "true") -> str:
    return f"filter(h2s, x -> NOT {has_any('x.t', skip)} AND {extra})"


_BODY = "slice(ln, x.n + 1, x.e - x.n - 1)"
_SUBS = f"size(filter({_BODY}, l -> {substantive('l')}))"
_FIRST_SUB = f"coalesce({first(f'filter({_BODY}, l -> {substantive(chr(108))})')}, '')"
_LAST_SUB = f"coalesce(try_element_at(filter({_BODY}, l -> {substantive('l')}), -1), '')"
_APPEAR = f"""flatten(transform(filter(cards, c -> coalesce(c.appears.v, '') <> ''), c -> zip_with(
    {all_matches('c.appears.v', md.APPEAR_V4, 1)}, {all_matches('c.appears.v', md.APPEAR_V4, 2)},
    (a, b) -> named_struct('n', c.appears.n, 'name', c.name, 'sec', CAST(a AS INT), 'title', b))))"""
_APPEAR3 = f"""flatten(transform(filter(cards, c -> coalesce(c.appears.v, '') <> ''), c -> transform(
    {all_matches('c.appears.v', md.APPEAR_V3, 1)}, a -> named_struct('n', c.appears.n, 'name', c.name, 'sec', CAST(a AS INT)))))"""
_KNOWN = "exists(h2s, h -> h.num <=> x.sec)"
_SEC_TITLE = f"{norm_title('try_element_at(filter(h2s, h -> h.num <=> x.sec), -1).t')}"
_DEPENDS = f"""filter(flatten(transform(filter(cards, c -> c.depends.v IS NOT NULL), c -> transform(split(c.depends.v, '[、,，;；]'),
    d -> named_struct('n', c.depends.n, 'name', c.name, 'ref', {strip_sql('d')})))), x -> x.ref <> '' AND NOT array_contains(names, x.ref))"""
_CONFUSED = f"""filter(transform(filter(cards, c -> c.confusable.v IS NOT NULL), c -> named_struct('n', c.confusable.n, 'name', c.name,
    'ref', {strip_sql("element_at(split(c.confusable.v, '——|--'), 1)")})), x -> x.ref <> '' AND NOT array_contains(names, x.ref))"""
_FENCE_MARKS = f"filter(lx, x -> contains(x.s, '```') AND x.s rlike {rx(md.FENCE_LANG)})"
_PAIRS = f"""filter(transform({_FENCE_MARKS}, (x, i) -> named_struct('i', i, 'o', x.n, 'lang', lower(regexp_extract(x.s, {rx(md.FENCE_LANG)}, 1)),
    'c', try_element_at({_FENCE_MARKS}, i + 2).n)), x -> x.i % 2 = 0 AND x.c IS NOT NULL AND x.lang IN {_in(CODE_LANGS)})"""
_SOURCES = f"""flatten(transform({_PAIRS}, b -> filter(slice(lx, b.o + 1, b.c - b.o + 2),
    x -> x.n <> b.c AND contains(x.s, '来源') AND x.s rlike {rx(md.TIME_ANY)})))"""
_KM_NORM = lambda x: f"lower(regexp_replace({x}, r\"(?U)[（(][^）)]*[）)]|\\s|[“”\\\"'`]\", ''))".replace('\\"', '\\x22')
_SUM = span("s_summary")
_POINTS_HEAD = first("filter(h2s, h -> NOT h.f AND h.t = '要点')")


def _card_rules(prefix: str, v3: bool) -> str:
    """Findings of concept cards; the two template families differ in the appearance format."""
    code = f"{prefix}-E6"
    items, pattern = (_APPEAR3, md.APPEAR_V3) if v3 else (_APPEAR, md.APPEAR_V4)
    wanted = "true" if v3 else "NOT brief"
    shown = f"filter(cards, x -> {wanted} AND coalesce(x.appears.v, '') <> '')"
    parts = [
        each("filter(cards, x -> coalesce(x.definition.v, '') = '')", code, "error", "x.n", "concat('no definition: ', x.name)"),
        each(f"filter(cards, x -> {wanted} AND coalesce(x.appears.v, '') = '')", code, "error", "x.n", "concat('no appearance: ', x.name)"),
        each(f"filter({shown}, x -> x.appears.v rlike {rx(md.TIME_ANY)})", code, "error", "x.appears.n", "concat('time in appearance: ', x.name)"),
        each(f"filter({shown}, x -> NOT x.appears.v rlike {rx(pattern)})", code, "error", "x.appears.n", "concat('bad appearance: ', x.name)"),
        each(f"filter({items}, x -> {wanted} AND NOT {_KNOWN})", code, "error", "x.n", "concat('unknown section ', x.sec, ': ', x.name)"),
        each(f"filter({shown}, x -> x.appears.v rlike {rx(pattern)} AND size(array_distinct(transform({all_matches('x.appears.v', pattern, 1)}, a -> CAST(a AS INT)))) < 2)",
             code, "warning", "x.appears.n", "concat('single section: ', x.name)"),
        each(_DEPENDS, code, "warning", "x.n", "concat('unknown dependency: ', x.ref)"),
        each(_CONFUSED, code, "warning", "x.n", "concat('unknown confusable: ', x.ref)"),
    ]
    if not v3:
        parts.append(each(f"filter({items}, x -> {wanted} AND {_KNOWN} AND {norm_title('x.title')} <> {_SEC_TITLE})",
                          code, "warning", "x.n", "concat('title differs: ', x.title)"))
    return f"concat({', '.join(parts)})"


def _quiz_rules(prefix: str, v3: bool) -> str:
    code = f"{prefix}-E5"
    found = "s_quiz IS NOT NULL"
    span_ok = "IF(nt = 'short', size(quiz) BETWEEN 2 AND 3, size(quiz) BETWEEN 4 AND 7)"
    lecture = "nt = 'lecture'"
    parts = [
        one("s_quiz IS NULL" + ("" if v3 else " AND NOT brief"), code, "error", "NULL", "'no quiz'"),
        one(f"{found} AND {'true' if v3 else 'NOT brief'} AND NOT {span_ok}", code, "error", "NULL", "concat('quiz count ', size(quiz))"),
        each(f"filter(quiz, x -> {lecture} AND x.correspond IS NULL)", code, "error", "x.n", "concat('no concept: ', x.no)"),
        each(f"filter(quiz, x -> {lecture} AND x.correspond IS NOT NULL AND NOT array_contains(names, x.correspond))",
             code, "error", "x.n", "concat('unknown concept: ', x.correspond)"),
        each(f"filter(quiz, x -> x.stem rlike {rx(YES_NO)})", code, "warning", "x.n", "concat('yes/no stem: ', x.no)"),
        each("filter(quiz, x -> x.answered AND x.extra > 0" + (" AND x.folded" if v3 else "") + ")", code, "warning", "x.n",
             "concat('answer has ', x.extra, ' more lines: ', x.no)"),
    ]
    if v3:
        parts += [
            each("filter(quiz, x -> NOT x.folded)", code, "error", "x.n", "concat('not folded: ', x.no)"),
            each("filter(quiz, x -> x.folded AND NOT x.answered)", code, "error", "x.n", "concat('no answer: ', x.no)"),
            each(f"filter(quiz, x -> x.folded AND x.answered AND exists(x.raw, l -> l rlike {rx(TIME_FULLWIDTH)}))", code, "error", "x.n",
                 "concat('time in answer: ', x.no)"),
        ]
    else:
        parts += [
            each("filter(quiz, x -> x.folded)", code, "error", "x.n", "concat('folded: ', x.no)"),
            each("filter(quiz, x -> NOT x.answered)", code, "error", "x.n", "concat('no answer: ', x.no)"),
            each(f"filter(quiz, x -> exists(x.raw, l -> l rlike {rx(md.TIME_ANY)}))", code, "error", "x.n", "concat('time in answer: ', x.no)"),
        ]
    return f"concat({', '.join(parts)})"


def _map_rule(prefix: str) -> str:
    code = f"{prefix}-KM"
    line = strip_sql("l")
    kept = f"filter(slice(ln, x.o + 1, x.c - x.o - 1), l -> {line} <> '')"
    head = f"coalesce({strip_sql(first(kept))}, '')"
    indents = f"transform(slice({kept}, 2, greatest(size({kept}) - 1, 0)), l -> length(l) - length(ltrim(l)))"
    bad_first = f"filter(kmb, x -> NOT {head} rlike {rx(md.MAP_FIRST)})"
    flat = f"filter(kmb, x -> startswith({head}, 'mindmap') AND coalesce(array_max({indents}), 0) < 2)"
    return f"""IF(nt <> 'lecture', slice(array({finding(code, 'error', 'NULL', "''")}), 1, 0), concat(
        {one('s_map IS NULL', code, 'error', 'NULL', "'no map section'")},
        {one('s_map IS NOT NULL AND size(kmb) = 0', code, 'error', 'NULL', "'no mermaid block'")},
        {each(bad_first, code, 'error', 'NULL', f"concat('bad first line: ', left({head}, 30))")},
        {each(flat, code, 'error', 'NULL', "'mindmap without children'")}))"""


def _map_relation_rule() -> str:
    code = "V4-KM-REL"
    line = strip_sql("l")
    fine = f"""(nt = 'lecture' AND size(kmb) > 0 AND NOT exists(kmb, x -> NOT coalesce({strip_sql(first(f"filter(slice(ln, x.o + 1, x.c - x.o - 1), l -> {line} <> '')"))}, '') rlike {rx(md.MAP_FIRST)}
        OR (startswith(coalesce({strip_sql(first(f"filter(slice(ln, x.o + 1, x.c - x.o - 1), l -> {line} <> '')"))}, ''), 'mindmap') AND coalesce(array_max(transform(
            slice(filter(slice(ln, x.o + 1, x.c - x.o - 1), l -> {line} <> ''), 2, 100000000), l -> length(l) - length(ltrim(l)))), 0) < 2)))"""
    labels = f"transform(filter(km_labels, z -> z <> ''), z -> {_KM_NORM('z')})"
    secs = f"array_distinct(transform({_sections(md.STRUCTURAL_V4, chr(39) * 2 + ' <> x.t')}, x -> {_KM_NORM(norm_title('x.t'))}))"
    missing = f"""filter(array_distinct(names), x -> NOT exists({labels}, z -> contains(z, {_KM_NORM('x')}) OR (length(z) >= 2 AND contains({_KM_NORM('x')}, z))))"""
    hits = f"size(filter({labels}, z -> array_contains({secs}, z) AND NOT exists(names, c -> {_KM_NORM('c')} = z)))"
    need = "greatest(1, size(array_distinct(names)) - 1)"
    empty = f"slice(array({finding(code, 'error', 'NULL', chr(39) * 2)}), 1, 0)"
    return f"""IF({fine}, concat({each(missing, code, 'error', 'NULL', "concat('not on the map: ', x)")},
        {one(f'km_labeled < {need}', code, 'error', 'NULL', "concat('labelled edges ', km_labeled)")},
        {one(f'size({labels}) > 0 AND size({secs}) > 0 AND {hits} >= greatest(2, 0.5D * size({secs}))', code, 'warning', 'NULL', f"concat('section nodes ', {hits})")}),
        {empty})"""


def _link_format() -> str:
    """Entries whose link has not the form of its platform and identity."""
    yt_head, pg_head = r"https://www\.youtube\.com/watch\?v=", r"https://www\.bilibili\.com/video/"

    def shape(head: str, loose: str, tail: str) -> str:
        rest = f"regexp_replace(x.url, {rx('^' + head)}, '')"
        known = f"(x.url rlike {rx('^' + head)} AND startswith({rest}, ident) AND substring({rest}, length(ident) + 1, length(x.url)) rlike {rx('^' + tail + '$')})"
        return f"IF(ident <> '', {known}, x.url rlike {rx('^' + head + loose + tail + '$')})"

    youtube = f"(plat = 'youtube' OR ({V4} AND plat = '' AND contains(x.url, 'youtube.com')))"
    return f"IF({youtube}, {shape(yt_head, '[A-Za-z0-9_-]{11}', r'&t=\d+s')}, {shape(pg_head, r'\S+', r'\?p=\d+&t=\d+')})"


_NAV_EMPTY = "s_nav IS NOT NULL AND size(nav) = 0"
_TITLES_SKIP = {"V3": md.STRUCTURAL_V3, "V4": md.STRUCTURAL_V4}


def _nav_titles(prefix: str) -> str:
    titles = f"transform({_sections(_TITLES_SKIP[prefix])}, x -> {norm_title('x.t')})"
    return each(f"filter(nav, x -> NOT array_contains({titles}, {norm_title('x.title')}))", f"{prefix}-E2", "warning", "x.n",
                "concat('title differs: ', x.title)")


def _missing_links(prefix: str) -> str:
    return each("filter(nav, x -> x.url IS NULL AND nt = 'lecture' AND plat IN ('bilibili', 'youtube'))", f"{prefix}-E3", "warning", "x.n", "'no link'")


def _bad_links(prefix: str) -> str:
    return each(f"filter(nav, x -> x.url IS NOT NULL AND NOT {_link_format()})", f"{prefix}-E3", "error", "x.n", "concat('link format: ', left(x.url, 60))")


_TIME_HITS = f"""flatten(transform({_lines("contains(x.s, ':') AND " + _not_exempt())}, x -> transform({all_matches('x.s', md.TIME_ANY, 0)}, z -> named_struct('n', x.n, 'z', z))))"""
_TERM_LINES = f"""transform(filter(lx, x -> NOT x.f AND x.g > 0 AND x.n > x.g AND element_at(ln, x.g) rlike {rx(md.H2_NUM)}), x -> named_struct('n', x.n, 's', replace(x.s, '**', '')))"""
_HAN_CARDS = f"""filter(transform(cards, c -> named_struct('n', c.n, 'name', {strip_sql("replace(c.name, '**', '')")}, 'original', c.original.v)), c -> foreign AND c.name rlike r'[\\x{{3400}}-\\x{{9fff}}]')"""
_FIRST_USE = f"""filter(transform({_HAN_CARDS}, c -> named_struct('name', c.name, 'l', {first(f'filter({_TERM_LINES}, y -> contains(y.s, c.name))')})), c -> c.l IS NOT NULL)"""
_POINTS = f"""filter({span('(' + _POINTS_HEAD + ')')}, x -> NOT x.f AND x.s rlike {rx(PLUS_ITEM)})"""
_POINT_LEN = f"length(regexp_replace(regexp_extract(x.s, {rx(PLUS_ITEM)}, 1), {rx(r'[\s*`]')}, ''))"
_TOC = first("filter(h2s, h -> NOT h.f AND h.t = '目录')")
_TOC_LINES = f"""IF({_TOC} IS NULL, slice(lx, 1, 0), filter(lx, x -> NOT x.f AND x.g = {_TOC}.n AND x.n > x.g))"""
_TOC_ITEM = r"^\s*[-+*]\s+\[\[#([^\]|]+)\]\]\s*$"
_TOC_OK = f"""(x.s rlike {rx(_TOC_ITEM)} AND exists(h2s, h -> NOT h.f AND h.t <> '目录' AND h.t = regexp_extract(x.s, {rx(_TOC_ITEM)}, 1)))"""
_TOC_ON = f"NOT (brief AND NOT exists(h2s, h -> contains(h.t, '目录')))"

# name -> (template condition, expression); lines are body lines, shifted afterwards.
RULES: dict[str, tuple[str, str]] = {
    "V4-NT": (V4, one(f"nt NOT IN {_in(NOTE_TYPES)}", "V4-NT", "error", "NULL", "concat('note type: ', nt)")),
    "V4-FM": (V4, one("fmc IS NOT NULL AND off = 0", "V4-FM", "error", "1", "'front matter'")),
    "V4-HEAD": (V4, f"""concat({each(_lines(f"NOT x.f AND startswith(x.s, '#') AND x.s rlike {rx('^#' + chr(92) + 's+' + chr(92) + 'S')}"), 'V4-HEAD', 'error', 'x.n', "'top heading'")},
        {one(f"(size(blanks) = 0 OR NOT element_at(ln, element_at(blanks, 1)) rlike {rx(MAIN_QUOTE)}) AND NOT (fmc IS NOT NULL AND off = 0)", 'V4-HEAD', 'error', 'coalesce(try_element_at(blanks, 1), 1)', "'no main thread'")},
        {one(f"element_at(ln, try_element_at(blanks, 1)) rlike {rx(MAIN_QUOTE)} AND NOT exists(lx, x -> contains(x.s, '课程来源') AND x.n >= blanks[0] AND x.n < coalesce(array_min(transform(filter(lx, y -> y.n > blanks[0] AND {strip_sql('y.s')} = ''), y -> y.n)), 1000000000))", 'V4-HEAD', 'error', 'try_element_at(blanks, 1)', "'no source'")})"""),
    "V4-NAME": (V4, one(f"NOT fname rlike {rx(FILE_NAME)}", "V4-NAME", "warning", "NULL", "concat('file name: ', fname)")),
    "V4-LIST": (V4, f"""transform(filter(array({_lines(f"NOT x.f AND (contains(x.s, '-') OR contains(x.s, '*')) AND x.s rlike {rx(DASH_LIST)}")}), z -> size(z) > 0),
        z -> {finding('V4-LIST', 'warning', 'z[0].n', "concat(size(z), ' lines')")})"""),
    "V4-SEC": (V4, each(_sections(md.STRUCTURAL_V3, f"NOT brief AND {_SUBS} < 3"), "V4-SEC", "error", "NULL", f"concat(x.t, ': ', {_SUBS})")),
    "V4-IDEA": (V4, each(_sections(md.STRUCTURAL_V4, f"NOT brief AND NOT x.f AND NOT {_LAST_SUB} rlike {rx(RECALL)}"), "V4-IDEA", "warning", "x.n", "x.t")),
    "V4-ANALOGY": (V4, each(_lines(f"{_not_exempt()} AND NOT x.f AND contains(x.s, '打个比方') AND x.s rlike {rx(ANALOGY)} AND NOT x.s rlike {rx(ANALOGY_OK)}"),
                            "V4-ANALOGY", "warning", "x.n", "'analogy label'")),
    "V4-YUQUE": (V4, each(_lines(f"(x.f AND contains(x.s, 'subgraph') AND x.s rlike {rx(SUBGRAPH_BOX)}) OR (contains(x.s, '```') AND x.s rlike {rx(TEXT_FENCE)})"), "V4-YUQUE", "warning", "x.n",
                          f"IF(x.f AND x.s rlike {rx(SUBGRAPH_BOX)}, 'subgraph', 'text fence')")),
    "V4-E1": (V4, each(_TIME_HITS, "V4-E1", "error", "x.n", "concat('time mark: ', x.z)")),
    "V4-E4": (V4, each(_lines(f"{_not_exempt()} AND NOT x.f AND {has_any('x.s', TAGS)} AND (x.s rlike {rx(TAG_V4)} OR x.s rlike {rx(CARD_TAGGED)})"), "V4-E4", "error", "x.n", "'label residue'")),
    "V4-E6": (V4, _card_rules("V4", False)),
    "V4-TERM": (V4, f"""concat({each(f"filter({_HAN_CARDS}, x -> {strip_sql(chr(99) + 'oalesce(x.original, ' + chr(39) * 2 + ')')} = '')", 'V4-TERM', 'warning', 'x.n', "concat('no original: ', x.name)")},
        {each(f"filter({_FIRST_USE}, x -> NOT substring(x.l.s, locate(x.name, x.l.s) + length(x.name), length(x.l.s)) rlike {rx(ORIGINAL_AFTER)})", 'V4-TERM', 'warning', 'x.l.n', "concat('first use: ', x.name)")})"""),
    "V4-E5": (V4, _quiz_rules("V4", False)),
    "V4-QA": (V4, each(f"filter(quiz, x -> x.answered AND length(regexp_replace(x.answer, {rx(r'[\s*`]')}, '')) < {ANSWER_MIN})", "V4-QA", "warning", "x.n",
                       f"concat('answer length ', length(regexp_replace(x.answer, {rx(r'[\s*`]')}, '')))")),
    "V4-SUM": (V4, f"""IF(brief, slice(array({finding('V4-SUM', 'warning', 'NULL', "''")}), 1, 0), concat(
        {one("s_summary IS NULL AND nt = 'lecture'", 'V4-SUM', 'warning', 'NULL', "'no summary'")},
        {one(f"s_summary IS NOT NULL AND size(filter({_SUM}, x -> NOT x.f AND x.s rlike {rx(TABLE_ROW)} AND NOT x.s rlike {rx(TABLE_RULE)})) < 3", 'V4-SUM', 'warning', 's_summary.n', "'table rows'")},
        {one(f"s_summary IS NOT NULL AND NOT exists({_SUM}, x -> NOT x.f AND contains(x.s, '学完能说的') AND x.s rlike {rx(THREE_LINES)})", 'V4-SUM', 'warning', 's_summary.n', "'no three sentences'")},
        {one(f"size(filter({_SUM}, x -> NOT x.f AND x.s rlike {rx(md.NUM_ITEM)} AND x.n > {first(f'filter({_SUM}, y -> NOT y.f AND y.s rlike {rx(THREE_LINES)})')}.n)) <> 3 AND exists({_SUM}, x -> NOT x.f AND contains(x.s, '学完能说的') AND x.s rlike {rx(THREE_LINES)})", 'V4-SUM', 'warning', first(f'filter({_SUM}, y -> NOT y.f AND y.s rlike {rx(THREE_LINES)})') + '.n', "'sentence count'")}))"""),
    "V4-E2": (V4, f"""concat({each('marks', 'V4-E2', 'error', 'x.n', "'marker'")},
        {one('s_nav IS NOT NULL AND s_nav.e <> size(ln) + 1', 'V4-E2', 'error', 's_nav.n', "'index not last'")},
        {each(f"filter({span('s_nav')}, x -> x.s rlike {rx(md.DETAILS_OPEN)})", 'V4-E2', 'error', 'x.n', "'folded index'")},
        {one(_NAV_EMPTY, 'V4-E2', 'error', 's_nav.n', "'no entries'")},
        {one("s_nav IS NULL AND nt = 'lecture'", 'V4-E2', 'error', 'NULL', "'no index'")}, {_nav_titles('V4')})"""),
    "V4-E3": (V4, f"concat({_bad_links('V4')}, {_missing_links('V4')})"),
    "V4-E7": (V4, f"""concat({each(_SOURCES, 'V4-E7', 'error', 'x.n', "'source with time'")},
        {one(f'size({_FENCE_MARKS}) % 2 = 1', 'V4-E7', 'error', 'NULL', "'open fence'")})"""),
    "V4-KM": (V4, _map_rule("V4")),
    "V4-KM-REL": (V4, _map_relation_rule()),
    "V4-KM-LABEL": (V4, each("lab", "V4-KM-LABEL", "warning", "x.n", "concat('label: ', left(x.label, 30))")),
    "V4-SHOT": (V4, f"""concat({each("filter(img, x -> exists(img, y -> y.path = x.path AND y.o < x.o))", 'V4-SHOT', 'warning', 'x.n', "concat('repeated: ', x.path)")},
        {each("filter(img, x -> x.num IS NULL AND NOT exists(img, y -> y.path = x.path AND y.o < x.o))", 'V4-SHOT', 'warning', 'x.n', "concat('outside a section: ', x.path)")})"""),
    "V4B-POINTS": (V4, f"""IF(NOT brief, slice(array({finding('V4B-POINTS', 'error', 'NULL', "''")}), 1, 0), concat(
        {one(f'{_POINTS_HEAD} IS NULL', 'V4B-POINTS', 'error', 'NULL', "'no points section'")},
        {each(f'filter({_POINTS}, x -> {_POINT_LEN} < 8)', 'V4B-POINTS', 'error', 'x.n', f"concat('short point ', {_POINT_LEN})")},
        {one(f'{_POINTS_HEAD} IS NOT NULL AND size({_POINTS}) NOT BETWEEN 3 AND 7', 'V4B-POINTS', 'error', f'{_POINTS_HEAD}.n', f"concat('points ', size({_POINTS}))")}))"""),
    "V4B-EMPTY": (V4, each(f"filter(h2s, x -> brief AND NOT contains(x.t, '视频时间索引') AND NOT exists({_BODY}, l -> {substantive('l')} AND NOT startswith(ltrim(l), '#')))",
                           "V4B-EMPTY", "error", "NULL", "x.t")),
    "V4B-NUM": (V4, one("brief AND exists(h2s, h -> NOT h.f AND h.num IS NOT NULL)", "V4B-NUM", "warning", "try_element_at(filter(h2s, h -> NOT h.f AND h.num IS NOT NULL), 1).n",
                        "concat('numbered sections ', size(filter(h2s, h -> NOT h.f AND h.num IS NOT NULL)))")),
    "V4B-CARDS": (V4, one("brief AND size(cards) > 3", "V4B-CARDS", "warning", "s_cards.n", "concat('cards ', size(cards))")),
    "V4B-QUIZ": (V4, one("brief AND s_quiz IS NOT NULL AND size(quiz) > 2", "V4B-QUIZ", "warning", "s_quiz.n", "concat('questions ', size(quiz))")),
    "V4O-TOC": ("kind = 'v4-obsidian'", f"""IF({_TOC_ON}, concat({each(f"filter({_TOC_LINES}, x -> contains(x.s, '](#'))", 'V4O-TOC', 'warning', 'x.n', "'classic anchor'")},
        {each(f"filter({_TOC_LINES}, x -> x.s rlike {rx(r'^\s*[-+*]\s+')} AND NOT {_TOC_OK})", 'V4O-TOC', 'error', 'x.n', "'bad toc entry'")},
        {one(f"NOT exists({_TOC_LINES}, x -> {_TOC_OK})", 'V4O-TOC', 'error', f'coalesce({_TOC}.n, 1)', "'no toc entry'")}), slice(array({finding('V4O-TOC', 'error', 'NULL', "''")}), 1, 0))"""),
    "V3-FM": (V3, each("""filter(array('template_version', 'note_type', 'platform', 'source', 'created', 'duration',
            IF(plat IN ('douyin', 'youtube', 'xiaohongshu'), 'video_id', 'bvid')), x -> coalesce(try_element_at(filter(fm, z -> z.k = x), -1).v, '') = '')""",
                       "V3-FM", "error", "NULL", "concat('missing ', x)")),
    "V3-NT": (V3, one("nt <> '' AND nt NOT IN ('lecture', 'short')", "V3-NT", "error", "NULL", "concat('note type: ', nt)")),
    "V3-SEC": (V3, each(_sections(md.STRUCTURAL_V3, f"{_SUBS} < 3"), "V3-SEC", "error", "NULL", f"concat(x.t, ': ', {_SUBS})")),
    "V3-IDEA": (V3, each(_sections(md.STRUCTURAL_IDEA, f"NOT startswith({_FIRST_SUB}, '**核心思想：**')"), "V3-IDEA", "error", "NULL", "x.t")),
    "V3-E1": (V3, each(_TIME_HITS, "V3-E1", "error", "x.n", "concat('time mark: ', x.z)")),
    "V3-E4": (V3, each(_lines(f"{_not_exempt()} AND NOT x.f AND {has_any('x.s', TAGS)} AND (x.s rlike {rx(TAG_V3)} OR x.s rlike {rx(CARD_TAGGED)})"), "V3-E4", "error", "x.n", "'label residue'")),
    "V3-E6": (V3, _card_rules("V3", True)),
    "V3-E5": (V3, _quiz_rules("V3", True)),
    "V3-E2": (V3, f"""concat({one('s_nav IS NOT NULL AND NOT paired', 'V3-E2', 'error', 'NULL', "'markers not paired'")},
        {one('s_nav IS NOT NULL AND paired AND NOT s_nav.n BETWEEN nb[0] AND ne[0]', 'V3-E2', 'error', 'NULL', "'index outside markers'")},
        {one(_NAV_EMPTY, 'V3-E2', 'error', 'NULL', "'no entries'")},
        {one("s_nav IS NULL AND nt = 'lecture'", 'V3-E2', 'error', 'NULL', "'no index'")}, {_nav_titles('V3')})"""),
    "V3-E3": (V3, f"concat({_bad_links('V3')}, {_missing_links('V3')})"),
    "V3-E7": (V3, f"""concat({each(_SOURCES, 'V3-E7', 'error', 'x.n', "'source with time'")},
        {one(f'size({_FENCE_MARKS}) % 2 = 1', 'V3-E7', 'error', 'NULL', "'open fence'")})"""),
    "V3-KM": (V3, _map_rule("V3")),
    "V3-KM-LABEL": (V3, each("lab", "V3-KM-LABEL", "warning", "x.n", "concat('label: ', left(x.label, 30))")),
}

_STRICT_MISS = "coalesce(try_element_at(transform(filter(sv, z -> z.k = x AND z.owner IS NULL AND z.kind <> 'line'), z -> z.n), 1), 1)"
_STRICT_NEEDED = f"filter(array{_in(STRICT_FIELDS)}, x -> CASE x {' '.join(f'WHEN {chr(39)}{k}{chr(39)} THEN ' + ('coalesce(sv_tags, ' + chr(39) * 2 + ') = ' + chr(39) * 2 + ' AND size(sv_items) = 0' if k == 'tags' else f'coalesce(sv_{k}, {chr(39) * 2}) = {chr(39) * 2}') for k in STRICT_FIELDS)} END)"


def _key_line(key: str) -> str:
    return f"coalesce(array_min(filter(transform(al, (l, i) -> IF(startswith(l, '{key}:'), i + 1, NULL)), z -> z IS NOT NULL)), 1)"


# Rules on absolute lines.
FILE_RULES: dict[str, tuple[str, str]] = {
    "VERSION": ("kind = 'unknown'", one("true", "VERSION", "error", "1", f"concat('template version: ', coalesce({md.fm_value('template_version')}, ''))")),
    "V4O-FM": ("kind = 'v4-obsidian'", f"""concat(
        {one("try_element_at(al, 1) <> '---'", 'V4O-FM', 'error', '1', "'no front matter'")},
        {one("try_element_at(al, 1) = '---' AND off = 0", 'V4O-FM', 'error', '1', "'open front matter'")},
        {each("filter(sv, x -> x.kind <> 'ok')", 'V4O-FM', 'error', 'x.n', "concat('grammar: ', x.kind)")},
        transform({_STRICT_NEEDED}, x -> {finding('V4O-FM', 'error', "coalesce(array_min(filter(transform(al, (l, i) -> IF(startswith(l, concat(x, ':')), i + 1, NULL)), z -> z IS NOT NULL)), 1)", "concat('missing ', x)")}),
        {one("coalesce(sv_template_version, '') <> 'v4-obsidian'", 'V4O-FM', 'error', _key_line('template_version'), "'template version'")},
        {one(f"coalesce(sv_note_type, '') NOT IN {_in(NOTE_TYPES)}", 'V4O-FM', 'error', _key_line('note_type'), "'note type'")},
        {one(f"coalesce(sv_tags, '') <> '' OR size(sv_items) = 0 OR exists(sv_items, z -> {strip_sql('z')} = '')", 'V4O-FM', 'error', _key_line('tags'), "'tags'")},
        {one("NOT coalesce(sv_created rlike r'^[0-9]{4}-[0-9]{2}-[0-9]{2}$' AND try_to_date(sv_created, 'yyyy-MM-dd') IS NOT NULL, false)", 'V4O-FM', 'error', _key_line('created'), "'created'")},
        {one(f"sv_platform = 'bilibili' AND coalesce({strip_sql('sv_bvid')}, '') = ''", 'V4O-FM', 'error', _key_line('bvid'), "'platform needs bvid'")},
        {one(f"sv_platform = 'bilibili' AND coalesce({strip_sql('sv_page')}, '') = ''", 'V4O-FM', 'error', _key_line('page'), "'platform needs page'")},
        {one(f"sv_platform = 'youtube' AND coalesce({strip_sql('sv_video_id')}, '') = ''", 'V4O-FM', 'error', _key_line('video_id'), "'platform needs video_id'")},
        {one(f"off > 0 AND NOT coalesce(try_element_at(ln, 1) rlike {rx(MAIN_QUOTE)}, false)", 'V4O-FM', 'error', 'off + 1', "'body must follow'")},
        {one("coalesce(sv_note_type, '') <> '' AND lower(trim(note_type)) <> lower(sv_note_type)", 'V4O-FM', 'warning', 'NULL', "'type conflict'")})"""),
}


def _found_in_text(rules: Sequence[str] | None) -> Column:
    parts = []
    for name, (applies, expr) in RULES.items():
        if rules is None or name in rules:
            shifted = f"transform({expr}, v -> named_struct('check', v.check, 'severity', v.severity, 'line', v.line + off, 'message', v.message))"
            parts.append(f"IF({applies}, {shifted}, NULL)")
    for name, (applies, expr) in FILE_RULES.items():
        if rules is None or name in rules:
            parts.append(f"IF({applies}, {expr}, NULL)")
    return F.flatten(F.filter(F.array(*[F.expr(p) for p in parts]), lambda a: a.isNotNull()))


def text_findings(parsed: DataFrame, rules: Sequence[str] | None = None) -> DataFrame:
    """Findings of the rules that need only the note; facts that hold them already are read."""
    found = F.col("found") if "found" in parsed.columns else _found_in_text(rules)
    return parsed.select("note_id", F.inline(F.array(F.struct(found.alias("fs"))))).select(
        "note_id", F.explode("fs").alias("f")).select("note_id", "f.check", "f.severity", "f.line", "f.message")


def _found(df: DataFrame, check, severity: str, line, message) -> DataFrame:
    prefix = F.when(F.col("kind") == "v3", "V3").otherwise("V4")
    return df.select("note_id", F.concat(prefix, F.lit(f"-{check}")).alias("check"), F.lit(severity).alias("severity"),
                     line.cast("int").alias("line"), message.alias("message"))


def transcript_findings(parsed: DataFrame, transcripts: DataFrame) -> DataFrame:
    """Index entries against transcript times, link seconds, and the length ratio.

    ``transcripts(video_id, page, text)`` holds the raw texts of each video. Notes and transcript lines are worked
    through once and stored as facts and seconds, which all the joins read.
    """
    facts = parsed if "written" in parsed.columns else note_facts(parsed, (TRANSCRIPTS,))
    lines = durable_checkpoint(parse_ts_lines(transcripts, "nav").select("video_id", "page", "line_no", "ts_sec"))
    entries = facts.filter(F.expr(ANY)).select(
        "note_id", "video_id", "kind", "only_page", F.explode("nav").alias("e")).select(
        "note_id", "video_id", "kind", "only_page", "e.line", "e.sec", "e.url")
    timed = lines.groupBy("video_id").agg(F.count("*").alias("timed"))
    near = near_lines(entries.select("video_id", "sec"), lines).select("video_id", "sec").distinct()
    known = entries.join(timed.select("video_id"), "video_id", "left_semi")
    off_list = known.join(near, ["video_id", "sec"], "left_anti")
    per_note = entries.groupBy("note_id", "video_id", "kind").agg(F.count("url").alias("links"))
    blind = per_note.join(timed, "video_id", "left_anti")
    located = locate_page(entries.filter("url IS NOT NULL"), lines)
    link_sec = F.regexp_extract("url", r"&t=(\d+)s?$", 1).try_cast("bigint")
    valid = facts.select("note_id", F.explode(F.expr("transform(filter(nav, x -> x.valid), x -> x.line)")).alias("line"))
    wrong = located.filter(F.col("rel_sec").isNotNull() & (link_sec != F.col("rel_sec"))).join(valid, ["note_id", "line"], "left_semi")
    chars = F.length(F.regexp_replace("text", f"{tx.BLANK}+", ""))
    spoken = transcripts.groupBy("video_id").agg(F.sum(chars).alias("spoken"))
    ratio = facts.filter(F.expr(ANY)).select("note_id", "video_id", "kind", "written").join(spoken, "video_id", "left")
    odd = ratio.filter((F.col("spoken") > 0) & ~(F.col("written") / F.col("spoken")).between(RATIO_MIN, RATIO_MAX))
    none = ratio.filter(F.coalesce("spoken", F.lit(0)) == 0)
    null = F.lit(None)
    parts = [
        _found(off_list, "E2", "error", F.col("line"), F.concat(F.lit("off whitelist: "), F.col("sec").cast("string"))),
        _found(blind, "E2", "warning", null, F.lit("no transcript times")),
        _found(blind.filter("links > 0"), "E3", "warning", null, F.lit("links not verifiable")),
        _found(wrong, "E3", "error", F.col("line"), F.concat(F.lit("link second "), link_sec.cast("string"), F.lit(" should be "), F.col("rel_sec").cast("string"))),
        _found(odd, "RATIO", "warning", null, F.when(F.col("written") < F.col("spoken") * RATIO_MIN, "too short").otherwise("too long")),
        _found(none, "RATIO", "warning", null, F.lit("no transcript")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def image_findings(parsed: DataFrame, inventory: DataFrame, manifest: DataFrame) -> DataFrame:
    """Missing images, images in the wrong section, and captions that disagree with the manifest.

    ``inventory(note_id, path)`` lists existing files; ``manifest(note_id, file, keyword, t,
    section)`` the frames taken for the note.
    """
    facts = parsed if "refs" in parsed.columns else note_facts(parsed, (IMAGES,))
    refs = md.local_images(facts.filter(F.expr(ANY)))
    missing = refs.join(inventory, ["note_id", "path"], "left_anti")
    rows = facts.filter(F.expr(ANY)).select("note_id", "kind", "off", F.explode("img").alias("i")).select(
        "note_id", "kind", "off", *[f"i.{c}" for c in ("n", "alt", "path", "num", "file", "again", "mark")])
    rows = rows.withColumn("mark_sec", F.regexp_extract(F.coalesce("mark", F.lit("")), TIME_LINE, 1).try_cast("int") * 60
                           + F.regexp_extract(F.coalesce("mark", F.lit("")), TIME_LINE, 2).try_cast("int"))
    hit = rows.join(manifest.distinct(), ["note_id", "file"])  # a repeated record is one
    line = F.col("n") + F.col("off")
    misplaced = hit.filter("kind <> 'v3' AND NOT again AND num IS NOT NULL AND section IS NOT NULL AND section <> num")
    keyword = hit.filter(F.coalesce(tx.strip(F.col("keyword")), F.lit("")) != "").filter(~F.contains("alt", tx.strip(F.col("keyword"))))
    late = hit.filter("abs(t - mark_sec) > 60")
    null = F.lit(None)
    out = _found(missing, "IMG", "error", null, F.concat(F.lit("missing image: "), F.col("path")))
    for part in (
        _found(misplaced, "SHOT", "warning", line, F.concat(F.lit("belongs to section "), F.col("section").cast("string"))),
        _found(keyword, "MANIFEST", "warning", null, F.concat(F.lit("caption without keyword: "), F.col("file"))),
        _found(late, "MANIFEST", "warning", null, F.concat(F.lit("time differs: "), F.col("file"))),
    ):
        out = out.unionByName(part)
    return out


def lint_notes(notes: DataFrame, transcripts: DataFrame | None = None, inventory: DataFrame | None = None,
               manifest: DataFrame | None = None) -> DataFrame:
    """All findings of the gate for notes of any template, or for the facts of such notes.

    The notes are parsed once; only their facts (findings of the text, index entries, images) are stored.
    """
    families = [TRANSCRIPTS] * (transcripts is not None) + [IMAGES] * (inventory is not None and manifest is not None)
    facts = notes if "found" in notes.columns else note_facts(parse_notes(notes), families, None)
    out = text_findings(facts)
    if transcripts is not None:
        out = out.unionByName(transcript_findings(facts, transcripts))
    if inventory is not None and manifest is not None:
        out = out.unionByName(image_findings(facts, inventory, manifest))
    return out


def dispatch_template(notes: DataFrame) -> DataFrame:
    """Template family each note is checked against."""
    return md.outline(notes).select("note_id", "kind")


def gate_summary(notes: DataFrame, findings: DataFrame) -> DataFrame:
    """Errors, warnings, verdict and first three errors per note, with content hash."""
    key = F.struct(F.coalesce("line", F.lit(0)).alias("l"), F.col("check").alias("c"), F.col("message").alias("m"))
    per_check = findings.groupBy("note_id").agg(
        F.count_if(F.col("severity") == "error").alias("errors"),
        F.count_if(F.col("severity") == "warning").alias("warnings"),
        # A note's findings come from one text cell, so this list is bounded by it.
        F.slice(F.sort_array(F.collect_list(F.when(F.col("severity") == "error", key))), 1, 3).alias("top"))
    rows = notes.select("note_id", F.sha2("text", 256).alias("sha")).join(per_check, "note_id", "left")
    first3 = F.array_join(F.transform("top", lambda x: F.concat(x.getField("c"), F.lit(": "), x.getField("m"))), "; ")
    return rows.select("note_id", "sha", F.coalesce("errors", F.lit(0)).alias("errors"),
                       F.coalesce("warnings", F.lit(0)).alias("warnings"),
                       (F.coalesce("errors", F.lit(0)) == 0).alias("ok"), F.coalesce(first3, F.lit("")).alias("first_errors"))
