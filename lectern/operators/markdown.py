"""Markdown notes to tables.

Everything is computed inside the row with higher-order functions: a note is one cell, so a
note never has to be gathered from several tasks and the corpus is never shuffled to parse
it. ``outline`` adds the shared structure once (lines with fence state and heading, section
spans, front matter); the table functions explode parts of it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from lectern.functions import text as tx
from lectern.functions.staged import staged
from lectern.session import durable_checkpoint


def rx(pattern: str) -> str:
    """A pattern as a raw SQL literal, with Unicode classes."""
    quote = '"' if "'" in pattern else "'"
    return f"r{quote}(?U){pattern}{quote}"


# The line and inline formats of notes.
FENCE = r"^\s*```"
FENCE_LANG = r"^\s*```(\S*)\s*$"
H2 = r"^##\s+(.+?)\s*$"
H2_NUM = r"^##\s+(\d{1,2})\s*[.、．)）]"
SEC_NUM = r"^##\s+(\d{1,2})\s*[.、．]\s*(.+?)\s*$"
H3 = r"^###\s+(\S.*?)\s*$"
LEADING_NUM = r"^\s*\d{1,2}\s*[.、．)）]\s*"
NUM_ITEM = r"^\s*\d{1,2}\s*[.、．)）]\s*\S"
FM_KEY = r"^([A-Za-z_][A-Za-z0-9_-]*)\s*:\s*(.*)$"
STRICT_KEY = r"^([A-Za-z_][A-Za-z0-9_-]*):(?: (.*))?$"
CARD_FIELD_V3 = r"^\s*[-*]\s*(定义|出现|依赖|易混)\s*[：:]\s*(.*)$"
CARD_FIELD_V4 = r"^\s*[-*+]\s*(定义|出现|依赖|易混|原文)\s*[：:]\s*(.*)$"
APPEAR_V3 = r"(\d{1,2})\s*(?:[（(]([^）)]*)[）)])?"
APPEAR_V4 = r"第\s*(\d{1,2})\s*节\s*「([^」]*)」"
CORRESPOND = r"[（(]\s*对应\s*[：:]\s*([^）)]+?)\s*[）)]"
DETAILS_OPEN = r"(?i)<details\b"
DETAILS_CLOSE = r"(?i)</details>"
DETAILS_TAG = r"(?i)^\s*</?(?:details|summary)\b"
ANSWER = r"^\s*\*\*答案：?\*\*\s*(.*)$"
ENTRY_V3 = r"^\s*[-*]\s+\[(\d{1,3}):(\d{2})\](?:\(([^)\s]*)\))?\s+(\S.*?)\s*$"
ENTRY_V4 = r"^\s*[-*+]\s+\[(\d{1,3}):(\d{2})\](?:\(([^)\s]*)\))?\s+(\S.*?)\s*$"
NAV_BEGIN = r"<!--\s*NAV:BEGIN"
NAV_END = r"<!--\s*NAV:END"
IMAGE = r"!\[([^\]]*)\]\(([^)\s]+)\)"
IMAGE_BARE = r"(?<!\()\bimages/[\w./-]+\.(?:png|jpe?g|gif)\b"
MAP_FIRST = r"^(?:mindmap|graph|flowchart)\b"
EDGE_LABELS = (
    r"(?:-->|---|-\.->|-\.-|==>|===)\s*\|[^|]+\|",
    r"--\s+[^-|>\s][^|>]*?\s+-->",
    r"-\.\s+[^|.][^|]*?\s+\.->",
    r"==\s+[^|=][^|]*?\s+==>",
)
EDGE_ANY = r"-->|---|-\.->|-\.-|\.->|==>|==="
NODE_LABEL = r"[\[\(\{]+([^\[\]\(\)\{\}|]+?)[\]\)\}]+"
GRAPH_LABEL = r"\[([^\[\]]+)\]"
MINDMAP_SHELLS = (r"^(?:\w+\s*)?\(\((.+)\)\)$", r"^\{\{(.+)\}\}$", r"^\((.+)\)$", r"^\[(.+)\]$")
LABEL_BAD = r'[()\[\]{}"]'
LABEL_MAX_WIDTH = 12
TIME_ANY = r"\[\d{1,3}:\d{2}(?::\d{2})?\]|[（(]\d{1,3}:\d{2}(?::\d{2})?[）)]"
# Code points that take a full cell (East Asian wide and full-width forms).
WIDE = (
    r"[\x{1100}-\x{115f}\x{231a}\x{231b}\x{2329}\x{232a}\x{23e9}-\x{23ec}\x{23f0}\x{23f3}"
    r"\x{2e80}-\x{303e}\x{3041}-\x{33ff}\x{3400}-\x{4dbf}\x{4e00}-\x{a4cf}\x{a960}-\x{a97f}"
    r"\x{ac00}-\x{d7a3}\x{f900}-\x{faff}\x{fe30}-\x{fe6f}\x{ff00}-\x{ff60}\x{ffe0}-\x{ffe6}"
    r"\x{1f300}-\x{1f64f}\x{1f900}-\x{1f9ff}\x{20000}-\x{3fffd}]"
)
STRUCTURAL_V3 = ("目录", "参考时间戳", "视频时间索引")
STRUCTURAL_IDEA = (*STRUCTURAL_V3, "知识地图", "概念卡片", "自测题")
STRUCTURAL_V4 = (*STRUCTURAL_IDEA, "本讲小结")
SECTIONS = {"cards": "概念卡片", "quiz": "自测题", "nav": "视频时间索引", "map": "知识地图", "summary": "本讲小结"}


BLANK_SQL = "'" + "".join(f"\\u{ord(c):04x}" for c in tx.BLANK_CHARS) + "'"


def strip_sql(x: str) -> str:
    return f"btrim({x}, {BLANK_SQL})"


def norm_title(x: str) -> str:
    """Title without its leading number."""
    return strip_sql(f"regexp_replace({x}, {rx(LEADING_NUM)}, '')")


def has_any(x: str, words: Sequence[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, '{w}')" for w in words) + ")"


def substantive(x: str) -> str:
    return f"({strip_sql(x)} NOT IN ('', '---'))"


def where_lines(lines: str, pattern: str, mark: str) -> str:
    """1-based numbers of the lines that match; only lines where the cheap test ``mark`` holds can."""
    return f"filter(transform({lines}, (l, i) -> IF({mark} AND l rlike {rx(pattern)}, i + 1, NULL)), x -> x IS NOT NULL)"


def first(array: str) -> str:
    return f"try_element_at({array}, 1)"


def all_matches(x: str, pattern: str, group: int) -> str:
    return f"regexp_extract_all({x}, {rx(pattern)}, {group})"


def _with(df: DataFrame, **columns: str) -> DataFrame:
    return staged(df, **{k: F.expr(v) for k, v in columns.items()})


def _per_line(starts: str, value: str, before: str) -> str:
    """A value for each of the lines ``ln``: ``value`` from the k-th (1-based) of the line numbers ``starts`` up to
    the next, ``before`` up to the first; in one pass over the lines."""
    return f"""flatten(transform(sequence(0, size({starts})), k -> array_repeat(IF(k = 0, {before}, {value}),
        coalesce(get({starts}, k), size(ln) + 1) - coalesce(get({starts}, k - 1), 1))))"""


def outline(notes: DataFrame) -> DataFrame:
    """Add the shared structure of each note.

    ``kind`` is v3, v4, v4-obsidian or unknown; ``ln`` the body lines, ``off`` the front-matter
    lines before them; ``lx`` the lines ``(n, s, f, h, g)`` with fence state, last heading and
    last heading outside fences; ``h2s`` the sections ``(n, e, t, num, f)``.
    """
    df = staged(notes, al=tx.lines_of(F.col("text")))
    rule = rx(r"^---\s*$")
    df = _with(df, fmc=f"""IF({first('al')} rlike {rule}, array_min(filter(
        transform(al, (l, i) -> IF(startswith(l, '---') AND l rlike {rule}, i + 1, NULL)), x -> x >= 3)), NULL)""")
    value = f"""regexp_replace(regexp_replace({strip_sql(f"regexp_extract(l, {rx(FM_KEY)}, 2)")},
        '^"+|"+$', ''), "^'+|'+$", '')"""
    df = _with(df, fm=f"""filter(transform(IF(fmc IS NULL, array(), slice(al, 2, fmc - 2)), l0 -> named_struct(
        'k', regexp_extract({strip_sql('l0')}, {rx(FM_KEY)}, 1), 'v', {value.replace('(l,', '(' + strip_sql('l0') + ',')})),
        x -> x.k <> '')""")
    version = fm_value("template_version")
    df = _with(df, kind=f"""CASE
        WHEN coalesce(lower(trim(template)), '') <> 'v4' AND (lower(trim(template)) = 'v4-obsidian' OR {version} = 'v4-obsidian') THEN 'v4-obsidian'
        WHEN lower(trim(template)) = 'v4' OR fmc IS NULL THEN 'v4'
        WHEN lower(trim({version})) = 'v3' THEN 'v3' ELSE 'unknown' END""")
    df = _with(df, off="""IF(kind = 'v4-obsidian' AND try_element_at(al, 1) = '---', coalesce(array_min(filter(
        transform(al, (l, i) -> IF(l = '---', i + 1, NULL)), x -> x >= 2)), 0), 0)""")
    df = _with(df, ln="IF(off = 0, al, slice(al, off + 1, size(al) - off))")
    df = _with(df, fi=where_lines("ln", FENCE, "contains(l, '```')"), hi=where_lines("ln", H2, "startswith(l, '##')"))
    df = _with(df, lf=_per_line("fi", "k % 2 = 1", "false"), lh=_per_line("hi", "get(hi, k - 1)", "0"))
    df = _with(df, gi="filter(hi, z -> NOT get(lf, z - 1))")
    df = _with(df, lg=_per_line("gi", "get(gi, k - 1)", "0"))
    df = _with(df, lx="""transform(ln, (l, i) -> named_struct('n', i + 1, 's', l, 'f', coalesce(get(lf, i), false),
            'h', coalesce(get(lh, i), 0), 'g', coalesce(get(lg, i), 0)))""",
        h2s=f"""transform(hi, (p, k) -> named_struct('n', p, 'e', coalesce(try_element_at(hi, k + 2), size(ln) + 1),
            't', {strip_sql(f"regexp_extract(element_at(ln, p), {rx(H2)}, 1)")},
            'num', try_cast(nullif(regexp_extract(element_at(ln, p), {rx(H2_NUM)}, 1), '') AS INT),
            'f', coalesce(get(lf, p - 1), false)))""").drop("lf", "lh", "lg")
    return _with(df, **{f"s_{name}": first(f"filter(h2s, x -> contains(x.t, '{word}'))") for name, word in SECTIONS.items()})


def fm_value(key: str) -> str:
    """Front-matter scalar; the last of repeated keys counts."""
    return f"try_element_at(filter(fm, x -> x.k = '{key}'), -1).v"


def span(section: str) -> str:
    """Lines of a section column, without its heading; empty when there is none."""
    return f"IF({section} IS NULL, slice(lx, 1, 0), slice(lx, {section}.n + 1, {section}.e - {section}.n - 1))"


def _between(lines: str, heads: str, k: str) -> str:
    """Lines after head ``k`` (0-based) and before the next head."""
    return (f"filter({lines}, y -> y.n > element_at({heads}, {k} + 1).n AND "
            f"y.n < coalesce(try_element_at({heads}, {k} + 2).n, 1000000000))")


def add_cards(df: DataFrame) -> DataFrame:
    """``cards``: name, line and the first value (with line) of each field."""
    df = _with(df, csp=f"filter({span('s_cards')}, x -> NOT x.f)")
    df = _with(df, chd=f"filter(csp, x -> x.s rlike {rx(H3)})")
    pattern = f"IF(kind = 'v3', {rx(CARD_FIELD_V3)}, {rx(CARD_FIELD_V4)})"
    df = _with(df, cfl=f"""transform(filter(csp, x -> x.s rlike {pattern}), x -> named_struct('n', x.n,
        'k', regexp_extract(x.s, {pattern}, 1), 'v', {strip_sql(f"regexp_extract(x.s, {pattern}, 2)")}))""")
    fields = {"definition": "定义", "appears": "出现", "depends": "依赖", "confusable": "易混", "original": "原文"}
    parts = ", ".join(
        f"'{name}', {first(f'filter(fl, z -> z.k = {chr(39)}{word}{chr(39)})')}" for name, word in fields.items())
    return _with(df, cards=f"""transform(transform(chd, (x, k) -> named_struct('n', x.n,
        'name', {strip_sql(f"regexp_extract(x.s, {rx(H3)}, 1)")}, 'no', k + 1, 'fl', {_between('cfl', 'chd', 'k')})),
        c -> named_struct('no', c.no, 'n', c.n, 'name', c.name, {parts.replace('(fl,', '(c.fl,')}))""")


def add_quiz(df: DataFrame) -> DataFrame:
    """``quiz``: stem, concept, answer lines, extra lines and folding per numbered item."""
    df = _with(df, qsp=span("s_quiz"))
    df = _with(df, qhd=f"filter(qsp, x -> x.s rlike {rx(NUM_ITEM)})")
    opened, closed, answer = rx(DETAILS_OPEN), rx(DETAILS_CLOSE), rx(ANSWER)
    blank = strip_sql("y.s")
    df = _with(df, qit=f"""transform(qhd, (x, k) -> named_struct('no', k + 1, 'n', x.n, 's', x.s,
        'body', {_between('qsp', 'qhd', 'k')}))""")
    # v3 answers count only inside <details>; a line with an opening tag is no answer.
    inside = f"""(coalesce(array_max(transform(filter(q.body, z -> z.n < y.n AND z.s rlike {opened}), z -> z.n)), 0) >
        coalesce(array_max(transform(filter(q.body, z -> z.n < y.n AND z.s rlike {closed} AND NOT z.s rlike {opened}
            AND NOT z.s rlike {answer}), z -> z.n)), 0))"""
    df = _with(df, qv=f"""transform(qit, q -> named_struct('no', q.no, 'n', q.n, 's', q.s,
        'folded', exists(q.body, y -> y.s rlike {opened}),
        'body', IF(kind = 'v3', filter(q.body, y -> {inside} AND NOT y.s rlike {opened}), q.body)))""")
    df = _with(df, qa=f"""transform(qv, q -> named_struct('no', q.no, 'n', q.n, 's', q.s, 'folded', q.folded, 'body', q.body,
        'a', {first(f"filter(q.body, y -> y.s rlike {answer})")}))""")
    extra = f"""IF(q.a IS NULL, slice(q.body, 1, 0), filter(q.body, y -> y.n > q.a.n AND {blank} <> '' AND
        IF(kind = 'v3', NOT y.s rlike {answer} AND NOT y.s rlike {closed},
           {blank} <> '---' AND NOT y.s rlike {rx(DETAILS_TAG)})))"""
    more = f"IF(kind = 'v3', filter(q.body, y -> y.s rlike {answer}), IF(q.a IS NULL, slice(q.body, 1, 0), array(q.a)))"
    return _with(df, quiz=f"""transform(qa, q -> named_struct('no', q.no, 'n', q.n,
        'stem', {strip_sql(f"regexp_replace(q.s, {rx(LEADING_NUM)}, '')")},
        'correspond', {strip_sql(f"nullif(regexp_extract(q.s, {rx(CORRESPOND)}, 1), '')")},
        'folded', q.folded, 'answered', q.a IS NOT NULL, 'answer', regexp_extract(q.a.s, {answer}, 1),
        'extra', size({extra}), 'raw', transform(concat({more}, {extra}), y -> y.s)))""")


def add_nav(df: DataFrame) -> DataFrame:
    """``nav``: entries of the time index with optional link."""
    pattern = f"IF(kind = 'v3', {rx(ENTRY_V3)}, {rx(ENTRY_V4)})"
    return _with(df, nav=f"""transform(filter({span('s_nav')}, x -> x.s rlike {pattern}), x -> named_struct('n', x.n,
        'sec', CAST(regexp_extract(x.s, {pattern}, 1) AS INT) * 60 + CAST(regexp_extract(x.s, {pattern}, 2) AS INT),
        'url', nullif(regexp_extract(x.s, {pattern}, 3), ''), 'title', regexp_extract(x.s, {pattern}, 4)))""")


def fence_blocks(lines: str, end: str) -> str:
    """Code blocks ``(lang, o, c)`` of a line array: a language fence opens, any fence closes."""
    return f"""aggregate(filter({lines}, x -> contains(x.s, '```') AND x.s rlike {rx(FENCE)}),
        named_struct('lang', CAST(NULL AS STRING), 'o', 0, 'out', slice(array(named_struct('lang', '', 'o', 0, 'c', 0)), 1, 0)),
        (s, x) -> CASE
            WHEN s.lang IS NOT NULL THEN named_struct('lang', CAST(NULL AS STRING), 'o', 0,
                'out', array_append(s.out, named_struct('lang', s.lang, 'o', s.o, 'c', x.n)))
            WHEN x.s rlike {rx(FENCE_LANG)} THEN named_struct('lang', lower(regexp_extract(x.s, {rx(FENCE_LANG)}, 1)), 'o', x.n, 'out', s.out)
            ELSE s END,
        s -> IF(s.lang IS NULL, s.out, array_append(s.out, named_struct('lang', s.lang, 'o', s.o, 'c', {end}))))"""


def add_map(df: DataFrame) -> DataFrame:
    """``kmb`` mermaid blocks of the map section, ``km*`` labels, groups and edge counts of the first."""
    df = _with(df, msp=span("s_map"))
    df = _with(df, kmb=f"filter({fence_blocks('msp', 's_map.e')}, b -> b.lang = 'mermaid')")
    strip_line = strip_sql("x.s")
    df = _with(df, kml=f"""filter(transform(filter(msp, x -> x.n > kmb[0].o AND x.n < kmb[0].c), x -> {strip_line}),
        s -> s <> '' AND NOT startswith(s, '%%') AND NOT s rlike {rx(MAP_FIRST)} AND s <> 'end')""".replace("kmb[0]", "try_element_at(kmb, 1)"))
    group = rx(r"^\s*subgraph\b")
    edges = "filter(kml, s -> NOT s rlike %s)" % group
    label = strip_sql("z")
    counts = " + ".join(f"size({all_matches('s', p, 0)})" for p in EDGE_LABELS)
    return _with(
        df,
        km_labels=f"""flatten(transform({edges}, s -> transform({all_matches("regexp_replace(s, r'[|][^|]*[|]', ' ')", NODE_LABEL, 1)}, z -> {label})))""",
        km_groups=f"""transform(filter(kml, s -> s rlike {group}), s -> coalesce({strip_sql(first(all_matches('s', NODE_LABEL, 1)))},
            {strip_sql('substring(s, 9, length(s))')}))""",
        km_edges=f"aggregate({edges}, 0, (a, s) -> a + size({all_matches('s', EDGE_ANY, 0)}))",
        km_labeled=f"aggregate({edges}, 0, (a, s) -> a + {counts})",
    )


def label_width(x: str) -> str:
    """Full-width characters count one, others one half."""
    return f"((length({x}) + regexp_count({x}, r'{WIDE}')) / 2.0D)"


def add_label_problems(df: DataFrame) -> DataFrame:
    """``lab``: mermaid labels ``(n, label, bad, width)`` that are too wide or hold brackets."""
    df = _with(df, mmb=f"filter({fence_blocks('lx', 'size(ln) + 1')}, b -> b.lang = 'mermaid')")
    first_line = first(f"filter(transform(slice(ln, b.o + 1, b.c - b.o - 1), l -> {strip_sql('l')}), l -> l <> '')")
    df = _with(df, mmk=f"transform(mmb, b -> named_struct('o', b.o, 'c', b.c, 'first', coalesce({first_line}, '')))")
    shell = "CASE " + " ".join(
        f"WHEN s rlike {rx(p)} THEN {strip_sql(f'regexp_extract(s, {rx(p)}, 1)')}" for p in MINDMAP_SHELLS) + " ELSE s END"
    line = strip_sql("x.s")
    labels = f"""IF(startswith(b.first, 'mindmap'),
        transform(filter(transform(slice(lx, b.o + 1, b.c - b.o - 1), x -> named_struct('n', x.n, 's', {line})),
            x -> x.s <> '' AND NOT startswith(x.s, '%%') AND NOT startswith(x.s, '::')),
            x -> named_struct('n', x.n, 'label', {shell.replace('(s,', '(x.s,').replace('WHEN s ', 'WHEN x.s ').replace('ELSE s ', 'ELSE x.s ')})),
        flatten(transform(filter(transform(slice(lx, b.o + 1, b.c - b.o - 1), x -> named_struct('n', x.n, 's', {line})),
            x -> x.s <> '' AND NOT startswith(x.s, '%%')),
            x -> transform({all_matches('x.s', GRAPH_LABEL, 1)}, z -> named_struct('n', x.n, 'label', {strip_sql('z')})))))"""
    df = _with(df, lab0=f"""flatten(transform(filter(mmk, b -> b.first rlike {rx(MAP_FIRST)}), b -> {labels}))""")
    return _with(df, lab=f"""filter(transform(lab0, x -> named_struct('n', x.n, 'label', x.label,
        'bad', x.label rlike {rx(LABEL_BAD)}, 'width', {label_width('x.label')})), x -> x.bad OR x.width > {LABEL_MAX_WIDTH})""")


def add_images(df: DataFrame) -> DataFrame:
    """``img``: references outside fences ``(n, alt, path, num, title)`` with their section."""
    pairs = f"zip_with({all_matches('x.s', IMAGE, 1)}, {all_matches('x.s', IMAGE, 2)}, (a, b) -> named_struct('alt', a, 'path', b))"
    one = f"""transform({pairs}, z -> named_struct(
        'n', x.n, 'alt', {strip_sql('z.alt')}, 'path', replace(z.path, chr(92), '/'),
        'num', IF(x.g = 0, NULL, try_cast(nullif(regexp_extract(element_at(ln, x.g), {rx(SEC_NUM)}, 1), '') AS INT)),
        'title', IF(x.g = 0, '', {strip_sql(f"regexp_extract(element_at(ln, x.g), {rx(H2)}, 1)")})))"""
    df = _with(df, img0=f"""filter(flatten(transform(filter(lx, x -> NOT x.f AND contains(x.s, '![')), x -> {one})),
        z -> startswith(z.path, 'images/'))""")
    return _with(df, img="""transform(img0, (x, i) -> named_struct('n', x.n, 'o', i, 'alt', x.alt, 'path', x.path, 'num', x.num, 'title', x.title))""")


# ---------------------------------------------------------------- tables

def fence_state(notes: DataFrame) -> DataFrame:
    return outline(notes).select("note_id", F.explode("lx").alias("x")).select(
        "note_id", F.col("x.n").alias("line_no"), F.col("x.f").alias("in_fence"))


def note_sections(notes: DataFrame) -> DataFrame:
    """Every section with its substantive lines; the part before any heading has no title."""
    df = outline(notes)
    head = "named_struct('n', 0, 'e', coalesce(try_element_at(hi, 1), size(ln) + 1), 't', CAST(NULL AS STRING), 'num', CAST(NULL AS INT), 'f', false)"
    df = df.select("note_id", "ln", F.posexplode(F.expr(f"concat(array({head}), h2s)")).alias("sec_no", "s"))
    return df.select(
        "note_id", "sec_no", F.col("s.t").alias("title"), (F.col("s.n")).alias("line_no"),
        F.expr(f"size(filter(slice(ln, s.n + 1, s.e - s.n - 1), l -> {substantive('l')}))").alias("lines"))


def section_span(notes: DataFrame, keyword: str) -> DataFrame:
    """First section whose title holds the keyword: its heading line and the line after its end."""
    hit = F.expr(first(f"filter(h2s, x -> contains(x.t, '{keyword}'))"))
    return outline(notes).select("note_id", hit.alias("s")).filter("s IS NOT NULL").select(
        "note_id", F.col("s.n").alias("head"), F.col("s.e").alias("end"))


def note_frontmatter(notes: DataFrame) -> DataFrame:
    """Simple scalars ``(note_id, key, value)``; the last of repeated keys counts."""
    df = outline(notes).select("note_id", F.posexplode("fm").alias("i", "x"))
    return df.groupBy("note_id", F.col("x.k").alias("key")).agg(F.max_by("x.v", "i").alias("value"))


def concept_cards(notes: DataFrame) -> DataFrame:
    df = add_cards(outline(notes)).select("note_id", F.explode("cards").alias("c"))
    return df.select("note_id", F.col("c.no").alias("card_no"), F.col("c.n").alias("line_no"), "c.name",
                     *[F.col(f"c.{f}.v").alias(f) for f in ("definition", "appears", "depends", "confusable", "original")])


def card_appearances(notes: DataFrame) -> DataFrame:
    df = add_cards(outline(notes)).select("note_id", F.explode("cards").alias("c"))
    pair = f"""zip_with({all_matches('c.appears.v', APPEAR_V4, 1)}, {all_matches('c.appears.v', APPEAR_V4, 2)},
        (a, b) -> named_struct('section', CAST(a AS INT), 'title', b))"""
    return df.select("note_id", F.col("c.no").alias("card_no"), "c.name", F.posexplode(F.expr(pair)).alias("pos", "p")).select(
        "note_id", "card_no", "name", "pos", "p.section", "p.title")


def quiz_items(notes: DataFrame) -> DataFrame:
    return add_quiz(outline(notes)).select("note_id", F.explode("quiz").alias("q")).select(
        "note_id", "q.no", F.col("q.n").alias("line_no"), "q.stem", "q.correspond",
        "q.answered", "q.folded", F.col("q.extra").alias("extra_lines"), F.coalesce("q.answer", F.lit("")).alias("answer"))


def nav_entries(notes: DataFrame) -> DataFrame:
    return add_nav(outline(notes)).select("note_id", F.explode("nav").alias("e")).select(
        "note_id", F.col("e.n").alias("line_no"), F.col("e.sec").alias("ts_sec"), "e.url", "e.title")


def km_nodes(notes: DataFrame) -> DataFrame:
    """Node labels and group titles of the first knowledge map."""
    df = add_map(outline(notes)).select("note_id", F.expr(
        "concat(transform(km_labels, x -> named_struct('kind', 'node', 'label', x)), transform(km_groups, x -> named_struct('kind', 'group', 'label', x)))").alias("a"))
    return df.select("note_id", F.explode("a").alias("x")).select("note_id", "x.kind", "x.label")


def km_edges(notes: DataFrame) -> DataFrame:
    return add_map(outline(notes)).filter("size(kmb) > 0").select(
        "note_id", F.col("km_edges").alias("edges"), F.col("km_labeled").alias("labeled_edges"))


def mermaid_label_check(notes: DataFrame) -> DataFrame:
    return add_label_problems(outline(notes)).select("note_id", F.explode("lab").alias("x")).select(
        "note_id", F.col("x.n").alias("line_no"), "x.label", F.col("x.bad").alias("has_brackets"), "x.width")


def image_refs(notes: DataFrame) -> DataFrame:
    """Image references outside fences with their numbered section; notes whose images are known are not parsed again."""
    return (notes if "img" in notes.columns else add_images(outline(notes))).select("note_id", F.explode("img").alias("x")).select(
        "note_id", F.col("x.n").alias("line_no"), "x.alt", "x.path", F.col("x.num").alias("section"))


LOCAL_REFS = f"""array_distinct(concat(filter({all_matches("array_join(ln, chr(10))", IMAGE, 2)}, p -> NOT p rlike '^https?://'),
    {all_matches("array_join(ln, chr(10))", IMAGE_BARE, 0)}))"""


def local_images(df: DataFrame) -> DataFrame:
    """Distinct local image paths a note refers to, fenced or not, linked or bare."""
    refs = F.col("refs") if "refs" in df.columns else F.expr(LOCAL_REFS)
    return df.select("note_id", "kind", F.explode(refs).alias("path"))


def visible_notes(notes: DataFrame, **kept: str) -> DataFrame:
    """Notes with front matter and code blocks blanked, line numbers kept; ``raw`` is the text, ``kept`` columns of the outline."""
    df = outline(notes)
    seen = f"transform(lx, x -> IF(x.f OR x.s rlike {rx(FENCE)}, '', x.s))"
    return df.select(
        *[c for c in notes.columns if c not in ("text", "template")], F.col("text").alias("raw"),
        *[F.expr(v).alias(k) for k, v in kept.items()],
        F.expr(f"array_join(concat(array_repeat('', off), {seen}), chr(10))").alias("text"),
        F.lit("v4").alias("template"))


def course_nav(notes: DataFrame) -> DataFrame:
    """First index entry of each numbered section: ``(note_id, section, time, url)``."""
    number = rx(r"^(\d{1,2})\s*[.、．]")
    df = add_nav(outline(visible_notes(notes))).select("note_id", F.explode("nav").alias("e"))
    df = df.filter(f"e.title rlike {number}").select(
        "note_id", F.expr(f"CAST(regexp_extract(e.title, {number}, 1) AS INT)").alias("section"), "e.n",
        tx.mmss(F.col("e.sec")).alias("time"), "e.url")
    return df.groupBy("note_id", "section").agg(F.min_by(F.struct("time", "url"), "n").alias("x")).select(
        "note_id", "section", "x.*")


def parse_course_notes(notes: DataFrame) -> DataFrame:
    """One row per note: type, hash, counts of its parts, and whether its card section is missing."""
    df = add_nav(add_quiz(add_cards(outline(visible_notes(notes, kind0="kind", ft=fm_value("note_type"))))))
    kind = "coalesce(IF(kind0 = 'v4-obsidian', ft, NULL), 'lecture')"
    rows = df.select("note_id", F.sha2("raw", 256).alias("sha"), F.expr("s_cards IS NULL").alias("no_cards"),
                     F.expr("size(array_distinct(transform(filter(h2s, h -> h.num IS NOT NULL), h -> h.num)))").alias("sections"),
                     F.size("cards").alias("cards"), F.size("quiz").alias("questions"), F.size("nav").alias("entries"), "kind0", "ft")
    # each note is written and parsed once; only these few values of it meet the front matter of its id
    rows = durable_checkpoint(rows)
    return rows.drop("kind0", "ft").join(rows.select("note_id", "kind0", "ft"), "note_id").select(
        "note_id", "sha", F.expr(kind).alias("note_type"), "sections", "cards", "questions", "entries",
        F.expr(f"IF(no_cards AND {kind} <> 'short', 'no card section', '')").alias("error"))
