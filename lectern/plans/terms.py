"""Term correction queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions.text import BLANK
from lectern.operators import terms as op
from lectern.plans.captions import sql_strip
from lectern.plans.inputs import frame, stamped_docs, with_inputs, COMMON
from lectern.plans.registry import Registry

REG = Registry()

# A two-layer dictionary over word parts that occur in the documents.
ENTRIES = """
    SELECT CAST(layer AS INT) AS layer, area, category, wrong, correct, CAST(hits AS INT) AS hits,
           '' AS source, disabled, CAST(ord AS BIGINT) AS ord
    FROM (VALUES
        (0, 'categories', '编程', 'eau', 'water（法语）', 5, FALSE, 1),
        (0, 'categories', '编程', 'eaux', 'waters', 3, FALSE, 2),
        (0, 'categories', '通用', 'que', 'that', 9, FALSE, 3),
        (0, 'categories', '通用', 'th', 'TH', 0, FALSE, 4),
        (0, 'categories', '通用', 'The', 'DEF (article)', 7, FALSE, 5),
        (0, 'candidates', '通用', 'the', 'hidden', 0, FALSE, 6),
        (0, 'candidates', '美食', 'tion', 'TION', 2, FALSE, 7),
        (0, 'candidates', '游戏', 'ent', 'ENT', 1, FALSE, 8),
        (0, 'categories', '游戏', 'und', 'off', 1, TRUE, 9),
        (1, 'categories', '游戏', 'ING', 'gerund', 4, FALSE, 10),
        (1, 'categories', '通用', 'que', 'what', 6, FALSE, 11),
        (1, 'categories', '美食', 'ción', 'cion', 6, FALSE, 12),
        (1, 'candidates', '美食', 'über', 'ueber', 1, FALSE, 13),
        (1, 'categories', '美食', 'été', '（夏天）', 1, FALSE, 14)
    ) AS v(layer, area, category, wrong, correct, hits, disabled, ord)"""

GLOSSARY = """
    SELECT CAST(p_partkey % 2 AS INT) AS layer,
           CASE WHEN p_size % 4 = 0 THEN 'candidates' ELSE 'categories' END AS area, p_type AS category,
           CASE WHEN p_partkey % 3 = 0 THEN upper(p_name) ELSE p_name END || ' ' || p_brand AS wrong,
           CASE p_size % 5 WHEN 0 THEN p_brand || '（' || p_name || '）' WHEN 1 THEN p_name || ' (x)'
                WHEN 2 THEN '（only）' ELSE upper(p_name) END AS correct,
           p_size AS hits, CASE WHEN p_size % 2 = 0 THEN '' ELSE 'import' END AS source,
           p_size % 7 = 0 AS disabled, p_partkey AS ord
    FROM {part}"""
GLOSSARY_SQL = "g AS (" + GLOSSARY.replace("{part}", "part") + ")"

_MAIN = "regexp_replace(regexp_extract(correct, '^[^（(]*', 0), '^\\s+|\\s+$', '', 'g')"
ACTIVE_SQL = f"""
    n AS (SELECT *, {_MAIN} AS "right", lower(wrong) AS key FROM g),
    act0 AS (SELECT *, row_number() OVER (PARTITION BY area, lower(wrong) ORDER BY layer DESC, ord DESC) AS k,
                   row_number() OVER (PARTITION BY area, lower(wrong) ORDER BY layer, ord) AS f,
                   min(layer * 1000000000 + ord) OVER (PARTITION BY area, lower(wrong)) AS first_ord
            FROM n WHERE NOT disabled AND "right" <> ''),
    act AS (SELECT * FROM act0 WHERE k = 1)"""
KEYS_SQL = """
    keys AS (SELECT key, arg_min("right", area = 'candidates') AS "right", arg_min(category, area = 'candidates') AS category,
                    bool_and(area = 'candidates') AS candidate FROM act GROUP BY key)"""
# Longest first, as the scan does it; kept in step with ENTRIES.
PATTERN = "(?i)über|ción|eaux|tion|que|the|eau|ent|ing|th"


def _active(t):
    return op.active_entries(t.sql(ENTRIES))


def _docs(t):
    return stamped_docs(t).select(F.col("video_id").alias("doc_id"), "text")


_BASE = with_inputs("stamped_docs") + f", g AS ({ENTRIES}), {ACTIVE_SQL}, {KEYS_SQL}"
HITS_SQL = _BASE + rf""",
    d AS (SELECT video_id, text, regexp_extract_all(text, '{PATTERN}') AS m,
                 regexp_split_to_array(text, '{PATTERN}') AS gp,
                 regexp_extract_all(text, '\[\d{{1,2}}:\d{{2}}\]') AS tm,
                 regexp_split_to_array(text, '\[\d{{1,2}}:\d{{2}}\]') AS tg FROM stamped_docs),
    h AS (SELECT video_id, text, unnest(m) AS wrong, unnest(gp[1:len(m)]) AS gap, generate_subscripts(m, 1) AS i FROM d),
    o AS (SELECT *, sum(length(gap) + length(wrong)) OVER (PARTITION BY video_id ORDER BY i) AS e FROM h),
    tk AS (SELECT video_id, unnest(tm) AS mark, unnest(tg[1:len(tm)]) AS gap, generate_subscripts(tm, 1) AS i FROM d),
    tp AS (SELECT video_id, mark, sum(length(gap) + length(mark)) OVER (PARTITION BY video_id ORDER BY i) - length(mark) AS pos FROM tk),
    hits AS (SELECT o.video_id AS doc_id, coalesce(trim(tp.mark, '[]'), '--:--') AS ts, wrong, keys."right", keys.category,
           keys.candidate, replace(substring(text, CAST(greatest(e - length(wrong) - 20, 0) AS BIGINT) + 1,
                CAST(least(20, e - length(wrong)) AS BIGINT)) || '【' || wrong || '】' || substring(text, CAST(e AS BIGINT) + 1, 20),
                chr(10), ' ') AS context
        FROM o JOIN keys ON keys.key = lower(o.wrong)
        ASOF LEFT JOIN tp ON o.video_id = tp.video_id AND o.e - length(o.wrong) >= tp.pos)"""
_COLUMNS = ("doc_id", "ts", "wrong", "right", "category", "candidate", "context")


@REG.query("scan_terms", HITS_SQL + "SELECT * FROM hits")
def _(t):
    return op.scan_terms(_docs(t), op.scan_keys(_active(t))).select(*_COLUMNS)


@REG.query("scan_terms_large_dictionary", HITS_SQL + "SELECT * FROM hits")
def _(t):
    return op.scan_terms(_docs(t), op.scan_keys(_active(t)), inline=False).select(*_COLUMNS)


_APPLIED = _BASE + f""",
    d AS (SELECT video_id, text, regexp_extract_all(text, '{PATTERN}') AS m,
                 regexp_split_to_array(text, '{PATTERN}') AS gp FROM stamped_docs),
    h AS (SELECT video_id, unnest(list_append(m, '')) AS wrong, unnest(gp) AS gap, generate_subscripts(gp, 1) AS i FROM d)
    SELECT video_id AS doc_id, string_agg(gap || coalesce(CASE WHEN NOT candidate THEN "right" END, wrong), '' ORDER BY i) AS text
    FROM h LEFT JOIN keys ON keys.key = lower(h.wrong) GROUP BY 1"""


@REG.query("apply_terms", _APPLIED)
def _(t):
    return op.apply_terms(_docs(t), op.scan_keys(_active(t)))


@REG.query("apply_terms_large_dictionary", _APPLIED)
def _(t):
    return op.apply_terms(_docs(t), op.scan_keys(_active(t)), inline=False)


@REG.query("summarize_hits", HITS_SQL + """
    SELECT doc_id, category, count(*) FILTER (NOT candidate) AS hits, count(*) FILTER (candidate) AS candidate_hits,
           count(*) FILTER (NOT candidate) AS replaced
    FROM hits GROUP BY GROUPING SETS ((doc_id, category), (doc_id), (category), ())""")
def _(t):
    return op.summarize_hits(op.scan_terms(_docs(t), op.scan_keys(_active(t))), applied=True)


@REG.query("accumulate_hits", HITS_SQL + """
    SELECT layer, area, category, wrong, correct, CAST(hits + CASE WHEN EXISTS (SELECT 1 FROM hits h JOIN act a
               ON a.key = lower(h.wrong) AND a.area = 'categories' WHERE NOT h.candidate AND a.layer = g.layer
               AND a.category = g.category AND a.wrong = g.wrong AND g.area = 'categories') THEN 1 ELSE 0 END AS INT) AS hits,
           source, disabled, ord
    FROM g""")
def _(t):
    glossary = t.sql(ENTRIES)
    active = op.active_entries(glossary)
    return op.accumulate_hits(glossary, op.scan_terms(_docs(t), op.scan_keys(active)), active)


@REG.query("term_hits_flat", with_inputs("stamped_docs") + f""",
    d AS (SELECT video_id, text, regexp_extract_all(text, '(?i)tion|th|en') AS m,
                 regexp_split_to_array(text, '(?i)tion|th|en') AS gp FROM stamped_docs),
    h AS (SELECT video_id, text, unnest(m) AS wrong, unnest(gp[1:len(m)]) AS gap, generate_subscripts(m, 1) AS i FROM d),
    o AS (SELECT *, sum(length(gap) + length(wrong)) OVER (PARTITION BY video_id ORDER BY i) AS e FROM h)
    SELECT video_id AS doc_id, wrong, CASE lower(wrong) WHEN 'tion' THEN 'TION' WHEN 'th' THEN 'þ' ELSE 'EN' END AS "right",
           replace(substring(text, CAST(greatest(e - length(wrong) - 20, 0) AS BIGINT) + 1, CAST(least(20, e - length(wrong)) AS BIGINT))
             || '【' || wrong || '】' || substring(text, CAST(e AS BIGINT) + 1, 20), chr(10), ' ') AS context
    FROM o""")
def _(t):
    flat = t.sql("SELECT * FROM VALUES ('tion', 'TION', 1L), ('TH', 'old', 2L), ('th', 'þ', 3L), ('en', 'EN', 4L) AS v(wrong, right, ord)")
    return op.term_hits_flat(_docs(t), flat).select("doc_id", "wrong", "right", "context")


def _glossary(t):
    return t.sql(GLOSSARY)


@REG.query("migrate_glossary", """
    SELECT p_name || ' ' || p_brand AS wrong, arg_max(upper(p_type), p_partkey) AS correct,
           CASE WHEN regexp_matches(lower(p_name || ' ' || p_brand || ' ' || arg_max(p_type, p_partkey)), 'war包|json|sql|bean|metric|api|gpt|warn|clone|aware|spring|java') THEN '编程' ELSE '通用' END AS category
    FROM (SELECT CASE WHEN p_size % 10 = 0 THEN 'spring ' || p_name WHEN p_size % 10 = 1 THEN p_name || ' api' ELSE p_name END AS p_name,
                 p_brand, p_type, p_partkey FROM part) GROUP BY p_name, p_brand""")
def _(t):
    flat = t.part.selectExpr(
        "CASE WHEN p_size % 10 = 0 THEN 'spring ' || p_name WHEN p_size % 10 = 1 THEN p_name || ' api' ELSE p_name END || ' ' || p_brand AS wrong",
        "upper(p_type) AS correct", "p_partkey AS ord")
    return op.migrate_glossary(flat)


@REG.query("merge_glossary_layers", f"""WITH {GLOSSARY_SQL},
    r AS (SELECT *, row_number() OVER (PARTITION BY area, category, wrong ORDER BY layer DESC, ord DESC) AS k FROM g)
    SELECT area, category, wrong, layer, correct, hits, source, disabled FROM r WHERE k = 1""")
def _(t):
    return op.merge_glossary_layers(_glossary(t))


@REG.query("active_entries", f"""WITH {GLOSSARY_SQL}, {ACTIVE_SQL}
    SELECT area, key, wrong, "right", category, layer, hits FROM act""")
def _(t):
    return op.active_entries(_glossary(t)).drop("first_ord")


@REG.query("active_entries_topic", f"""WITH {GLOSSARY_SQL.replace('{part}', 'part')[:-1]} WHERE p_type IN ('ECONOMY', 'SMALL', 'PROMO')
        AND (p_size % 4 <> 0 OR p_type = 'PROMO')), {ACTIVE_SQL}
    SELECT area, key, wrong, "right", category, layer, hits FROM act""")
def _(t):
    return op.active_entries(_glossary(t), ["ECONOMY", "SMALL", "PROMO"], "PROMO").drop("first_ord")


_ADDITIONS = """
    SELECT CAST(p_partkey % 2 AS INT) AS layer, p_type AS category, ' ' || p_name || ' ' || p_brand || ' ' AS wrong,
           CASE WHEN p_size % 13 = 0 THEN ' ' ELSE lower(p_type) END AS correct, p_size % 3 = 0 AS candidate, p_partkey AS ord
    FROM {part} WHERE p_retailprice < 1000"""


@REG.query("upsert_terms", f"""WITH {GLOSSARY_SQL}, a AS ({_ADDITIONS.replace('{part}', 'part')}),
    base AS (SELECT * FROM g WHERE ord % 2 = 1 QUALIFY row_number() OVER (PARTITION BY layer, area, category, wrong ORDER BY ord) = 1),
    c AS (SELECT layer, CASE WHEN candidate THEN 'candidates' ELSE 'categories' END AS area, category, trim(wrong) AS wrong,
                 arg_max(correct, ord) AS correct, max(ord) AS ord FROM a WHERE trim(correct) <> '' GROUP BY ALL),
    u AS (SELECT layer, area, category, wrong, coalesce(c.correct, b.correct) AS correct, coalesce(hits, 0) AS hits,
                 CASE WHEN c.ord IS NULL THEN source ELSE 'manual:2026-12-01' END AS source,
                 CASE WHEN c.ord IS NULL THEN disabled ELSE FALSE END AS disabled, coalesce(b.ord, c.ord) AS ord
          FROM base b FULL JOIN c USING (layer, area, category, wrong))
    SELECT * FROM u WHERE NOT (area = 'candidates' AND EXISTS (SELECT 1 FROM c WHERE c.area = 'categories'
        AND c.layer = u.layer AND c.category = u.category AND c.wrong = u.wrong))""")
def _(t):
    base = _glossary(t).filter("ord % 2 = 1").groupBy("layer", "area", "category", "wrong").agg(
        F.min_by(F.struct("correct", "hits", "source", "disabled", "ord"), "ord").alias("e")
    ).select("layer", "area", "category", "wrong", "e.*")
    return op.upsert_terms(base, t.sql(_ADDITIONS), "2026-12-01")


_REQUESTS = """
    SELECT o_orderkey AS request_id, CASE WHEN o_orderkey % 4 = 0 THEN upper(p_name) ELSE p_name END || ' ' || p_brand AS word,
           CASE WHEN o_orderkey % 3 = 0 THEN p_type WHEN o_orderkey % 3 = 1 THEN 'SMALL' ELSE NULL END AS category
    FROM {orders} o JOIN {part} p ON p_partkey = o_custkey"""
_PROMOTED = f"""WITH g0 AS ({GLOSSARY.replace('{part}', 'part')}), r AS ({_REQUESTS.replace('{orders}', 'orders').replace('{part}', 'part')}),
    g AS (SELECT * FROM g0 QUALIFY row_number() OVER (PARTITION BY layer, area, category, wrong ORDER BY ord) = 1),
    f AS (SELECT r.request_id, r.category AS asked, g.* FROM r LEFT JOIN g ON lower(g.wrong) = lower(r.word) AND g.area = 'candidates'),
    l AS (SELECT *, max(layer) OVER (PARTITION BY request_id) AS top FROM f),
    c AS (SELECT * FROM l WHERE layer IS NOT DISTINCT FROM top),
    s AS (SELECT request_id, count(wrong) AS found, count(wrong) FILTER (asked IS NULL OR asked = category) AS fit,
                 min(category) FILTER (asked IS NULL OR asked = category) AS category,
                 min(wrong) FILTER (asked IS NULL OR asked = category) AS wrong,
                 min(correct) FILTER (asked IS NULL OR asked = category) AS correct,
                 min(hits) FILTER (asked IS NULL OR asked = category) AS hits,
                 min(source) FILTER (asked IS NULL OR asked = category) AS source, min(top) AS layer FROM c GROUP BY 1)"""


@REG.query("promote_terms", _PROMOTED + """
    SELECT request_id, CASE WHEN found = 0 THEN 'missing' WHEN fit = 0 THEN 'not_in_category' WHEN fit > 1 THEN 'ambiguous' ELSE 'promoted' END AS status,
           CASE WHEN fit = 1 THEN category END AS category, CASE WHEN fit = 1 THEN wrong END AS wrong,
           CASE WHEN fit = 1 THEN correct END AS correct, CASE WHEN fit = 1 THEN hits END AS hits,
           CASE WHEN fit = 1 THEN layer END AS layer,
           CASE WHEN fit = 1 THEN CASE WHEN source = '' THEN '' ELSE source || ' | ' END || 'promoted:2026-12-01' END AS source
    FROM s""")
def _(t):
    return op.promote_terms(_unique_glossary(t), t.sql(_REQUESTS), "2026-12-01")


def _unique_glossary(t):
    return _glossary(t).groupBy("layer", "area", "category", "wrong").agg(
        F.min_by(F.struct("correct", "hits", "source", "disabled", "ord"), "ord").alias("e")
    ).select("layer", "area", "category", "wrong", "e.*")


@REG.query("apply_promotions", _PROMOTED + """,
    mv AS (SELECT DISTINCT layer, category, wrong FROM s WHERE fit = 1)
    SELECT g.layer, CASE WHEN mv.wrong IS NOT NULL THEN 'categories' ELSE area END AS area, g.category, g.wrong, correct, hits,
           CASE WHEN mv.wrong IS NOT NULL THEN CASE WHEN source = '' THEN '' ELSE source || ' | ' END || 'promoted:2026-12-01' ELSE source END AS source,
           disabled, ord
    FROM g LEFT JOIN mv ON mv.layer = g.layer AND mv.category = g.category AND mv.wrong = g.wrong
    WHERE NOT (area = 'categories' AND mv.wrong IS NOT NULL)""")
def _(t):
    g = _unique_glossary(t)
    return op.apply_promotions(g, op.promote_terms(g, t.sql(_REQUESTS), "2026-12-01"))


@REG.query("glossary_inventory", f"""WITH {GLOSSARY_SQL},
    r AS (SELECT *, row_number() OVER (PARTITION BY area, category, wrong ORDER BY layer DESC, ord DESC) AS k FROM g)
    SELECT category, count(*) FILTER (area = 'categories') AS official, count(*) FILTER (area = 'candidates') AS candidates,
           count(*) FILTER (disabled) AS disabled FROM r WHERE k = 1 GROUP BY category""")
def _(t):
    return op.glossary_inventory(_glossary(t))


@REG.query("top_terms", f"""WITH {GLOSSARY_SQL}, {ACTIVE_SQL}
    SELECT "right", max(hits) AS hits FROM act WHERE area = 'categories' GROUP BY 1 ORDER BY hits DESC, min(first_ord) LIMIT 20""")
def _(t):
    return op.top_terms(op.active_entries(_glossary(t)))


@REG.query("prompt_terms", f"""WITH {GLOSSARY_SQL}, {ACTIVE_SQL},
    b AS (SELECT category, "right", max(hits) AS hits, min(first_ord) AS fo FROM act WHERE area = 'categories' GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY hits DESC, fo) AS n FROM b)
    SELECT category, '以下是普通话的简体中文转写。 常听术语：' || string_agg("right", '、' ORDER BY n) AS prompt
    FROM r WHERE n <= 20 GROUP BY category""")
def _(t):
    return op.prompt_terms(op.active_entries(_glossary(t)))
