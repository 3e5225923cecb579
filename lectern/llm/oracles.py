"""DuckDB SQL of the queries that SQL can express, straight from their definitions."""

from __future__ import annotations

_SPACED = r"[^\x20\x09-\x0D]+"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def removal(size: int) -> str:
    """Words covered by a window of `size` words that also starts earlier."""
    return f"""
WITH w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_SPACED}') AS ws FROM documents),
     p AS (SELECT doc_id, ws, unnest(range(1, len(ws) - {size} + 2)) AS s FROM w WHERE len(ws) >= {size}),
     k AS (SELECT doc_id, s, md5(array_to_string(ws[s:s + {size - 1}], ' ')) AS h FROM p),
     r AS (SELECT doc_id, s FROM k QUALIFY row_number() OVER (PARTITION BY h ORDER BY doc_id, s) > 1),
     g AS (SELECT DISTINCT doc_id, unnest(range(s, s + {size})) AS i FROM r),
     a AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
     b AS (SELECT a.doc_id, string_agg(word, ' ' ORDER BY a.i) FILTER (g.i IS NULL) AS kept, count(g.i) AS gone
           FROM a LEFT JOIN g ON g.doc_id = a.doc_id AND g.i = a.i GROUP BY a.doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN b ON b.doc_id = w.doc_id"""


COMPONENTS = f"""
WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, regexp_extract_all({_LOWER}, '{_SPACED}') AS ws FROM documents),
     s AS MATERIALIZED (SELECT DISTINCT doc_id, h FROM (
           SELECT doc_id, md5(array_to_string(ws[i:i + 4], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0))),
     n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
     l AS MATERIALIZED (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.h = y.h AND x.doc_id <> y.doc_id GROUP BY ALL) t
           JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 75 * (na.n + nb.n - c)),
     reach AS (SELECT doc_id AS d, doc_id AS r FROM documents UNION SELECT reach.d, l.b FROM reach JOIN l ON l.a = reach.r)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, (SELECT min(r) FROM reach WHERE d = w.doc_id) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id"""

CONTAMINATION = f"""
WITH w AS MATERIALIZED (SELECT doc_id, regexp_extract_all({_LOWER}, '{_ALNUM}') AS ws FROM documents),
     b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWER}, '{_ALNUM}') AS ws FROM benchmark),
     t AS MATERIALIZED (SELECT DISTINCT item, least(len(ws), 10) AS k, array_to_string(ws[i:i + least(len(ws), 10) - 1], ' ') AS g
           FROM (SELECT *, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) AS i FROM b WHERE len(ws) > 0)),
     z AS (SELECT DISTINCT k FROM t),
     d AS (SELECT doc_id, k, i, array_to_string(ws[i:i + k - 1], ' ') AS g FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, z WHERE len(ws) >= k)),
     h AS MATERIALIZED (SELECT d.doc_id, d.i, d.k, t.item FROM d JOIN t ON t.k = d.k AND t.g = d.g),
     c AS (SELECT doc_id, count(DISTINCT i) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS i FROM h) GROUP BY doc_id),
     m AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(c.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(m.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(c.n, 0) > 0 AS contaminated
FROM w LEFT JOIN c ON c.doc_id = w.doc_id LEFT JOIN m ON m.doc_id = w.doc_id"""

def prefix_trie(every: int = 20) -> str:
    """Nodes straight from their definition; crc32 bit by bit, since DuckDB has no such function."""
    bit = "xor(x >> 1, 3988292384 * (x & 1))"
    crc = f"""xor(4294967295, list_reduce(list_transform(string_split(CAST(c AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT)),
              lambda a, b: list_reduce(range(8), lambda x, i: {bit}, xor(a, b)), CAST(4294967295 AS BIGINT)))"""
    return f"""
WITH RECURSIVE t AS (SELECT conv_id AS c, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL),
     o AS (SELECT c, list({{'r': r, 'x': x}} ORDER BY turn NULLS FIRST, r, x) AS own FROM t GROUP BY c),
     h AS (SELECT c, own, c - c % {every} AS base, {crc} % 4 AS h FROM o),
     s AS MATERIALIZED (SELECT h.c, list_concat(list_slice(coalesce(b.own, []), 1, h.h), list_slice(h.own, h.h + 1, len(h.own))) AS ts FROM h LEFT JOIN o b ON b.c = h.base),
     p AS MATERIALIZED (SELECT c, d, len(ts) AS n, sha256(CAST(list_slice(ts, 1, d) AS VARCHAR)) AS k, CASE WHEN d > 0 THEN sha256(CAST(list_slice(ts, 1, d - 1) AS VARCHAR)) END AS pk,
            CASE WHEN d > 0 THEN len(regexp_extract_all(ts[d].x, '{_SPACED}')) ELSE 0 END AS words
           FROM (SELECT c, ts, unnest(range(0, len(ts) + 1)) AS d FROM s)),
     n AS MATERIALIZED (SELECT d, k, min(pk) AS pk, min(c) AS id, count(*) AS members, max(words) AS words,
            coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (n = d), '') AS ends FROM p GROUP BY d, k),
     q AS MATERIALIZED (SELECT n.*, (SELECT count(*) FROM n m WHERE m.pk = n.k AND m.d = n.d + 1) AS kids, (SELECT m.id FROM n m WHERE m.k = n.pk AND m.d = n.d - 1) AS parent FROM n),
     u AS (SELECT d AS top_d, k AS top_k, d, k, (members - 1) * words AS saved, kids FROM q
           UNION ALL SELECT top_d, top_k, q.d, q.k, (q.members - 1) * q.words, q.kids FROM u JOIN q ON q.pk = u.k AND q.d = u.d + 1),
     a AS (SELECT top_d, top_k, sum(saved) AS saved, count(*) FILTER (kids = 0) AS leaves FROM u GROUP BY ALL)
SELECT q.id AS conv_id, CAST(q.d AS BIGINT) AS depth, q.parent AS parent_conv_id, CAST(members AS BIGINT) AS n_convs, CAST(kids AS BIGINT) AS n_children,
       CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(ends) AS ends_sha256
FROM q JOIN a ON a.top_d = q.d AND a.top_k = q.k"""


def collocations(top: int = 2000, least: int = 30, share: int = 80) -> str:
    """Phrases as lists of words, every occurrence counted."""
    grams = " UNION ALL ".join("SELECT lang, concat_ws(' ', " + ", ".join(f"ws[i + {j}]" for j in range(k)) + f") AS p FROM g WHERE i + {k - 1} <= len(ws)" for k in range(1, 5))
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS id, coalesce(lang, 'und') AS lang, {_LOWER} AS text FROM documents),
     e AS (SELECT lang, id, unnest(regexp_split_to_array(text, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM d),
     w AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM e),
     n AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM w GROUP BY lang),
     g AS MATERIALIZED (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
     v AS ({grams}),
     f AS MATERIALIZED (SELECT lang, string_split(p, ' ') AS p, a FROM (SELECT lang, p, count(*) AS a FROM v GROUP BY lang, p HAVING count(*) >= {least})),
     c AS (SELECT * FROM f WHERE len(p) >= 2),
     b AS (SELECT lang, p, max(a) AS cover FROM (SELECT lang, list_slice(p, i, i + k - 1) AS p, a FROM c, range(2, 4) r(k), range(1, 4) s(i) WHERE k < len(p) AND i + k - 1 <= len(p)) GROUP BY lang, p),
     o AS MATERIALIZED (SELECT c.* FROM c LEFT JOIN b ON b.lang = c.lang AND b.p = c.p WHERE b.cover IS NULL OR 100 * CAST(cover AS HUGEINT) < {share} * CAST(a AS HUGEINT)),
     x AS (SELECT o.lang, o.p, o.a, k, l.a AS l, r.a AS r, CAST(2000000 * CAST(o.a AS HUGEINT) // (CAST(l.a AS HUGEINT) + r.a) AS BIGINT) AS score
           FROM (SELECT *, list_slice(p, 1, k) AS p1, list_slice(p, k + 1, len(p)) AS p2 FROM (SELECT *, unnest(range(1, len(p))) AS k FROM o)) o
                JOIN f l ON l.lang = o.lang AND l.p = o.p1 JOIN f r ON r.lang = o.lang AND r.p = o.p2),
     y AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
     z AS (SELECT lang, array_to_string(p, ' ') AS phrase, a, l, r, score, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(p, ' ')) AS rank FROM y)
SELECT z.lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, n, score
FROM z JOIN n ON n.lang = z.lang WHERE rank <= {top}"""


ORACLES = {
    "op1_substring_dedup": removal(20),
    "op5_jaccard_join": COMPONENTS,
    "op6_decontaminate": CONTAMINATION,
    "op10_suffix_dedup": removal(50),
    "op12_prefix_trie": prefix_trie(),
    "op13_collocations": collocations(),
}
