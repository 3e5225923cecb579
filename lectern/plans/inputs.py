"""How the driver tables play the roles of the product's data model.

``COMMON`` holds SQL that both engines run unchanged (``{table}`` marks a table); inputs
that need arrays have one Spark form and one SQL form for the check.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lectern.plans.registry import Tables

COMMON = {
    # Conversations read as transcripts: one turn is one line, nine seconds apart.
    "transcript_lines": """
        SELECT conv_id AS video_id, CAST(conv_id % 3 + 1 AS INT) AS page,
               CAST(turn AS INT) AS line_no, CAST(turn * 9 + conv_id % 7 AS INT) AS ts_sec, text
        FROM {conversations}""",
    # Caption tracks of a video, eight parts per video.
    "caption_tracks": """
        SELECT CAST(floor(p_partkey / 8) AS BIGINT) AS video_id, CAST(p_partkey % 8 AS INT) AS ord,
               CASE p_size % 9 WHEN 0 THEN 'zh-Hans' WHEN 1 THEN 'zh-TW' WHEN 2 THEN 'en'
                    WHEN 3 THEN 'en-AU' WHEN 4 THEN 'ja' WHEN 5 THEN 'fr' WHEN 6 THEN 'zh-SG'
                    WHEN 7 THEN 'de' ELSE 'es-419' END AS lang,
               p_type IN ('ECONOMY', 'PROMO') AS is_auto
        FROM {part}""",
    # Player probes: one row per attempt and track; order lines repeat (video, attempt).
    "probe_tracks": """
        SELECT l_orderkey AS video_id, l_linenumber AS attempt, l_returnflag <> 'R' AS ok,
               l_partkey AS ord,
               CASE WHEN l_partkey % 5 = 0 THEN NULL
                    WHEN l_partkey % 5 = 1 THEN 'ai-zh' WHEN l_partkey % 5 = 2 THEN 'zh-CN'
                    WHEN l_partkey % 5 = 3 THEN 'en' ELSE 'ai-en' END AS lan,
               CASE WHEN l_partkey % 11 = 0 THEN 1 ELSE 0 END AS ai_type,
               l_suppkey % 3 <> 0 AS has_url
        FROM {lineitem}""",
    "video_titles": """
        SELECT doc_id AS video_id, n_chars,
               CASE doc_id % 4 WHEN 0 THEN '第一讲 绪论' WHEN 1 THEN 'Spark SQL 入门'
                    WHEN 2 THEN 'The tion 课' ELSE substring(text, 1, 12) END AS title, text
        FROM {documents}""",
    "video_pages": """
        SELECT CAST(floor(doc_id / 4) AS BIGINT) AS video_id, CAST(doc_id % 4 + 1 AS INT) AS page,
               source AS part, lang, text, n_chars,
               CASE doc_id % 4 WHEN 0 THEN lang WHEN 1 THEN '  ' ELSE NULL END AS asr_lang,
               CASE WHEN doc_id % 3 = 0 THEN 'zh-CN' WHEN doc_id % 3 = 1 THEN '' ELSE NULL END AS audio_lang,
               CASE WHEN doc_id % 5 = 0 THEN NULL ELSE ' ' || lang || ' ' END AS subtitle_lang
        FROM {documents}""",
    "video_durations": """
        SELECT o_custkey AS video_id, CAST(row_no AS INT) AS page,
               CAST(floor(o_totalprice / 1000) AS BIGINT) AS duration
        FROM (SELECT o_custkey, o_orderkey AS row_no, o_totalprice FROM {orders}) o""",
    "backend_runs": """
        SELECT event_id AS run_id, event_type AS model_used,
               CASE WHEN user_id % 3 = 0 THEN 'cuda' ELSE 'cpu' END AS device_used,
               user_id % 2 = 0 AS batched, value AS elapsed_seconds,
               CASE WHEN event_type = 'error' THEN 'error' ELSE 'ok' END AS status,
               CASE WHEN user_id % 5 = 0 THEN 'cuda load failed' WHEN user_id % 7 = 0 THEN 'model too big' END
                   AS fallback_reason
        FROM {events}""",
    "transcriber_runs": """
        SELECT conv_id AS file_id, CAST(turn AS INT) AS run_no,
               CASE turn % 2 WHEN 0 THEN 'small' ELSE 'base' END AS model, CAST(turn % 4 + 1 AS INT) AS threads,
               CAST(8 AS INT) AS batch, CAST(conv_id % 5 AS INT) * 60.0 AS duration_s,
               length(text) / 10.0 AS asr_s, text
        FROM {conversations}""",
}


def frame(t: Tables, name: str) -> DataFrame:
    """A ``COMMON`` input as a Spark DataFrame."""
    return t.sql(COMMON[name])


def doc_lines(t: Tables) -> DataFrame:
    return t.documents.select(
        "doc_id", "lang", "source", F.posexplode(F.split("text", "\n", -1)).alias("_i", "line")
    ).select("doc_id", "lang", "source", (F.col("_i") + 1).alias("line_no"), "line")


def stamped_docs(t: Tables) -> DataFrame:
    """Documents as transcript texts: most lines open with a time mark."""
    m = "(doc_id * 13 + i * 2) % 130"
    mark = (
        f"concat('[', CASE WHEN {m} < 10 THEN '0' ELSE '' END, cast({m} AS STRING), ':', "
        "lpad(cast((i * 17 + doc_id) % 60 AS STRING), 2, '0'), ']')"
    )
    return t.documents.select(
        F.col("doc_id").alias("video_id"),
        F.expr("CAST(doc_id % 3 + 1 AS INT)").alias("page"),
        "lang", "source",
        F.expr(
            f"array_join(transform(split(text, '\\n', -1), (l, i) -> CASE WHEN i % 5 = 4 THEN l "
            f"WHEN i % 7 = 6 THEN concat(l, ' ', {mark}, ' tail') ELSE concat({mark}, ' ', l) END), '\\n')"
        ).alias("text"),
    )


def rolling_captions(t: Tables) -> DataFrame:
    """Automatic captions: each line is shown growing, then repeated."""
    return doc_lines(t).select(
        F.col("doc_id").alias("video_id"), "line_no", "line",
        F.posexplode(F.array(*map(F.lit, (1, 2, 2, 4)))).alias("k", "q"),
    ).select(
        "video_id",
        ((F.col("line_no") - 1) * 4 + F.col("k")).cast("int").alias("ord"),
        ((F.col("line_no") * 3.0) + F.col("k") * 0.5).alias("start"),
        F.expr("substring(line, 1, cast(floor(length(line) * q / 4.0) AS INT))").alias("text"),
    )


_M = "((doc_id * 13 + (line_no - 1) * 2) % 130)"
_MARK = (
    f"('[' || CASE WHEN {_M} < 10 THEN '0' ELSE '' END || CAST({_M} AS VARCHAR) || ':' || "
    "lpad(CAST(((line_no - 1) * 17 + doc_id) % 60 AS VARCHAR), 2, '0') || ']')"
)
DUCK = {
    "doc_lines": """
        SELECT doc_id, lang, source, CAST(generate_subscripts(string_split(text, chr(10)), 1) AS INT) AS line_no,
               unnest(string_split(text, chr(10))) AS line
        FROM documents""",
    "stamped_lines": f"""
        SELECT doc_id AS video_id, CAST(doc_id % 3 + 1 AS INT) AS page, line_no, lang, source,
               CASE WHEN (line_no - 1) % 5 = 4 THEN line
                    WHEN (line_no - 1) % 7 = 6 THEN line || ' ' || {_MARK} || ' tail'
                    ELSE {_MARK} || ' ' || line END AS line
        FROM doc_lines""",
    "stamped_docs": """
        SELECT video_id, page, lang, source, string_agg(line, chr(10) ORDER BY line_no) AS text
        FROM stamped_lines GROUP BY ALL""",
    "rolling_captions": """
        SELECT doc_id AS video_id, CAST((line_no - 1) * 4 + k AS INT) AS ord,
               line_no * 3.0::DOUBLE + k * 0.5::DOUBLE AS start,
               substring(line, 1, CAST(floor(length(line) * q / 4.0) AS INT)) AS text
        FROM doc_lines, (VALUES (0, 1), (1, 2), (2, 2), (3, 4)) w(k, q)""",
}
NEEDS = {
    "stamped_lines": ("doc_lines",), "stamped_docs": ("doc_lines", "stamped_lines"),
    "rolling_captions": ("doc_lines",),
}


def with_inputs(*names: str, recursive: bool = False) -> str:
    """``WITH`` clause that defines the named inputs for the SQL check."""
    order: list[str] = []
    for name in names:
        for n in (*NEEDS.get(name, ()), name):
            if n not in order:
                order.append(n)
    parts = []
    for n in order:
        body = DUCK[n] if n in DUCK else COMMON[n].replace("{", "").replace("}", "")
        parts.append(f"{n} AS ({body})")
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(parts)
