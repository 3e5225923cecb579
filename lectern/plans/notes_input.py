"""Notes written from the documents by fixed templates, the same text in both engines.

Each document line becomes one line of a section of eight; header and closing sections carry
the variations (by ``doc_id``) that the parsers and rules are about.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from lectern.plans.inputs import DUCK, NEEDS
from lectern.plans.registry import Tables

NL = "chr(10)"


def rows(*parts: str) -> str:
    """Parts joined by line ends; a part may itself be an expression."""
    return f" || {NL} || ".join(parts)


def case(cond: str, yes: str, no: str) -> str:
    return f"(CASE WHEN {cond} THEN {yes} ELSE {no} END)"


TITLE1 = f"left(split_part(text, {NL}, 1), 16)"
C1 = "('概念' || CAST(doc_id % 5 AS STRING))"
C2 = "('Concept ' || CAST(doc_id % 7 AS STRING))"
C3 = "('词（' || lang || '）')"
K = "(doc_id % 8)"
SEC = "CAST(CAST(floor((line_no - 1) / 8) + 1 AS INT) AS STRING)"
R = "((line_no - 1) % 8)"
V = "((doc_id + line_no) % 9)"

LINE = f"""(CASE WHEN {R} = 0 THEN '## ' || {SEC} || '. ' || left(line, 16) || {NL} || line
    WHEN {R} = 2 THEN CASE {V} WHEN 0 THEN '- ' || line WHEN 1 THEN '**打个比方** ' || line WHEN 2 THEN '**打个比方：**' || line
         WHEN 3 THEN 'see [12:34] and （1:02:03） ' || line WHEN 4 THEN '**核心必考** ' || line
         WHEN 5 THEN '![cap ' || left(line, 5) || '](images/s' || {SEC} || '.png)' || ' images/b' || {SEC} || '.jpg'
         WHEN 6 THEN '概念' || CAST(doc_id % 5 AS STRING) || '（concept） ' || line WHEN 7 THEN '概念' || CAST(doc_id % 5 AS STRING) || line ELSE line END
    WHEN {R} = 3 AND {V} < 5 THEN line || {NL} || CASE {V} WHEN 0 THEN '```java' WHEN 1 THEN '```text' WHEN 2 THEN '```Python' WHEN 3 THEN '```mermaid' ELSE '```' END
    WHEN {R} = 4 AND {V} IN (1, 2, 3) THEN '// 来源 src [01:02]' || {NL} || line WHEN {R} = 4 AND {V} = 4 THEN '  subgraph g1[组]' || {NL} || line
    WHEN {R} = 5 AND {V} BETWEEN 2 AND 6 AND doc_id % 15 > 0 THEN '```' || {NL} || line
    WHEN {R} = 5 AND {V} = 8 THEN '- images/c' || {SEC} || '.gif' || {NL} || line
    WHEN {R} = 6 THEN CASE WHEN {V} < 5 THEN '' ELSE '---' END || {NL} || line
    WHEN {R} = 7 AND {V} % 2 = 0 THEN '> **记住这个就够了**：' || line
    WHEN {R} = 1 AND {K} = 5 AND {V} < 6 THEN '**核心思想：** ' || line
    ELSE line END)"""

_V4_HEAD = rows(
    case("doc_id % 11 = 0", f"'# Title' || {NL} || '> 核心主线：' || source", case("doc_id % 13 = 0", "'intro'", "'> 核心主线：' || source")),
    case("doc_id % 5 = 0", "'> 无'", "'> 课程来源：' || lang"), "''")
_V3_HEAD = rows(
    "'---'", case(f"{K} = 7 AND doc_id % 16 = 7", "'template_version: v2'", "'template_version: v3'"),
    case("doc_id % 16 = 13", "'note_type: short'", case("doc_id % 16 = 15", "'note_type: \"Essay\"'", "'note_type: lecture'")),
    case("doc_id % 3 = 0", "'platform: bilibili'", case("doc_id % 3 = 1", "'platform: youtube'", "'platform:'")),
    "'source: \"' || source || '\"'", case("doc_id % 7 = 0", "'# note'", "'created: 2026-10-04'"), "'duration: \"12:34\"'",
    case("doc_id % 4 = 1", "'bvid: BV' || CAST(doc_id AS STRING)", "'video_id: abcdefghijk'"), "'---'", "'## 目录'", "'- one'")
_V4O_HEAD = rows(
    "'---'", "'template_version: v4-obsidian'", case("doc_id % 5 = 0", "'title: a: b'", "'title: ' || source"),
    case("doc_id % 16 = 14", "'note_type: essay'", "'note_type: lecture'"),
    case("doc_id % 3 = 0", "'platform: bilibili'", "'platform: youtube'"),
    case("doc_id % 7 = 0", "'source: \"bad'", "'source: \"x y\"'"), "'duration: ''12:34'''",
    case("doc_id % 9 = 0", "'created: 2026-13-04'", "'created: 2026-10-04'"),
    case("doc_id % 4 = 2", "'bvid: BV1'", "'video_id: abcdefghijk'"),
    "'tags:'", case("doc_id % 10 = 0", "'- x'", "'  - t1'"), case("doc_id % 6 = 0", "'title: twice'", "'  - t2'"),
    "'---'", case("doc_id % 7 = 1", "'text first'", "'> 核心主线：' || source"), "'> 课程来源：' || lang", "''",
    "'## 目录'", f"'+ [[#1. ' || {TITLE1} || ']]'", case("doc_id % 4 = 0", "'+ [自测题](#自测题)'", "'+ [[#自测题]]'"))
HEAD = f"(CASE WHEN {K} < 5 THEN {_V4_HEAD} WHEN {K} = 6 THEN {_V4O_HEAD} ELSE {_V3_HEAD} END)"


def _total(k: int) -> str:
    return f"(((doc_id * 13 + {6 * k}) % 130) * 60 + ({51 * k} + doc_id) % 60 + {4 * k})"


def _stamp(k: int) -> str:
    m = f"CAST(floor({_total(k)} / 60) AS INT)"
    pad = f"CASE WHEN {_total(k)} < 600 THEN '0' ELSE '' END"
    return f"('[' || {pad} || CAST({m} AS STRING) || ':' || lpad(CAST({_total(k)} % 60 AS STRING), 2, '0') || ']')"


def _url(k: int) -> str:
    t = f"CAST({_total(k)} - {4 * k} AS STRING)"
    return f"""(CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN '(https://www.bilibili.com/video/BV' || CAST(doc_id AS STRING) || '?p=1&t=' || {t} || ')'
        WHEN 2 THEN '(https://www.bilibili.com/video/BV' || CAST(doc_id AS STRING) || '?p=1&t=7)'
        WHEN 3 THEN '(https://www.youtube.com/watch?v=abcdefghijk&t=' || {t} || 's)' ELSE '(https://example.com/a)' END)"""


def _entry(bullet: str, k: int, title: str) -> str:
    return f"'{bullet} ' || {_stamp(k)} || {_url(k)} || ' ' || {title}"


_SUMMARY = rows(
    "'## 本讲小结'", "'| 概念 | 问题 | 一句话 |'", "'|---|:-:|---|'", "'| a | b | c |'",
    case("doc_id % 3 = 0", "'![t](images/s1.png) ![t](images/s1.png)'", "'| d | e | f |'"), case("doc_id % 7 = 0", "''", "'**学完能说的 3 句话：**'"),
    "'1. x'", "'2. y'", case("doc_id % 4 = 0", "''", "'3. z'"))
_MAP = rows(
    "'## 本讲知识地图'", case("doc_id % 12 = 1", "'```text'", "'```mermaid'"), case("doc_id % 9 = 4", "'mindmap'", "'graph TD'"),
    "'  subgraph 分组'", f"'  A[' || {C1} || '] -->|依赖| B[' || {C2} || ']'",
    case("doc_id % 5 = 2", f"'  B -.-> C[' || {TITLE1} || ']'", f"'  B -- 推出 --> C[词' || lang || ']'"),
    case("doc_id % 4 = 3", "'  C ==> D[a very long label that is wide] --> E[(x)]'", "'  %% note'"), "'  end'", "'```'")
_CARDS4 = rows(
    "'## 概念卡片'", f"'### ' || {C1}", "'+ 定义：' || lang || ' def'",
    f"'+ 出现：第 1 节「' || {TITLE1} || '」、第 2 节「x」'", f"'+ 依赖：' || {C2} || '、未知'",
    case("doc_id % 3 = 0", "'+ 原文：concept'", "'+ 原文： '"),
    f"'### ' || {C2}", case("doc_id % 6 = 0", "'+ 定义：'", "'+ 定义: second'"),
    case("doc_id % 4 = 0", "'+ 出现：第 1 节「[01:02]」'", case("doc_id % 4 = 1", "'+ 出现：somewhere'", "'- 出现：第 40 节「y」'")),
    f"'+ 易混：' || {C3} || '——different'", "'```'", "'### hidden'", "'```'",
    case("doc_id % 7 = 0", "'### 甲（重点掌握）'", f"'### ' || {C3}"), "'+ 定义：third'", "'+ 定义：ignored'", case(f"{K} = 4 AND doc_id % 3 = 1", "'### 丁'", "''"))
_CARDS3 = rows(
    "'## 概念卡片'", f"'### ' || {C1}", "'- 定义：' || lang || ' def'", "'- 出现：1、2（x）'", f"'- 依赖：' || {C2} || '；未知'",
    f"'### ' || {C2}", case("doc_id % 6 = 0", "'- 定义：'", "'* 定义: second'"),
    case("doc_id % 4 = 1", "'- 出现：1 (01:02)'", case("doc_id % 4 = 3", "'- 出现：somewhere'", "'- 出现：40'")),
    f"'- 易混：' || {C1} || '--different'", case("doc_id % 7 = 0", "'### 甲（重点掌握）'", f"'### ' || {C3}"), "'- 定义：third'")
_LONG = "'**答案：** 结论是分布式计算把数据切开处理，原因是单机内存有限，例如把一万个文档分到八个任务里分别统计再合并。'"
_QUIZ4 = rows(
    "'## 自测题'", f"'1. 什么是 ' || {C1} || '？（对应：' || {C1} || '）'", _LONG,
    case("doc_id % 3 = 1", "'more [00:07] text'", "''"),
    f"'2、' || {C2} || '对吗？'", case("doc_id % 5 = 0", "'no answer'", "'**答案** 短 (00:05)'"),
    case("doc_id % 6 = 2", "'<details>'", "'---'"), "'3) 第三题（对应：别的）'", "'**答案：** x'",
    case("doc_id % 4 = 0", "'4. 第四题（对应: 甲）'", "'end'"), case("doc_id % 4 = 0", "'**答案：** yes'", "''"))
_QUIZ3 = rows(
    "'## 自测题'", f"'1. 什么是 ' || {C1} || '？（对应：' || {C1} || '）'", "'<details><summary>x</summary>'", "'**答案：** one'",
    case("doc_id % 3 = 1", "'more （0:07） text'", "''"), "'</details>'", "'after'",
    "'2. 是否可行？'", case("doc_id % 5 = 0", "'**答案：** outside'", "'<details>'"), case("doc_id % 2 = 0", "'**答案：** in'", "'nothing'"), "'</details>'",
    case("doc_id % 6 = 1", "''", "'3. third（对应：别的）'"), "'4. fourth'")
_INDEX4 = rows(
    "'## 视频时间索引'", _entry("+", 0, f"'1. ' || {TITLE1}"), _entry("-", 1, "'别的'"),
    case("doc_id % 6 = 4", "'<details open>'", _entry("+", 2, f"{C1}")), case("doc_id % 10 = 3", "'<!-- NAV:BEGIN x -->'", "''"),
    case("doc_id % 14 = 5", "'## 尾声'", "'+ no time'"))
_INDEX3 = rows(
    case("doc_id % 10 = 3", "''", "'<!-- NAV:BEGIN -->'"), "'## 视频时间索引'", _entry("-", 0, f"'1. ' || {TITLE1}"), _entry("*", 1, "'别的'"),
    _entry("+", 2, "'not an entry'"), "'<!-- NAV:END -->'")
_POINTS = rows(
    "'## 要点'", f"'+ ' || {TITLE1}", "'+ short'", "'+ 这一条足够长可以独立复述'", case("doc_id % 3 = 0", "'+ `code` and **bold**'", "'- other'"),
    "'## 空节'", "'### only'", "'---'")
FOOT = f"""(CASE WHEN {K} = 4 THEN {rows(_POINTS, _CARDS4, case('doc_id % 3 = 2', "''", _QUIZ4), case('doc_id % 3 = 1', "''", _INDEX4))}
    WHEN {K} IN (5, 7) THEN {rows(_MAP, _CARDS3, case('doc_id % 13 = 0', "''", _QUIZ3), case('doc_id % 9 = 0', "''", _INDEX3))}
    ELSE {rows(case('doc_id % 17 = 0', "''", _SUMMARY), case('doc_id % 19 = 0', "''", _MAP), _CARDS4, case('doc_id % 23 = 0', "''", _QUIZ4), case('doc_id % 9 = 0', "''", _INDEX4))} END)"""

META = f"""doc_id AS note_id, doc_id AS video_id,
    'notes/' || CASE WHEN doc_id % 9 = 4 THEN 'draft' ELSE CAST(doc_id AS STRING) || '-' || source END || '.md' AS path,
    CASE WHEN {K} = 5 AND doc_id % 3 = 2 THEN 'v4' END AS template,
    CASE {K} WHEN 3 THEN 'short' WHEN 4 THEN 'brief' WHEN 6 THEN CASE WHEN doc_id % 5 = 1 THEN 'short' END
         ELSE CASE WHEN doc_id % 40 = 16 THEN 'essay' END END AS note_type,
    CASE doc_id % 3 WHEN 0 THEN 'bilibili' WHEN 1 THEN 'youtube' ELSE '' END AS platform,
    CASE WHEN doc_id % 6 = 5 THEN '' WHEN doc_id % 3 = 1 THEN 'abcdefghijk' ELSE 'BV' || CAST(doc_id AS STRING) END AS vid,
    CASE WHEN doc_id % 4 = 1 THEN 'zh-CN' ELSE lang END AS source_lang,
    CAST(CASE WHEN doc_id % 8 = 2 THEN doc_id % 3 + 1 END AS INT) AS only_page"""


def notes(t: Tables) -> DataFrame:
    line = LINE.replace("line_no", "(li + 1)")
    body = f"array_join(transform(split(text, '\\n', -1), (line, li) -> {line}), {NL})"
    return t.documents.selectExpr(
        *[p for p in _split_select(META)], f"{HEAD} || {NL} || {body} || {NL} || {FOOT} AS text")


def _split_select(text: str) -> list[str]:
    """Top-level select items of a column list."""
    out, depth, cur = [], 0, ""
    for ch in text:
        depth += (ch == "(") - (ch == ")")
        if ch == "," and depth == 0:
            out.append(cur)
            cur = ""
        else:
            cur += ch
    return [*out, cur]


# The line template is computed first, in its own step, so that names do not clash.
DUCK["note_body"] = f"""
    SELECT doc_id AS body_id, string_agg({LINE}, chr(10) ORDER BY line_no) AS body FROM doc_lines GROUP BY doc_id"""
DUCK["notes"] = f"""
    SELECT {META}, {HEAD} || chr(10) || body || chr(10) || {FOOT} AS text
    FROM documents JOIN note_body ON body_id = doc_id"""
NEEDS["notes"] = ("doc_lines", "note_body")
