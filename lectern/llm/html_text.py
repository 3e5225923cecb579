"""Main text of web pages: markup where it tells, nearest-URL page differencing where it does not.

A page becomes lines: the texts of its blocks, each marked by where it stands. Lines in menus, footers, forms and the
like are left out. A class, id or role that names adverts, comments and the like leaves its element out too, unless
that holds a main element, most of the text in articles, or most of the page's text.

Every page is compared with its nearest one: of the pages of its host with other lines, the one whose path has the
longest common beginning, a neighbour in the order of paths. Both pages' lines are aligned by longest common
subsequence, and shared lines before the first and behind the last line of the page's own are deleted; a page that
shares all its lines is a copy and keeps them. Where lines stand in a main element, or in articles that hold most of the
text, the alignment decides only what markup leaves open: these lines stay, as passages that several articles share
belong to each of them, and of the lines between them the page's own ones.
"""

from __future__ import annotations

import html
import re
from os.path import commonprefix
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions.ordered import lag_row, running_sum, sorted_numbers
from lectern.llm.arrow import bounded_batches, importable, shared_folder, slices, text_buffer, with_columns

#: Elements whose content is no page text at all, up to their end tag.
RAW = frozenset("script style noscript template iframe svg math canvas object audio video head title textarea select".split())
#: Elements, and words of class, id and role, that hold no main text as a rule.
OUTSIDE = frozenset("nav header footer aside form button menu dialog fieldset".split())
OUTSIDE_NAMES = frozenset("""ad ads advert advertisement adverts adsense sponsored sponsor promo promotion banner cookie cookies
consent notice notices alert sidebar side menu nav navbar navigation breadcrumb breadcrumbs footer comment comments disqus
replies respond social share sharing related recommended newsletter subscribe subscription popup modal overlay widget
toolbar pagination pager masthead topbar login signup search complementary contentinfo skip""".split())
BLOCKS = frozenset("""address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption
figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol option p pre section summary table tbody td tfoot
th thead tr ul""".split())
#: Elements without an end tag, and elements that another one of them ends.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
ENDED_BY_NEXT = {"p": BLOCKS, "li": frozenset(("li",)), "dt": frozenset(("dt", "dd")), "dd": frozenset(("dt", "dd")),
                 "tr": frozenset(("tr",)), "td": frozenset(("td", "th", "tr")), "th": frozenset(("td", "th", "tr")),
                 "option": frozenset(("option",))}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_NAME = re.compile(r"/?[A-Za-z][^\s/>]*")
_ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PART = re.compile(r"[A-Z]?[a-z0-9]+|[A-Z]+")


def _tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, text or attributes) with kind text, start or end; linear, also over broken markup."""
    at, size, absent = 0, len(page), set()
    while at < size:
        opens = page.find("<", at)
        if opens < 0:
            yield "text", "", page[at:]
            return
        if opens > at:
            yield "text", "", page[at:opens]
        if page.startswith("<!--", opens):
            end = page.find("-->", opens + 4)
            at = size if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), opens):
            end = page.find(">", opens)
            at = size if end < 0 else end + 1
            continue
        name = _NAME.match(page, opens + 1)
        if name is None:
            yield "text", "", "<"
            at = opens + 1
            continue
        end = name.end()
        while end < size and page[end] != ">":
            if page[end] in "\"'" and page[end] not in absent:
                close = page.find(page[end], end + 1)
                if close < 0:
                    absent.add(page[end])
                    end += 1
                else:
                    end = close + 1
            else:
                step = _NEXT.search(page, end + 1)
                end = step.start() if step else size
        tag, inside = name.group().lower(), page[name.end():end]
        at = end + 1
        if tag[0] == "/":
            yield "end", tag[1:], ""
            continue
        yield "start", tag, inside
        if tag in RAW and not inside.endswith("/"):
            close = re.compile(f"</{tag}(?![A-Za-z0-9-])[^>]*>?", re.I).search(page, at)
            at = close.end() if close else size if tag in ("script", "style", "textarea", "title") else at


_NEXT = re.compile("[>\"']")


def _named(inside: str) -> tuple[bool, bool, str]:
    """Whether a class, id or role as a whole, or a part of one, names what is no main text; and what is named as main."""
    whole = part = False
    main = ""
    for found in _ATTRIBUTE.finditer(inside):
        kind, value = found[1].lower(), (found[2] or found[3] or found[4] or "").lower()
        if kind == "itemprop":
            main = main or ("article" if "articlebody" in value.split() else "")
            continue
        names = value.split()
        whole = whole or not OUTSIDE_NAMES.isdisjoint(names)
        part = part or not OUTSIDE_NAMES.isdisjoint(p.lower() for p in _PART.findall(found[2] or found[3] or found[4] or ""))
        if "main" in names:
            main = "main" if kind == "role" else main or "article"
    return whole, part, main


class _Outside:
    """An element that its names leave out, with what it holds: size of text, size of text in articles, a main element."""

    __slots__ = ("whole", "above", "text", "marked", "main")

    def __init__(self, whole: bool, above: "_Outside | None"):
        self.whole, self.above, self.text, self.marked, self.main = whole, above, 0, 0, False


def page_lines(page: str | None) -> tuple[list[str], list[bool]]:
    """Lines that may be main text, in page order, and whether each stands in what markup tells to be the main text."""
    #: lines of pieces: text, innermost named element around it, 2 in a main element, 1 in an article, else 0
    lines: list[list[tuple[str, _Outside | None, int]]] = []
    words: list[tuple[str, _Outside | None, int]] = []
    named: list[_Outside] = []
    #: open elements: name, whether left out, named element or None, main or article or neither; and how many are open
    stack: list[tuple[str, bool, _Outside | None, str]] = []
    open_, outs, mains, articles = Counter(), 0, 0, 0
    inner: _Outside | None = None

    def flush() -> None:
        nonlocal words
        if words:
            lines.append(words)
            words = []

    def pop(to: int) -> None:
        nonlocal outs, mains, articles, inner
        while len(stack) > to:
            name, out, mark, main = stack.pop()
            open_[name] -= 1
            outs, mains, articles = outs - out, mains - (main == "main"), articles - (main == "article")
            if mark is not None:
                inner = mark.above
                if inner is not None:
                    inner.text, inner.marked, inner.main = inner.text + mark.text, inner.marked + mark.marked, inner.main or mark.main

    for kind, name, inside in _tokens(page or ""):
        if kind == "text":
            if not outs:
                text = html.unescape(inside)
                words.append((text, inner, 2 if mains else 1 if articles else 0))
                if inner is not None:
                    size = len(text.strip())
                    inner.text += size
                    inner.marked += size if mains or articles else 0
            continue
        if name in BLOCKS:
            flush()
        if kind == "end":
            for i in range(len(stack) - 1, -1, -1) if open_[name] else ():
                if stack[i][0] == name:
                    pop(i)
                    break
                if stack[i][0] in ("article", "main", "body") and name not in ("body", "html"):
                    break  # a stray end tag does not end what it stands in
            continue
        if name in VOID or name in RAW or inside.endswith("/"):
            continue
        for i in range(len(stack) - 1, max(-1, len(stack) - 12), -1):
            if name in ENDED_BY_NEXT.get(stack[i][0], ()):
                pop(i)
                break
            if stack[i][0] in BLOCKS:
                break
        whole, part, main = _named(inside) if "=" in inside else (False, False, "")
        main = name if name in ("article", "main") else main
        out = name in OUTSIDE and not (name == "header" and (mains or articles))
        mark = None
        if not outs and not out:
            # topics and tags of an article stand in its class: only a whole name tells that it is a comment or advert
            if name not in ("body", "html", "main") and (whole or part and name != "article"):
                mark = inner = _Outside(whole, inner)
                named.append(mark)
            elif main == "main" and inner is not None:
                inner.main = True
        stack.append((name, out, mark, "" if out else main))
        open_[name] += 1
        outs, mains, articles = outs + out, mains + (not out and main == "main"), articles + (not out and main == "article")
    flush()
    pop(0)
    return _chosen(lines, named)


def _chosen(lines: list[list[tuple[str, _Outside | None, int]]], named: list[_Outside]) -> tuple[list[str], list[bool]]:
    size = marked = 0
    for line in lines if named else ():
        for text, _, where in line:
            size, marked = size + len(text.strip()), marked + (len(text.strip()) if where else 0)

    def left(large: bool) -> tuple[list[str], list[int]]:
        """Lines outside of named elements; those with most of the text are let in, whole names only if `large`."""
        gone: dict[int, bool] = {}
        for n in named:  # outer ones come first
            most = 2 * n.text >= size or 2 * n.marked >= marked > 0
            gone[id(n)] = not (n.main or most and (large or not n.whole)) or n.above is not None and gone[id(n.above)]
        found, where = [], []
        for line in lines:
            kept = [p for p in line if p[1] is None or not gone[id(p[1])]]
            if text := " ".join("".join(p[0] for p in kept).split()):
                found.append(text)
                where.append(max(p[2] for p in kept if p[0].strip()))
        return found, where

    found, where = left(False)
    if 2 in where:
        return found, [w > 0 for w in where]
    if 2 * sum(len(t) for t, w in zip(found, where) if w) >= sum(map(len, found)) > 0:
        return found, [w > 0 for w in where]
    if named:
        found, where = left(True)
    return found, [False] * len(found)


def shared_lines(own: list[int], other: list[int]) -> list[bool]:
    """Own lines that are in a longest common subsequence of both pages (Hunt and Szymanski)."""
    places: dict[int, list[int]] = {}
    for j, line in enumerate(other):
        places.setdefault(line, []).append(j)
    ends: list[int] = []
    links: list[tuple] = []
    for i, line in enumerate(own):
        for j in reversed(places.get(line, ())):
            k = bisect_left(ends, j)
            link = (i, links[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                links.append(link)
            else:
                ends[k], links[k] = j, link
    out, link = [False] * len(own), links[-1] if links else None
    while link:
        out[link[0]], link = True, link[1]
    return out


def own_lines(lines: list[str], hashes: list[int], other: list[int] | None) -> list[str]:
    shared = shared_lines(hashes, other) if other else []
    if not shared or all(shared):
        return lines
    first, last = shared.index(False), len(shared) - 1 - shared[::-1].index(False)
    return lines[first:last + 1]


def main_lines(lines: list[str], sure: list[bool], hashes: list[int], other: list[int] | None) -> list[str]:
    """Lines of the main text, given the lines of the nearest page."""
    if not any(sure):
        return own_lines(lines, hashes, other)
    shared = shared_lines(hashes, other) if other else [True] * len(lines)
    first, last = sure.index(True), len(sure) - 1 - sure[::-1].index(True)
    return [t for i, (t, s) in enumerate(zip(lines, sure)) if s or first < i < last and not shared[i]]


_PARSED = T.StructType([T.StructField("lines", T.ArrayType(T.StringType())), T.StructField("sure", T.ArrayType(T.BooleanType())),
                        T.StructField("hashes", T.ArrayType(T.LongType()))])


def _parse(pages: pa.Array) -> list[pa.Array]:
    lines, sure, hashes = [], [], []
    for page in pages.to_pylist():
        found, where = page_lines(page)
        lines.append(found)
        sure.append(where)
        hashes.append([xxhash.xxh64_intdigest(t.encode()) - 2**63 for t in found])
    return [pa.array(lines, pa.list_(pa.string())), pa.array(sure, pa.list_(pa.bool_())), pa.array(hashes, pa.list_(pa.int64()))]


def _finish(batches) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [" ".join(main_lines(*r.values())) for r in batch.select(["lines", "sure", "hashes", "other"]).to_pylist()]
        yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(2)], pa.array(texts, pa.string())],
                                         names=["page", "url", "text"])


#: Neighbouring paths of a host that one task looks through.
NEIGHBOURS = 4096


def _nearer(path: pa.Array, before: pa.Array, after: pa.Array) -> list[pa.Array]:
    """Whether the path after has a longer common beginning with the path than the one before it."""
    def size(a, b):
        return -1 if b is None else len(commonprefix((a, b)))

    return [pa.array([size(p, a) > size(p, b) for p, b, a in zip(path.to_pylist(), before.to_pylist(), after.to_pylist())], pa.bool_())]


def nearest_pages(pages: DataFrame) -> DataFrame:
    """(host, path, sign, other) for pages (host, path, sign, hashes), other being the lines of the nearest page.

    That is the page of the host with another sign whose path has the longest common beginning. In the order of paths
    it stands next to the run of pages of one sign that a page is in; of equal ones the earlier is taken. Pages without
    another one on their host are left out.
    """
    held = pages.groupBy("host", "path", "sign").agg(F.first("hashes").alias("hashes")).checkpoint()
    order = F.struct("path", "sign")
    numbered = sorted_numbers(held.select("host", "path", "sign", order.alias("o")), "host", "o", "no")
    told = lag_row(numbered, ["host"], "no", {"last": "sign"}, NEIGHBOURS).withColumn(
        "opens", F.coalesce(F.col("last") != F.col("sign"), F.lit(True)).cast("long"))
    placed = running_sum(told, ["host"], "no", {"run": F.col("opens")}, NEIGHBOURS).select("host", "path", "sign", "no", "run").checkpoint()
    runs = placed.groupBy("host", "run").agg(F.min_by(order, "no").alias("head"), F.max_by(order, "no").alias("tail"))
    before = runs.select("host", (F.col("run") + 1).alias("run"), F.col("tail").alias("before"))
    after = runs.select("host", (F.col("run") - 1).alias("run"), F.col("head").alias("after"))
    beside = (placed.join(before, ["host", "run"], "left").join(after, ["host", "run"], "left").where("before is not null or after is not null")
              .select("host", "path", "sign", "before", "after", F.col("before.path").alias("low"), F.col("after.path").alias("high")))
    near = with_columns(beside, ["path", "low", "high"], T.StructType([T.StructField("later", T.BooleanType())]), _nearer)
    one = F.when(F.col("later"), F.col("after")).otherwise(F.col("before"))
    near = near.select("host", "path", "sign", one["path"].alias("near_path"), one["sign"].alias("near_sign"))
    others = held.select("host", F.col("path").alias("near_path"), F.col("sign").alias("near_sign"), F.col("hashes").alias("other"))
    return near.join(others, ["host", "near_path", "near_sign"]).select("host", "path", "sign", "other")


def main_text(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """One row per page: key, url, text (empty if there is none).

    Null pages are empty. A null URL is a host of its own. Rows repeated in all of key, URL and page get one text each.
    """
    shared_folder(pages.sparkSession)
    own = bounded_batches(importable(pages), 500).select(F.col(key).alias("page"), F.col(url).alias("url"), F.col(page).alias("html"))
    fields = list(own.schema.fields[:2]) + list(_PARSED.fields)

    def parse(batches):
        for batch in batches:
            column = batch.column(2)
            for a, b in slices(np.diff(text_buffer(column)[1])):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), *_parse(column.slice(a, b - a))],
                    names=["page", "url", "lines", "sure", "hashes"])

    address = F.coalesce(F.col("url"), F.lit(""))
    path = F.regexp_replace(F.regexp_replace(address, r"[?#].*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    parsed = own.mapInArrow(parse, T.StructType(fields)).select(
        "*", F.lower(F.substring_index(path, "/", 1)).alias("host"), path.alias("path"), F.xxhash64("hashes").alias("sign"))
    near = nearest_pages(parsed.select("host", "path", "sign", "hashes"))
    matched = parsed.join(near, ["host", "path", "sign"], "left").select("page", "url", "lines", "sure", "hashes", "other")
    texts = matched.mapInArrow(_finish, T.StructType(list(own.schema.fields[:2]) + [T.StructField("text", T.StringType())]))
    return texts.select(F.col("page").alias(key), F.col("url").alias(url), "text")
