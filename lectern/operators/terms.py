"""Dictionary-driven term correction with an auditable hit report.

Glossary rows are ``(layer, area, category, wrong, correct, hits, source, disabled, ord)``:
``area`` is ``categories`` (official) or ``candidates``; ``ord`` is the load order.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from lectern.functions import text as tx
from lectern.functions.matches import HEAD, pattern_matches, replace_matches, word_filter, word_places

OFFICIAL, CANDIDATE = "categories", "candidates"
# Largest dictionary compiled into one expression; larger ones are matched by a join.
MAX_INLINE_KEYS = 2000
KEY_COLUMNS = ("layer", "area", "category", "wrong")
_HIT = ("ts", "wrong", "right", "category", "candidate", "context")

# Words that file a migrated entry under the programming category.
TECH_WORDS = (
    "@component", "component", "starter", "spring", "bean", "java", "netty",
    "war包", "slf4j", "log4j", "facade", "aware", "actuator", "metric",
    "beanfactory", "applicationcontext", "clone", "go语言", "golang", "warn",
    "println", "gpt", "gemini", "codex", "openai", "reactive",
    "python", "json", "sql", "docker", "k8s", "linux", "maven", "gradle",
    "redis", "mysql", "http", "jvm", "api", "sdk",
    "软件工程", "编程", "注解", "编译", "部署", "框架", "算法", "数据库",
    "缓存", "代码", "程序",
)
TECH_CATEGORY, GENERAL_CATEGORY = "编程", "通用"


def fold(c: Column) -> Column:
    """The form in which texts and dictionary words are compared: lower case, character by character.

    Plain lower-casing depends on the neighbours of a capital sigma and makes two characters of one
    letter only (dotted capital I); both are replaced first, so that the length never changes and a
    character is folded alike in every place, text and dictionary.
    """
    return F.lower(F.translate(c, "Σςİ", "σσi"))


def main_word(correct: Column) -> Column:
    """The word before a bracketed explanation."""
    return tx.strip(F.regexp_extract(correct, r"^[^（(]*", 0))


def migrate_glossary(flat: DataFrame) -> DataFrame:
    """Flat ``(wrong, correct, ord)`` rows to categorised official entries."""
    blob = F.lower(F.concat_ws(" ", "wrong", "correct"))
    tech = F.exists(F.array(*map(F.lit, TECH_WORDS)), lambda w: F.contains(blob, w))
    rows = flat.filter(~tx.is_blank(F.col("wrong")) & F.col("correct").isNotNull())
    category = F.when(tech, TECH_CATEGORY).otherwise(GENERAL_CATEGORY)
    # A repeated key keeps its last value, as a map read from a file does.
    return rows.groupBy("wrong").agg(F.max_by("correct", "ord").alias("correct")).select(
        "wrong", "correct", category.alias("category")
    )


def merge_glossary_layers(glossary: DataFrame) -> DataFrame:
    """The row of the highest layer (then latest load) per area, category and key."""
    rest = ("layer", "correct", "hits", "source", "disabled")
    best = glossary.groupBy("area", "category", "wrong").agg(
        F.max_by(F.struct(*rest), F.struct("layer", "ord")).alias("e")
    )
    return best.select("area", "category", "wrong", "e.*")


def active_entries(
    glossary: DataFrame, categories: Sequence[str] | None = None, topic: str | None = None,
) -> DataFrame:
    """Entries that take part in a scan, one per area and folded key.

    ``categories`` narrows both areas, ``topic`` only the candidates. The later layer or
    load wins; ``first_ord`` keeps where the key appeared first.
    """
    rows = glossary.filter(~F.col("disabled")).withColumn("right", main_word(F.col("correct")))
    rows = rows.filter(F.col("right") != "")
    if categories is not None:
        rows = rows.filter(F.col("category").isin(*categories))
    if topic is not None:
        rows = rows.filter((F.col("area") == OFFICIAL) | (F.col("category") == topic))
    load = F.struct("layer", "ord")
    best = rows.groupBy("area", fold(F.col("wrong")).alias("key")).agg(
        F.max_by(F.struct("wrong", "right", "category", "layer", "hits"), load).alias("e"),
        F.min(load).alias("first_ord"),
    )
    return best.select("area", "key", "e.*", "first_ord")


def scan_keys(active: DataFrame) -> DataFrame:
    """One row per key to look for; an official entry hides a candidate with the same key."""
    pick = F.min_by(F.struct("right", "category", "area"), F.when(F.col("area") == OFFICIAL, 0).otherwise(1))
    return active.groupBy("key").agg(pick.alias("e")).select(
        "key", "e.right", "e.category", (F.col("e.area") == CANDIDATE).alias("candidate")
    )


def _check_keys(keys: DataFrame) -> None:
    """Words must stand in one line: matches are looked for within lines."""
    bad = [r["key"] for r in keys.filter(F.contains("key", F.lit("\n"))).limit(3).collect()]
    if bad:
        raise ValueError(f"dictionary words must not hold line breaks: {bad}")


def _trie_regex(keys: Sequence[str]) -> str:
    """One pattern for folded texts that matches the longest key at each position, shared prefixes once."""
    root: dict = {}
    for key in keys:
        node = root
        for ch in key:
            node = node.setdefault(ch, {})
        node[""] = {}

    def render(node: dict) -> str:
        branches = [re.escape(ch) + render(child) for ch, child in node.items() if ch]
        if not branches:
            return ""
        body = branches[0] if len(branches) == 1 and "" not in node else "(?:" + "|".join(branches) + ")"
        return body + ("?" if "" in node else "")

    return render(root)


class Dictionary:
    """Scan keys as a pattern, for dictionaries of a checked size.

    ``load`` reads at most ``MAX_INLINE_KEYS + 1`` rows and returns None beyond the bound;
    callers then match by joins, with the same hits and errors.
    """

    def __init__(self, rows: Sequence) -> None:
        self.rows = list(rows)
        self.pattern = _trie_regex([r["key"] for r in self.rows]) if self.rows else None

    @classmethod
    def load(cls, keys: DataFrame) -> "Dictionary | None":
        rows = keys.limit(MAX_INLINE_KEYS + 1).collect()
        return cls(rows) if len(rows) <= MAX_INLINE_KEYS else None

    def table(self, keys: DataFrame) -> DataFrame:
        """The loaded rows, of which there are few enough to send to every task."""
        return F.broadcast(keys.sparkSession.createDataFrame(self.rows, keys.schema))

    def right(self) -> dict[str, str]:
        """Official replacements by folded word."""
        return {r["key"]: r["right"] for r in self.rows if not r["candidate"]}


def _folded(docs: DataFrame, key: str) -> DataFrame:
    return docs.select(key, "text", fold(F.col("text")).alias("_low"))


def _units(docs: DataFrame, key: str) -> DataFrame:
    """Texts cut before each time mark and after each line end."""
    pieces = F.split("text", r"(?=\[\d{1,2}:\d{2}\])|(?<=\n)", -1)
    return docs.select(key, F.posexplode(F.filter(pieces, lambda p: p != "")).alias("unit_no", "unit"))


def _joined_matches(docs: DataFrame, keys: DataFrame, key: str, around: bool) -> DataFrame:
    """Leftmost-longest matches per unit for dictionaries of any size, as a join.

    Inside the row, places and lengths that a filter of the dictionary lets through open grams; the
    equi-join leaves true matches, and a fold per unit (a piece of one line) keeps the longest per
    place and drops overlaps. Only grams with their context are shuffled, never texts.
    """
    shown = ("ts", "wrong", "context") if around else ()
    # A dictionary has few distinct key lengths; they are the only thing read to the driver.
    sizes = sorted(r["n"] for r in keys.select(F.length("key").alias("n")).distinct().collect())
    if not sizes:
        return docs.limit(0).select(key, F.lit(0).alias("unit_no"), F.expr(f"cast(array() AS array<struct<pos: int, n: int, key: string{''.join(f', {c}: string' for c in shown)}>>)").alias("hits"))
    head = min(min(sizes), HEAD)
    opened = word_places(_folded(docs, key), sizes, head, word_filter(keys, head), around).select(
        key, "unit_no", F.struct("pos", "n", "key", *shown).alias("h"))
    found = opened.join(keys.select(F.col("key").alias("_k")), F.col("h.key") == F.col("_k"), "left_semi")
    per_unit = found.groupBy(key, "unit_no").agg(F.sort_array(F.collect_list("h")).alias("c"))
    kept = F.expr("""aggregate(c, slice(c, 1, 0), (s, x) -> CASE
        WHEN size(s) > 0 AND x.pos = element_at(s, -1).pos THEN array_append(slice(s, 1, size(s) - 1), x)
        WHEN x.pos >= coalesce(try_element_at(s, -1).pos + try_element_at(s, -1).n, 1) THEN array_append(s, x) ELSE s END)""")
    return per_unit.select(key, "unit_no", kept.alias("hits"))


def scan_terms(docs: DataFrame, keys: DataFrame, key: str = "doc_id", inline: bool | None = None) -> DataFrame:
    """All dictionary hits of ``(key, text)`` in one left-to-right pass, longest key first.

    Result ``(key, unit_no, hit_no, ts, wrong, right, category, candidate, context)``, where
    ``ts`` is the nearest time mark to the left. ``inline=False`` forces the join form.
    """
    _check_keys(keys)
    small = Dictionary.load(keys) if inline is not False else None
    if small is None:
        hits, table = _joined_matches(docs, keys, key, around=True), keys
        rows = hits.select(key, "unit_no", F.posexplode("hits").alias("_i", "h")).select(
            key, "unit_no", (F.col("_i") + 1).alias("hit_no"), "h.ts", "h.wrong", "h.context", F.col("h.key").alias("_key"))
    elif small.pattern is None:  # an empty dictionary has no hits
        return docs.limit(0).join(keys, F.lit(False)).select(
            key, F.lit(0).alias("unit_no"), F.lit(0).alias("hit_no"), F.col("text").alias("ts"), F.col("text").alias("wrong"), "right", "category",
            "candidate", F.col("text").alias("context"))
    else:
        rows, table = pattern_matches(_folded(docs, key), small.pattern), small.table(keys)
    return rows.join(table.withColumnRenamed("key", "_key"), "_key").select(key, "unit_no", "hit_no", *_HIT)


def apply_terms(docs: DataFrame, keys: DataFrame, key: str = "doc_id", inline: bool | None = None) -> DataFrame:
    """Texts with official hits replaced; candidates stay, new text is not matched again."""
    _check_keys(keys)
    small = Dictionary.load(keys) if inline is not False else None
    weave = """aggregate({hits}, named_struct('at', 1, 'out', cast(array() AS array<string>)), (s, x) ->
        named_struct('at', x.pos + x.n, 'out', concat(s.out, array(substring({text}, s.at, x.pos - s.at), x.right))),
        s -> concat(array_join(s.out, ''), substring({text}, s.at, length({text}))))"""
    if small is not None:
        if small.pattern is None:
            return docs.select(key, "text")
        return replace_matches(_folded(docs, key), small.pattern, small.right())
    units = _units(docs, key)
    hits = _joined_matches(docs, keys, key, around=False).select(key, "unit_no", F.explode("hits").alias("h"))
    words = hits.select(key, "unit_no", "h.pos", "h.n", F.col("h.key").alias("_k")).join(
        keys.filter("NOT candidate").select(F.col("key").alias("_k"), "right"), "_k")
    per_unit = words.groupBy(key, "unit_no").agg(
        F.sort_array(F.collect_list(F.struct("pos", "n", "right"))).alias("h")
    )
    # only units with hits are rewritten, the others stay as they are in their text
    fixed = units.join(per_unit, [key, "unit_no"], "left").select(
        key, "unit_no", F.when(F.col("h").isNull(), F.col("unit")).otherwise(F.expr(weave.format(hits="coalesce(h, array())", text="unit"))).alias("unit"))
    text = fixed.groupBy(key).agg(F.expr("listagg(unit, '') WITHIN GROUP (ORDER BY unit_no)").alias("text"))
    return docs.select(key).join(text, key, "left").select(key, F.coalesce("text", F.lit("")).alias("text"))


def summarize_hits(hits: DataFrame, applied: bool, key: str = "doc_id") -> DataFrame:
    """Counts per document and category, per document, per category, and in total."""
    # Two steps: partial counts first, so a hot document or word is reduced before the sets.
    counts = hits.groupBy(key, "category").agg(
        F.count_if(~F.col("candidate")).alias("h"), F.count_if("candidate").alias("c")
    )
    grouped = counts.groupingSets(
        [[F.col(key), F.col("category")], [F.col(key)], [F.col("category")], []], F.col(key), F.col("category")
    ).agg(F.sum("h").alias("hits"), F.sum("c").alias("candidate_hits"))
    return grouped.withColumn("replaced", F.col("hits") if applied else F.lit(0).cast("bigint"))


def accumulate_hits(glossary: DataFrame, hits: DataFrame, active: DataFrame) -> DataFrame:
    """New glossary version: each distinct replaced key of the run counts one hit."""
    used = hits.filter("NOT candidate").select(fold(F.col("wrong")).alias("key")).distinct()
    owner = active.filter(F.col("area") == OFFICIAL).join(used, "key").select(*KEY_COLUMNS, F.lit(1).alias("_hit"))
    rows = glossary.join(owner, list(KEY_COLUMNS), "left")
    return rows.withColumn("hits", F.col("hits") + F.coalesce("_hit", F.lit(0))).drop("_hit")


def upsert_terms(glossary: DataFrame, additions: DataFrame, day: str) -> DataFrame:
    """New glossary version with additions ``(layer, category, wrong, correct, candidate, ord)``.

    An existing entry keeps its hits; an official addition removes the candidate of the same
    layer, category and key.
    """
    area = F.when(F.col("candidate"), CANDIDATE).otherwise(OFFICIAL)
    cut = additions.withColumn("area", area).filter(~tx.is_blank(F.col("wrong")) & ~tx.is_blank(F.col("correct")))
    cut = cut.withColumn("wrong", tx.strip(F.col("wrong"))).withColumn("correct", tx.strip(F.col("correct")))
    new = cut.groupBy(*KEY_COLUMNS).agg(F.max_by("correct", "ord").alias("_new"), F.max("ord").alias("_ord"))
    rows = glossary.join(new, list(KEY_COLUMNS), "full")
    added = F.col("_new").isNotNull()
    out = rows.select(
        *KEY_COLUMNS,
        F.coalesce("_new", "correct").alias("correct"),
        F.coalesce("hits", F.lit(0)).alias("hits"),
        F.when(added, F.lit(f"manual:{day}")).otherwise(F.col("source")).alias("source"),
        F.when(added, F.lit(False)).otherwise(F.col("disabled")).alias("disabled"),
        F.coalesce("ord", "_ord").alias("ord"),
    )
    official = new.filter(F.col("area") == OFFICIAL).select(
        "layer", "category", "wrong", F.lit(CANDIDATE).alias("area"))
    return out.join(official, list(KEY_COLUMNS), "left_anti")


def promote_terms(glossary: DataFrame, requests: DataFrame, day: str) -> DataFrame:
    """Outcome per request ``(request_id, word, category)``; ``category`` may be NULL.

    The highest layer that holds the word among its candidates decides; more than one
    category there is ambiguous.
    """
    cands = glossary.filter(F.col("area") == CANDIDATE).withColumn("key", fold(F.col("wrong")))
    # lower layers of a word never decide; entries go on only where they fit, and once, by request
    top = cands.groupBy("key").agg(F.max(F.coalesce("layer", F.lit(-1))).alias("_top")).withColumnRenamed("key", "_k")
    cands = cands.join(top, (F.col("key") == F.col("_k")) & (F.coalesce("layer", F.lit(-1)) == F.col("_top"))).drop("_k", "_top")
    asked = requests.select("request_id", "category", fold(F.col("word")).alias("key")).join(
        cands.select("key", "layer", F.col("category").alias("cat"), "wrong", "correct", "hits", "source"), "key", "left")
    fits = F.col("category").isNull() | (F.col("category") == F.col("cat"))
    known = F.col("wrong").isNotNull()
    found = asked.select("request_id", "layer", known.alias("known"), F.when(known & fits, F.struct(
        "cat", "wrong", "correct", "hits", "source")).alias("e")).repartition("request_id")
    per_layer = found.groupBy("request_id", "layer").agg(
        F.count_if("known").alias("found"), F.count("e").alias("fit"), F.min("e").alias("e"))
    top = per_layer.groupBy("request_id").agg(
        F.max_by(F.struct("found", "fit", "e", "layer"), F.coalesce("layer", F.lit(-1))).alias("t"))
    status = (
        F.when(F.col("t.found") == 0, "missing").when(F.col("t.fit") == 0, "not_in_category")
        .when(F.col("t.fit") > 1, "ambiguous").otherwise("promoted")
    )
    done = status == "promoted"
    source = F.when(F.col("t.e.source") == "", F.lit(f"promoted:{day}")).otherwise(
        F.concat(F.regexp_replace("t.e.source", r"^[ |]+", ""), F.lit(f" | promoted:{day}")))
    return top.select(
        "request_id", status.alias("status"),
        *[F.when(done, F.col(f"t.e.{c}")).alias(n) for c, n in
          (("cat", "category"), ("wrong", "wrong"), ("correct", "correct"), ("hits", "hits"))],
        F.when(done, F.col("t.layer")).alias("layer"), F.when(done, source).alias("source"),
    )


def apply_promotions(glossary: DataFrame, outcome: DataFrame) -> DataFrame:
    """New glossary version in which promoted candidates are official."""
    moved = outcome.filter("status = 'promoted'").groupBy("layer", "category", "wrong").agg(
        F.min("source").alias("_src"))
    rows = glossary.join(moved, ["layer", "category", "wrong"], "left")
    hit = F.col("_src").isNotNull() & (F.col("area") == CANDIDATE)
    replaced = (F.col("area") == OFFICIAL) & F.col("_src").isNotNull()
    return rows.filter(~replaced).select(
        "layer", F.when(hit, OFFICIAL).otherwise(F.col("area")).alias("area"), "category", "wrong",
        "correct", "hits", F.when(hit, F.col("_src")).otherwise(F.col("source")).alias("source"),
        "disabled", "ord")


def glossary_inventory(glossary: DataFrame) -> DataFrame:
    """Entries per category of the merged view, official and candidate, with disabled ones."""
    merged = merge_glossary_layers(glossary)
    return merged.groupBy("category").agg(
        F.count_if(F.col("area") == OFFICIAL).alias("official"),
        F.count_if(F.col("area") == CANDIDATE).alias("candidates"),
        F.count_if("disabled").alias("disabled"),
    )


def ranked_terms(active: DataFrame) -> DataFrame:
    """Distinct correct words of official entries with their best hit count and first load."""
    return active.filter(F.col("area") == OFFICIAL).groupBy("category", "right").agg(
        F.max("hits").alias("hits"), F.min("first_ord").alias("first_ord"))


def top_terms(active: DataFrame, category: str | None = None, limit: int = 20) -> DataFrame:
    """The most used correct words (a top-k report)."""
    rows = active.filter(F.col("area") == OFFICIAL)
    if category is not None:
        rows = rows.filter(F.col("category") == category)
    best = rows.groupBy("right").agg(F.max("hits").alias("hits"), F.min("first_ord").alias("first_ord"))
    return best.orderBy(F.desc("hits"), "first_ord").limit(limit).select("right", "hits")


def prompt_terms(active: DataFrame, lang: str = "zh", limit: int = 20) -> DataFrame:
    """Recognition prompt per category: language lead-in plus the most used words."""
    from pyspark.sql import Window as W

    order = W.partitionBy("category").orderBy(F.desc("hits"), "first_ord")
    top = ranked_terms(active).withColumn("n", F.row_number().over(order)).filter(F.col("n") <= limit)
    words = top.groupBy("category").agg(
        F.expr("listagg(right, '、') WITHIN GROUP (ORDER BY n)").alias("words"))
    lead = "以下是普通话的简体中文转写。 " if lang == "zh" else ""
    return words.select("category", F.concat(F.lit(lead + "常听术语："), "words").alias("prompt"))


def term_hits_flat(docs: DataFrame, flat: DataFrame, key: str = "doc_id") -> DataFrame:
    """Hits of a flat ``(wrong, right)`` dictionary, without categories or candidates."""
    keys = flat.groupBy(fold(F.col("wrong")).alias("key")).agg(
        F.max_by("right", "ord").alias("right")
    ).select("key", "right", F.lit("").alias("category"), F.lit(False).alias("candidate"))
    return scan_terms(docs, keys, key).drop("category", "candidate")
