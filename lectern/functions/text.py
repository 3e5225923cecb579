"""Text column expressions: whitespace, time marks, names, Markdown escapes.

Java's ``trim`` and ``\\s`` know fewer blanks than the data uses (U+3000 is common in
Chinese captions), so blanks are spelled out once in ``BLANK``.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed value: every code point that counts as white space in transcripts and notes.
BLANK = (
    r"[\t\n\x0b\f\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
# The same code points as characters: trimming looks at the ends of a text only, a pattern at all of it.
BLANK_CHARS = "".join(map(chr, (*range(9, 14), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
# Fixed value: line ends recognised when a text is cut into lines.
LINE_END = r"\r\n|[\n\x0b\f\r\x1c-\x1e\x{85}\x{2028}\x{2029}]"


def strip(c: Column) -> Column:
    """Remove leading and trailing blanks of any kind."""
    return F.trim(c, F.lit(BLANK_CHARS))


def rstrip(c: Column) -> Column:
    return F.rtrim(c, F.lit(BLANK_CHARS))


def squeeze(c: Column) -> Column:
    """Each run of blanks becomes one space; the ends are trimmed."""
    return F.trim(F.regexp_replace(c, f"{BLANK}+", " "))


def is_blank(c: Column) -> Column:
    return F.length(strip(c)) == 0


def lines_of(c: Column) -> Column:
    """Array of lines; a final line end does not open an empty last line."""
    # the text is searched for line ends once; the lambda only names the result
    last = lambda x: F.when((F.size(x) > 1) & (F.element_at(x, -1) == ""), F.slice(x, 1, F.size(x) - 1)).otherwise(x)
    return F.transform(F.array(F.split(c, LINE_END, -1)), last)[0]


def mmss(seconds: Column) -> Column:
    """Whole seconds as ``mm:ss``; minutes may exceed 59."""
    whole = F.floor(seconds).cast("bigint")
    minutes = F.floor(whole / 60).cast("bigint")
    width = F.greatest(F.lit(2), F.length(minutes.cast("string")))
    return F.concat(
        F.lpad(minutes.cast("string"), width, F.lit("0")),
        F.lit(":"),
        F.lpad((whole % 60).cast("string"), 2, "0"),
    )


def hms(seconds: Column) -> Column:
    """Whole seconds as ``mm:ss`` below one hour and ``h:mm:ss`` from one hour on."""
    whole = F.floor(seconds).cast("bigint")
    hours = F.floor(whole / 3600).cast("bigint")
    rest = F.concat(
        F.lpad(F.floor(whole % 3600 / 60).cast("bigint").cast("string"), 2, "0"),
        F.lit(":"),
        F.lpad((whole % 60).cast("string"), 2, "0"),
    )
    return F.when(hours > 0, F.concat(hours.cast("string"), F.lit(":"), rest)).otherwise(rest)


def clock_to_seconds(c: Column) -> Column:
    """``mm:ss`` or ``h:mm:ss`` to seconds; anything else is NULL."""
    text = strip(c)
    parts = F.split(text, ":")
    total = F.aggregate(
        parts, F.lit(0).cast("bigint"), lambda acc, p: acc * 60 + p.try_cast("bigint")
    )
    return F.when(text.rlike(r"^\d+(:\d+){1,2}$"), total.cast("double"))


def file_safe(c: Column) -> Column:
    """Characters a file system refuses become ``_``; at most 60 characters stay."""
    return F.substring(strip(F.regexp_replace(c, r'[\\/:*?"<>|]', "_")), 1, 60)


def escape_cell(c: Column) -> Column:
    """Text for one Markdown table cell."""
    return F.regexp_replace(F.regexp_replace(c, r"\|", r"\\\\|"), r"\s*\n\s*", " ")


def cell_text(c: Column) -> Column:
    """Outside text on one line of a generated document; null is empty."""
    out = F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|"))
    return F.translate(out, "\r\n", "  ")


def link_path(c: Column) -> Column:
    """Path as a Markdown link target: other characters than unreserved ones and Chinese are percent-encoded."""
    slashed = F.replace(F.coalesce(c, F.lit("")), F.lit("\\"), F.lit("/"))
    return F.array_join(F.transform(F.split(slashed, ""), lambda ch: F.when(ch.rlike(r"^[A-Za-z0-9_.~/\u4e00-\u9fff-]?$"), ch).otherwise(
        F.regexp_replace(F.regexp_replace(F.url_encode(ch), r"\+", "%20"), r"\*", "%2A"))), "")
