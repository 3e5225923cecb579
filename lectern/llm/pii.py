"""Personal data in texts: expressions propose spans, checksums confirm them, nearby words move their score."""

from __future__ import annotations

import re
from bisect import bisect_left

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.arrow import bounded_batches, with_columns

KINDS = ("email", "ip", "card", "phone", "iban", "local_phone", "social_security")
BASE = 4
# Linear forms: a run is entered at its start or where the match before ended, and never given back.
EMAIL = regex.compile(r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
LOCAL_PHONE = re.compile(r"(?<![0-9A-Za-z+().-])(?:\([0-9]{2,5}\)|0[0-9]{1,4})[ /.-]?[0-9]{3,4}(?:[ .-]?[0-9]{2,4}){1,2}(?![0-9A-Za-z-])")
SOCIAL = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")

#: Score that an expression alone is worth, and the least score of a span that is added to the base ones.
PRIOR = {"email": 0.9, "ip": 0.7, "card": 0.5, "phone": 0.7, "iban": 0.3, "local_phone": 0.3, "social_security": 0.4}
CONFIRMED, NEAR, LEAST = 0.4, 0.3, 0.6
#: Code points before and after a span in which context words count.
REACH = 48
CONTEXT = {
    "email": ("mail", "contact", "correo", "kontakt", "courriel"),
    "ip": ("ip", "host", "server", "address", "adresse"),
    "card": ("card", "visa", "credit", "tarjeta", "karte", "carte"),
    "phone": ("phone", "tel", "call", "fax", "mobile", "telefon", "telefono", "téléphone"),
    "iban": ("iban", "account", "bank", "konto", "cuenta", "compte"),
    "local_phone": ("phone", "tel", "call", "fax", "mobile", "telefon", "telefono", "téléphone"),
    "social_security": ("ssn", "social", "security"),
}
_WORD = re.compile(r"\w+")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else (2 * n - 9 if n > 4 else 2 * n)
    return total % 10 == 0


def mod97(account: str) -> bool:
    turned = account[4:] + account[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or "0") <= 255


def _confirmed(kind: str, found: str) -> bool | None:
    """True or False by checksum or range; None where a kind has none."""
    if kind == "ip":
        return all(map(_octet, found.split(".")))
    if kind == "card":
        digits = _digits(found) if len(found) <= 37 else ""
        return 14 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 10 <= len(_digits(found)) <= 15
    if kind == "iban":
        account = found.replace(" ", "")
        return 15 <= len(account) <= 34 and mod97(account)
    return None


def find_spans(text: str | None) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) in code points, by start and then kind. Base kinds stay whatever their score."""
    if not text:
        return []
    found = []
    digit = re.search("[0-9]", text) is not None
    for kind, expression, possible in (
            ("email", EMAIL, "@" in text), ("ip", IP, digit), ("card", CARD, digit),
            ("phone", PHONE, digit and "+" in text), ("iban", IBAN, digit), ("local_phone", LOCAL_PHONE, digit),
            ("social_security", SOCIAL, digit)):
        if not possible:
            continue
        for m in expression.finditer(text):
            a, b = m.span()
            confirmed = _confirmed(kind, text[a:b])
            if confirmed is False:
                continue
            score = PRIOR[kind] + (CONFIRMED if confirmed else 0)
            near = _WORD.findall((text[max(0, a - REACH):a] + " " + text[b:b + REACH]).lower())
            score = min(1.0, score + (NEAR if not CONTEXT[kind] or set(near).intersection(CONTEXT[kind]) else 0))
            if kind in KINDS[:BASE] or score >= LEAST:
                found.append((kind, a, b, score))
    found.sort(key=lambda s: (s[1], KINDS.index(s[0])))
    taken: list[tuple[int, int]] = [(a, b) for kind, a, b, _ in found if kind in KINDS[:BASE]]
    starts = [a for a, _ in taken]

    def free(a: int, b: int) -> bool:
        """Whether an added span touches no base span around it."""
        i = bisect_left(starts, b)
        return all(taken[k][1] <= a for k in range(max(0, i - BASE), i))

    return [s for s in found if s[0] in KINDS[:BASE] or s[0] == "iban" or free(s[1], s[2])]


SPANS = T.ArrayType(T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()),
    T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType())]))
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))


def _as_arrow(rows) -> pa.Array:
    return pa.array([[dict(zip(("kind", "start", "end", "score"), s)) for s in row] for row in rows], _ARROW)


def detect(df: DataFrame, text: str = "text", spans: str = "pii") -> DataFrame:
    """Adds the spans of each whole text. Null and empty texts have none; repeated rows get the same spans each."""
    def step(texts: pa.Array) -> list[pa.Array]:
        return [_as_arrow(map(find_spans, texts.to_pylist()))]

    return with_columns(bounded_batches(df), [text], T.StructType([T.StructField(spans, SPANS)]), step)


def redact_text(text: str | None) -> str | None:
    """Each span becomes its kind in angle brackets; spans that overlap become one, named by the first."""
    spans, out, at = find_spans(text), [], 0
    if not spans:
        return text
    for kind, a, b, _ in spans:
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """Texts with their personal data replaced; null texts stay null. Columns keep their order."""
    def step(texts: pa.Array) -> list[pa.Array]:
        return [pa.array(map(redact_text, texts.to_pylist()), pa.string())]

    made = with_columns(bounded_batches(df), [text], T.StructType([T.StructField(text, T.StringType())]), step)
    return made.select(*[f"`{c}`" for c in df.columns])


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def base_only(spans: Column) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*KINDS[:BASE]))


def counted(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
