"""Personal data in texts: expressions propose spans, checksums confirm them, words nearby adjust a score.

A rule is an expression, a test of the match (digit counts, Luhn, mod-97) and a score in percent to start with.
Words close to the match raise or lower it. Base rules are reported whatever their score; the added rules (IBAN,
social security numbers, phone numbers without a country code) only from ``THRESHOLD`` on, and never on top
of a base span. Matches are leftmost and do not overlap within a kind; a match that fails its test is dropped.

Every text is searched once in an Arrow function, whole and in linear time: the local part of an address is
looked up backwards from its ``@``, and digits are searched inside maximal runs of characters that numbers may
hold. There is no shuffle, so hot sources and groups of copies cost nothing extra.

Defined cases: null and empty texts have no spans; every row, repeated or with a null id, gets a result of its own;
other columns are kept by ``with_spans`` and ``mask``; an empty table gives no rows. Positions count code
points, end exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn", "local_phone")
THRESHOLD = 50
BEFORE, AFTER = 48, 16  # code points searched for context words

SPANS = "array<struct<kind: string, start: bigint, end: bigint, score: int>>"

# Context words in lower case.
_PHONE = "phone|tel|telefon|telefono|call|mobile|fax|handy|whatsapp|contact"
_VERSION = "version|release|build|firmware"
_ORDER = "order|invoice|isbn|item|serial|tracking|part"
RAISE = {
    "email": "email|mail|contact|correo|courriel",
    "ip": "ip|host|address|client|server",
    "card": "card|visa|mastercard|amex|credit|tarjeta|carte|karte",
    "phone": _PHONE,
    "iban": "iban|bank|account|konto|cuenta|compte",
    "ssn": "ssn|social security|tax id|taxpayer",
    "local_phone": _PHONE,
}
LOWER = {
    "email": "example|test",
    "ip": _VERSION,
    "card": _ORDER,
    "phone": _ORDER,
    "iban": _ORDER,
    "ssn": _ORDER,
    "local_phone": _ORDER,
}
START = {"email": 90, "ip": 60, "card": 80, "phone": 70, "iban": 80, "ssn": 30, "local_phone": 30}
RAISED, LOWERED = 30, 30

# An address from its @ on, and the characters before it.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
# Runs of characters that numbers may hold, from a digit on; seven characters make the shortest IPv4 address.
_AREA = re.compile(r"[0-9][0-9().\x20-]{6,}+")
_IBAN = re.compile(r"\b[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)\b", re.ASCII)
_FOLD = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    """Every second digit from the right doubled, digits summed: divisible by ten."""
    doubled = (2 * int(c) for c in digits[-2::-2])
    return (sum(map(int, digits[::-2])) + sum(x - 9 if x > 9 else x for x in doubled)) % 10 == 0


def mod97(iban: str) -> bool:
    """Country and check digits moved to the end, letters as 10 to 35: remainder 1."""
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def _ip(s: str) -> bool:
    return all(len(p) <= 3 and int(p or "0") <= 255 for p in (x.lstrip("0") for x in s.split(".")))


def _card(s: str) -> bool:
    d = _digits(s)
    return 12 <= len(d) <= 19 and luhn(d)


@dataclass(frozen=True)
class NumberRule:
    """Matches inside a run of number characters that pass ``test``."""

    kind: str
    pattern: re.Pattern
    test: Callable[[str], bool]


NUMBERS = (
    NumberRule("ip", re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"), _ip),
    NumberRule("card", re.compile(r"[0-9]++(?:[\x20-][0-9]++)*+"), _card),
    NumberRule("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda s: 9 <= len(_digits(s)) <= 15),
    NumberRule("ssn", re.compile(r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", re.ASCII), lambda s: s[:3] not in ("000", "666") and s[0] != "9"),
    NumberRule("local_phone", re.compile(r"\(?[0-9]{3}\)?[\x20.-][0-9]{3}[.-][0-9]{4}\b", re.ASCII), lambda s: True),
)


def _emails(text: str) -> Iterator[tuple[int, int]]:
    free = 0
    for m in _DOMAIN.finditer(text):
        head = text[free : m.start()]
        head = head[head.rfind("@") + 1 :]
        local = len(head) - len(head.rstrip(_LOCAL))
        free = m.start() + 1
        if local:
            yield m.start() - local, m.end()
            free = m.end()


def _numbers(text: str) -> Iterator[tuple[str, int, int]]:
    for area in _AREA.finditer(text):
        first, last = area.span()
        if first and text[first - 1] in "+(":
            first -= 1
        # A word character after the run must be seen by \b.
        until = min(len(text), last + 1)
        for rule in NUMBERS:
            for m in rule.pattern.finditer(text, first, until):
                if rule.test(m.group()):
                    yield rule.kind, m.start(), m.end()


def _near(words: str) -> re.Pattern:
    return re.compile(rf"(?:^|[^a-z])(?:{words})(?:[^a-z]|$)")


_RAISE = {k: _near(w) for k, w in RAISE.items()}
_LOWER = {k: _near(w) for k, w in LOWER.items()}


def score(text: str, kind: str, start: int, end: int) -> int:
    """Starting score of the kind, raised and lowered by context words before or after the span; 0 to 100."""
    sides = [text[max(0, start - BEFORE) : start].translate(_FOLD), text[end : end + AFTER].translate(_FOLD)]
    up = any(_RAISE[kind].search(s) for s in sides)
    down = any(_LOWER[kind].search(s) for s in sides)
    return min(100, max(0, START[kind] + RAISED * up - LOWERED * down))


def find(text: str) -> list[tuple[str, int, int, int]]:
    """Spans ``kind, start, end, score`` of one text by start, then kind in the order of ``KINDS``."""
    spans = [("email", *s) for s in _emails(text)]
    spans.extend(_numbers(text))
    for m in _IBAN.finditer(text):
        if mod97(m.group().replace(" ", "")):
            spans.append(("iban", *m.span()))
    if not spans:
        return []
    spans.sort(key=lambda s: (s[1], KINDS.index(s[0])))
    out, base_end = [], 0
    starts = [s[1] for s in spans if s[0] in BASE]
    ahead = 0
    for kind, start, end in spans:
        points = score(text, kind, start, end)
        if kind in BASE:
            base_end = max(base_end, end)
            ahead += 1
        elif points < THRESHOLD or start < base_end or (ahead < len(starts) and starts[ahead] < end):
            continue
        out.append((kind, start, end, points))
    return out


_ITEM = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.int32())])


def _spans(texts: pa.Array) -> pa.Array:
    ends, found = [0], []
    for text in texts:
        if text.is_valid:
            found.extend(find(text.as_py()))
        ends.append(len(found))
    columns = list(zip(*found, strict=True)) or [[]] * len(_ITEM)
    items = [pa.array(c, f.type) for c, f in zip(columns, _ITEM, strict=True)]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(items, fields=list(_ITEM)))


def spans(text: Column) -> Column:
    """Spans of a text; an empty list for null."""
    return F.arrow_udf(_spans, SPANS)(text)


def with_spans(docs: DataFrame, text: str = "text", into: str = "private_spans") -> DataFrame:
    """``docs`` with one more column of spans."""
    return docs.withColumn(into, spans(F.col(text)))


def mask(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind in angle brackets; of overlapping spans the first counts."""
    whole = F.col(text)

    def step(state: Column, s: Column) -> Column:
        plain = F.substr(whole, state["at"] + 1, s["start"] - state["at"])
        more = F.struct(F.concat(state["out"], plain, F.lit("<"), s["kind"], F.lit(">")).alias("out"), s["end"].alias("at"))
        return F.when(s["start"] < state["at"], state).otherwise(more)

    begin = F.struct(F.lit("").alias("out"), F.lit(0).cast("bigint").alias("at"))
    masked = F.aggregate("s", begin, step, lambda z: F.concat(z["out"], F.substr(whole, z["at"] + 1, F.char_length(whole))))
    rows = docs.select(F.struct("*").alias("row"), spans(whole).alias("s"), whole.alias(text))
    return rows.select(F.col("row").withField(f"`{text}`", F.when(F.size("s") > 0, masked).otherwise(whole)).alias("row")).select("row.*")


def _count(kind: str) -> Column:
    return F.size(F.filter("s", lambda x: x["kind"] == kind)).cast("bigint").alias(f"n_{kind}")


def _listed(of: Column) -> Column:
    return F.array_join(F.transform(of, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def private_report(docs: DataFrame) -> DataFrame:
    """Per row: counts of the base kinds, their digest, all spans as text and their scores in the same order."""
    found = docs.select("doc_id", spans("text").alias("s"))
    return found.select(
        "doc_id",
        *[_count(k) for k in BASE],
        F.sha2(_listed(F.filter("s", lambda x: x["kind"].isin(*BASE))), 256).alias("base_sha256"),
        _listed(F.col("s")).alias("spans"),
        F.array_join(F.transform("s", lambda x: x["score"].cast("string")), ",").alias("scores"),
    )
