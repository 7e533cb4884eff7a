"""Personal data: base spans against plain expressions, checksums, context scores, defined cases."""

import random
import re
import time

from pyspark.sql import functions as F

from dropscope.llm import personal

PLAIN = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def _sum_of_digits(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits)))


def _plain(text):
    out = []
    for order, (kind, pattern) in enumerate(PLAIN.items()):
        for m in pattern.finditer(text):
            d = re.sub("[^0-9]", "", m.group())
            good = {
                "email": True,
                "ip": kind == "ip" and max(int(x) for x in m.group().split(".")) <= 255,
                "card": 12 <= len(d) <= 19 and _sum_of_digits(d) % 10 == 0,
                "phone": 9 <= len(d) <= 15,
            }[kind]
            if good:
                out.append((m.start(), order, kind, m.end()))
    return [(k, s, e) for s, _, k, e in sorted(out)]


def _base(text):
    return [s[:3] for s in personal.find(text) if s[0] in personal.BASE]


def test_base_equals_plain_expressions():
    rnd = random.Random(5)
    for alphabet in ("ab@@..-+1122505 () %é0", "0123456789 -.+", "12.", "a@.b "):
        for _ in range(3000):
            text = "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 70)))
            assert _base(text) == _plain(text), text


def test_checksums():
    assert personal.luhn("4111111111111111") and not personal.luhn("4111111111111112")
    assert personal.mod97("DE89370400440532013000") and not personal.mod97("DE88370400440532013000")
    kinds = lambda t: [s[0] for s in personal.find(t)]
    assert kinds("pay to DE89 3704 0044 0532 0130 00, or GB82WEST12345698765432.") == ["iban", "iban"]
    assert kinds("pay to DE88 3704 0044 0532 0130 00") == [] == kinds("xDE89370400440532013000")
    assert kinds("card 4111-1111 1111 1111 card 4111-1111 1111 1112") == ["card"]


def test_context_decides_added_spans():
    assert personal.find("my SSN is 123-45-6789") == [("ssn", 10, 21, 60)]
    assert personal.find("code 123-45-6789") == [] == personal.find("my SSN is 000-45-6789")
    assert personal.find("order 7, ssn 123-45-6789") == []  # lowered again
    assert [s[:3] for s in personal.find("call (212) 555-0100 now")] == [("local_phone", 5, 19)]
    assert personal.find("see (212) 555-0100 now") == []
    assert [s[0] for s in personal.find("call +1 (212) 555-0100 now")] == ["phone"]  # no second span on top of a base span
    low, high = personal.find("version 10.0.0.1")[0], personal.find("server 10.0.0.1")[0]
    assert (low[0], low[3], high[3]) == ("ip", 30, 90)  # base spans stay whatever their score


def test_long_texts_take_linear_time():
    for unit in ("1", "a", "@", "+1 ", "1 ", "A", "AA11", "(", "1.1.1.x"):
        text = unit * (400_000 // len(unit))
        start = time.time()
        personal.find(text)
        assert time.time() - start < 20, unit


def test_rows(spark):
    schema = "doc_id BIGINT, text STRING, s STRING, row STRING, kind STRING"
    rows = [
        (1, "write to a.b@c.de", "x", "y", "z"),
        (1, "write to a.b@c.de", "x", "y", "z"),
        (2, None, None, None, None),
        (None, "é\U0001f600 10.0.0.1 " + "w " * 50_000 + "+49 30 1234567", "x", None, None),
        (3, "", "x", None, None),
    ]
    docs = spark.createDataFrame(rows, schema)
    got = {(r["doc_id"], r["spans"]) for r in personal.private_report(docs).collect()}
    assert got == {(1, "email:9:17"), (2, ""), (3, ""), (None, "ip:3:11,phone:100012:100026")}
    assert personal.private_report(docs).count() == 5
    masked = personal.mask(docs)
    assert masked.columns == docs.columns
    texts = {r["doc_id"]: r["text"] for r in masked.collect()}
    assert texts[1] == "write to <email>" and texts[2] is None and texts[3] == ""
    assert texts[None] == "é\U0001f600 <ip> " + "w " * 50_000 + "<phone>"
    wide = personal.with_spans(docs)
    assert wide.columns == [*docs.columns, "private_spans"]
    assert wide.filter(F.size("private_spans") > 0).count() == 3
    none = spark.createDataFrame([], schema)
    assert personal.private_report(none).collect() == [] == personal.mask(none).collect()
