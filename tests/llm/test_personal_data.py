"""op12's fixed kinds against plain patterns, its added kinds against cases written by hand."""

import hashlib
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from siltstone.llm import registry
from siltstone.llm.personal_data import KINDS, find_personal_data, redact_personal_data, spans_of

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def holds(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(x) <= 255 for x in value.split("."))
    if kind == "card":
        doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
        return 12 <= len(digits) <= 19 and sum(d // 10 + d % 10 for d in doubled) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def plainly(text):
    found = [(m.start(), k, m.end()) for k, (kind, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, text) if holds(kind, m[0])]
    return sorted(found)


def strange(pick):
    """Texts of pieces that make whole, cut, nested and adjacent candidates."""
    pieces = ["a", "é", "@", "a.b@c-d.e", "@x.y", "1.2.3.4", "256.1.1.1", ".", "..", "0", "7", "12", "-", " ", "4111 1111 1111 1111", "5500-0000-0000-0004", "+", "+1 (988) 555-2485", "+49", "(", ")", "007.0.00.1", "%", "_", "\n", "你", "4041894974608795", "\U0001f600", "000000000000"]
    return "".join(pick.choice(pieces) for _ in range(pick.randrange(0, 25)))


TEXTS = [strange(random.Random(i)) for i in range(4000)] + ["", "a@b@c.d@e.f.g", "1.2.3.4.5.6.7.8.9", "1.2.3", "+1", "+12", "+1-2", "x@y.", "x@y..z", "@y.z", "0" * 5000, "1 " * 500, "0001.2.3.4", "1.2.3.0000000000000000255"]


def test_fixed_kinds_against_patterns():
    for text in TEXTS:
        assert [s for s in spans_of(text) if s[1] < 4] == plainly(text), text


def test_query(spark, tmp_path):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS[:600])] + [(None, None, "y"), (3, "a@b.c", "z"), (3, "a@b.c", "z")]
    spark.createDataFrame(rows, "doc_id long, text string, spans string").write.parquet(f"{tmp_path}/documents.parquet")
    out = registry.queries()["op12_personal_data"](spark, str(tmp_path)).collect()
    assert len(out) == len(rows)
    shown = lambda spans: ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)
    expected = []
    for i, text, _ in rows:
        spans = plainly(text or "")
        expected.append((str(i), *(sum(s[1] == k for s in spans) for k in range(4)), hashlib.sha256(shown(spans).encode()).hexdigest(), shown(spans_of(text or ""))))
    assert sorted((str(r.doc_id), r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256, r.spans) for r in out) == sorted(expected)


ADDED = [
    ("see https://bob:pa%20ss@host.example:8080/x", "url", "https://bob:pa%20ss@host.example:8080"), ("ssh://root@box", "url", "ssh://root@box"), ("https://host.example/a", None, None), ("IBAN: DE89 3704 0044 0532 0130 00, thanks", "iban", "DE89 3704 0044 0532 0130 00"),
    ("iban GB82WEST12345698765432.", "iban", "GB82WEST12345698765432"), ("iban DE89370400440532013001", None, None), ("SSN 123-45-6789", "ssn", "123-45-6789"), ("ssn: 000-12-3456", None, None), ("Social Security number is 078-05-1120 there", "ssn", "078-05-1120"),
    ("Account number: 12345678", "account", "12345678"), ("acct no. 12-34-5678 x", "account", "12-34-5678"), ("on account of 12345678 people", None, None), ("accountable 12345678", None, None), ("account 12345", None, None), ("bank account: 1234567890123456789012", None, None),
    ("at 12 Baker Street, London", "street", "12 Baker Street"), ("lives at 7b Old Mill Road.", "street", "7b Old Mill Road"), ("on Baker Street", None, None), ("the 1980s saw Wall Street", None, None), ("12 people crossed the road", None, None),
]


@pytest.mark.parametrize("text, kind, value", ADDED)
def test_added_kinds(text, kind, value):
    found = [(KINDS[k], text[s:e]) for s, k, e in spans_of(text) if k >= 4]
    assert found == ([(kind, value)] if kind else [])


def test_added_spans_are_not_within_fixed_ones():
    text = "http://bob:x@mail.example.com and account 4111111111111111"
    assert [(KINDS[k], text[s:e]) for s, k, e in spans_of(text)] == [("url", "http://bob:x@mail.example.com"), ("email", "x@mail.example.com"), ("card", "4111111111111111")]


def test_redaction(spark):
    df = spark.createDataFrame([(1, "write to a@b.com or http://u:p@h.org/ or +1 (988) 555-2485!", "k"), (2, None, "k"), (3, "", "k"), (4, "nothing", "k")], "doc_id long, text string, spans string")
    assert [tuple(r) for r in redact_personal_data(df).collect()] == [(1, "write to [EMAIL] or [URL]/ or [PHONE]!", "k"), (2, None, "k"), (3, "", "k"), (4, "nothing", "k")]


@pytest.mark.parametrize("piece", ["@", "a@", "1", "1 ", "1.", "+1", "a.", "account ", "12 Ab ", "http://", "ssn: 1", " Street"])
def test_long_texts_take_linear_time(piece):
    text = piece * (2_000_000 // len(piece))
    began = time.time()
    spans_of(text)
    assert time.time() - began < 20


def test_ten_megabytes_in_one_text(spark):
    df = spark.range(2).select(F.col("id").alias("doc_id"), F.concat(F.repeat(F.lit("wörd "), F.lit(2_000_000)), F.lit("a@b.cd")).alias("text"))
    assert [[tuple(s) for s in r.spans] for r in find_personal_data(df).collect()] == [[("email", 10_000_000, 10_000_006)]] * 2
