"""Personal data by anchor expansion.

One Aho-Corasick automaton passes over each text and finds anchors: at-signs,
plus signs, digits, URL schemes, and words that announce an account, an
identity number or a street. At each anchor a small deterministic parser looks
at its surroundings, expands to the boundaries of the whole value and checks
it. Parsers scan every character a bounded number of times, so a text costs
time in proportion to its length, whatever it holds.

Fixed kinds: email, ip (parts to 255), card (12 to 19 digits, Luhn), phone (9
to 15 digits). They are found leftmost and without overlaps in their kind; a
candidate that fails its check is passed over as a whole. Kinds that an
announcing anchor adds, unless the value lies within one that is found:

    url      scheme://user[:password]@host
    iban     after a cue; 15 to 34 characters, remainder 1 modulo 97
    ssn      after a cue; 3-2-4 digits of an area, group and serial in use
    account  after a cue; 6 to 17 digits, single blanks or hyphens between
    street   house number, one to three capitalised words, street word

Spans are kind, start and end (exclusive) in code points, ordered by start,
then by kind as listed.

Defined cases: null text = empty text (no spans); repeated rows are scanned
alike; very long texts are scanned whole; an empty table gives an empty result;
other columns are ignored by `find_personal_data` but for its key, and carried
by `redact_personal_data`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from siltstone.llm._store import read_table

KINDS = ("email", "ip", "card", "phone", "url", "iban", "ssn", "account", "street")
EMAIL, IP, CARD, PHONE, URL, IBAN, SSN, ACCOUNT, STREET = range(len(KINDS))
FIXED_KINDS = KINDS[:4]

#: Words that announce a value after them, and street words that close one.
SCHEMES = ("http://", "https://", "ftp://", "ftps://", "sftp://", "ssh://", "git://", "imap://", "smtp://", "ldap://", "postgres://", "postgresql://", "mysql://", "mongodb://", "redis://", "amqp://", "jdbc://")
CUES = ("iban", "account", "acct", "konto", "routing", "social security", "ssn")
STREETS = (" street", " avenue", " road", " boulevard", " lane", " drive", " square", " court")

LOCAL_CHARS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
QUAD = re.compile(r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
DIGIT_GROUPS = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
DIGITS = re.compile(r"[0-9]++")
PHONE_RUN = re.compile(r"\+[0-9][\x20().0-9-]++")
USERINFO = re.compile(r"[A-Za-z0-9._~%!$&'*+,;=:-]{1,256}+@(?:\[[0-9A-Fa-f:.]{2,45}+\]|[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*+)(?::[0-9]{1,5}+)?")
AFTER_CUE = re.compile(r"(?:\x20?(?:number|numbers|no\.?|nr\.?|num|id|code|is|#)(?![A-Za-z0-9])){0,3}[\x20:=#]{1,4}+", re.IGNORECASE)
IBAN_FORM = re.compile(r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}+(?![A-Za-z0-9])")
SSN_FORM = re.compile(r"([0-9]{3})[\x20-]?([0-9]{2})[\x20-]?([0-9]{4})(?![0-9-])")
ACCOUNT_FORM = re.compile(r"[0-9](?:[\x20-]?[0-9]){5,16}+(?![0-9A-Za-z])")
HOUSE = re.compile(r"(?<![A-Za-z0-9.,])[0-9]{1,5}[a-d]?(?:\x20[A-Z][a-z]{1,20}+){1,3}+\Z")
STREET_REACH = 80


def _automaton():
    """Anchors by what they start: cues in lower, title and upper case."""
    out = ahocorasick.Automaton()
    for digit in "0123456789":
        out.add_word(digit, ("digit", 1))
    out.add_word("@", ("at", 1))
    out.add_word("+", ("plus", 1))
    for role, words in (("scheme", SCHEMES), ("cue", CUES), ("street", STREETS)):
        for word in words:
            for form in {word, word.title(), word.upper()}:
                out.add_word(form, (role, len(form)))
    out.make_automaton()
    return out


ANCHORS = _automaton()


def luhn(digits: str) -> bool:
    values = [int(c) for c in reversed(digits)]
    return (sum(values[::2]) + sum(v * 2 - 9 * (v > 4) for v in values[1::2])) % 10 == 0


def mod_97(iban: str) -> bool:
    """The check of an IBAN without blanks: four characters moved to its end, letters as 10 to 35."""
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def _email(text: str, at: int, least: int) -> tuple[int, int] | None:
    """Around an at-sign; the local part may start at `least`."""
    start = least + len(text[least:at].rstrip(LOCAL_CHARS))
    domain = DOMAIN.match(text, at + 1)
    return (start, domain.end()) if domain and start < at else None


def _phone(text: str, at: int) -> tuple[int, int] | None:
    run = PHONE_RUN.match(text, at)
    if not run:
        return None
    kept = run[0].rstrip(" ().-")
    return (at, at + len(kept)) if len(kept) >= 4 and 9 <= sum(c.isdigit() for c in kept) <= 15 else None


def _announced(text: str, start: int, end: int) -> tuple[int, int, int] | None:
    """The value after a cue text[start:end]."""
    if (start and text[start - 1].isalnum()) or text[end : end + 1].isalnum():
        return None
    gap = AFTER_CUE.match(text, end)
    if not gap:
        return None
    at, cue = gap.end(), text[start:end].lower()
    if iban := IBAN_FORM.match(text, at):
        value = iban[0].replace(" ", "")
        return (IBAN, at, iban.end()) if mod_97(value) else None
    if cue in ("ssn", "social security"):
        ssn = SSN_FORM.match(text, at)
        used = ssn and ssn[1] not in ("000", "666") and ssn[1] < "900" and ssn[2] != "00" and ssn[3] != "0000"
        return (SSN, at, ssn.end()) if used else None
    account = ACCOUNT_FORM.match(text, at) if cue != "iban" else None
    return (ACCOUNT, at, account.end()) if account else None


def _street(text: str, start: int, end: int) -> tuple[int, int, int] | None:
    """A house number and names before a street word text[start:end]."""
    if text[end : end + 1].isalnum():
        return None
    for m in re.finditer(r"[0-9]{1,5}[a-d]?\x20", text[max(0, start - STREET_REACH) : start]):
        at = max(0, start - STREET_REACH) + m.start()
        if HOUSE.match(text, at, start):
            return STREET, at, end
    return None


def _not_within(added: list[tuple[int, int, int]], found: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, int]]:
    """The added (kind, start, end) that lie within no found span and no other added one: in order of start, longest first, none ends before the furthest end so far."""
    rows = sorted([(s, -e, -1, 0) for s, _, e in found] + [(s, -e, i, kind) for i, (kind, s, e) in enumerate(added)])
    furthest = 0
    for start, end, i, kind in rows:
        if i >= 0 and -end > furthest:
            yield kind, start, -end
        furthest = max(furthest, -end)


def spans_of(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of all spans of a text, ordered."""
    found, more = [], []
    email_end = last_at = ip_end = card_end = run_end = 0
    for last, (role, size) in ANCHORS.iter(text):
        start, end = last + 1 - size, last + 1
        if role == "digit":
            if start < run_end:
                continue
            run_end = DIGITS.match(text, start).end()
            if start >= ip_end and (quad := QUAD.match(text, start)):
                ip_end = quad.end()
                if all(len(p) <= 3 and int(p or "0") <= 255 for p in (x.lstrip("0") for x in quad[0].split("."))):
                    found.append((start, IP, ip_end))
            if start >= card_end and (groups := DIGIT_GROUPS.match(text, start)):
                card_end = groups.end()
                digits = groups[0].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    found.append((start, CARD, card_end))
        elif role == "at":
            if email := _email(text, start, max(email_end, last_at)):
                found.append((email[0], EMAIL, email[1]))
                email_end = email[1]
            last_at = end
        elif role == "plus":
            if phone := _phone(text, start):
                found.append((phone[0], PHONE, phone[1]))
        elif role == "scheme":
            if user := USERINFO.match(text, end):
                more.append((URL, start, user.end()))
        elif value := (_announced if role == "cue" else _street)(text, start, end):
            more.append(value)
    if more:
        found += [(start, kind, end) for kind, start, end in _not_within(more, found)]
    return sorted(found)


SPANS = ArrayType(StructType([StructField("kind", StringType(), False), StructField("start", LongType(), False), StructField("end", LongType(), False)]), False)


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.struct([pa.field("kind", pa.string(), False), pa.field("start", pa.int64(), False), pa.field("end", pa.int64(), False)])
    names = pa.array(KINDS)
    for batch in batches:
        sizes, flat = np.zeros(batch.num_rows + 1, dtype=np.int32), []
        for i, text in enumerate(batch.column("text")):
            spans = spans_of(text.as_py()) if text.is_valid else ()
            sizes[i + 1] = len(spans)
            flat += spans
        start, number, end = (np.array(c, dtype=np.int64) for c in (zip(*flat, strict=True) if flat else ((), (), ())))
        values = pa.StructArray.from_arrays([names.take(pa.array(number)), pa.array(start), pa.array(end)], fields=list(kind))
        spans = pa.ListArray.from_arrays(pa.array(np.cumsum(sizes, dtype=np.int32)), values, type=pa.list_(pa.field("element", kind, False)))
        yield pa.record_batch([batch.column("key"), spans], names=["key", "spans"])


def find_personal_data(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, spans) for each row: an array of kind, start and end."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(_find, StructType([rows.schema["key"], StructField("spans", SPANS)])).withColumnRenamed("key", key)


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _redact(text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text)
            out = []
            for value in batch.column(at).to_pylist():
                parts, past = [], 0
                for start, kind, end in spans_of(value) if value else ():
                    if end > past:
                        parts += [value[past : max(past, start)], f"[{KINDS[kind].upper()}]"] if start >= past else []
                        past = end
                out.append(value if not parts else "".join([*parts, value[past:]]))
            yield batch.set_column(at, text, pa.array(out, batch.column(at).type))

    return run


def redact_personal_data(docs: DataFrame, text: str = "text") -> DataFrame:
    """The same rows and columns, every span replaced by its kind in brackets."""
    return docs.mapInArrow(_redact(text), docs.schema)


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = find_personal_data(read_table(spark, sf_dir, "documents"))
    fixed = F.filter("spans", lambda s: s["kind"].isin(*FIXED_KINDS))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return rows.select("doc_id", *map(count, FIXED_KINDS), F.sha2(written(fixed).cast("binary"), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
