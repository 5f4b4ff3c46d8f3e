"""Secret scans: fixed patterns, and dictionary-primed zstandard novelty.

Three patterns find assignments, access keys and long hexadecimal runs. On top
of them, strings in a sensitive context (near words such as password, token or
private key, before or after them) are candidates for the novelty measure: runs
of letters, digits and punctuation, and quoted strings without blanks.

* zstandard, primed with an identifier dictionary, compresses the candidate
  behind the text around it. Copies of the candidate are blanked out of that
  text, as a secret written twice is still one. The bytes that it adds are held
  against those that as many random characters of its alphabet add there: one
  made of its surroundings, of itself, or of known identifiers saves bytes.
* zstandard pays whole bytes for what it does not match, so short words cost it
  what random characters do. Literals are therefore priced a second time, by an
  order-2 character model of the same identifiers, against random characters of
  the alphabet.

A candidate that saves little by either measure is reported as kind "novel", to
its end however long it is. A PEM private key block is "novel" as a whole.

The identifiers are the words of a public tokenizer's vocabulary, in the order
of its ranks, and the `LEARNED_WORDS` most frequent words of the documents
(counted over all of them, ties by spelling; at least `MIN_WORD_COUNT` times,
so that no secret gets in by being copied), a bounded table. The words are
counted when the operator is called.

Digits alone are candidates only right behind a context word, as numbers are
frequent in prose.

Spans are kind:start:end in code points, end exclusive, of the whole match.

Defined cases: null text = empty text (no spans, the hash of the empty
string); repeated rows are scanned alike; very long texts are scanned whole;
an empty table gives an empty result; other columns are ignored by the query
and carried by `redact_secrets`.
"""

from __future__ import annotations

import base64
import bisect
import functools
import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm._store import read_table
from siltstone.llm._text import LOWER, chunks

KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]+")
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 6, 20, 24

CONTEXT = re.compile(rb"passw|pwd|secret|token|api[ _-]?key|private[ _-]?key|access[ _-]?key|credential|bearer|authorization", re.IGNORECASE)
#: A run; parts joined by dots, as in a JSON web token, are one.
CANDIDATE = re.compile(rb"[A-Za-z0-9+/_=!@#$%^&*~-]{12,}+(?:\.[A-Za-z0-9+/_=!@#$%^&*~-]{6,}+)*+")
QUOTED = re.compile(rb"""(?<=["'`])[!#-&(-\[\]-_a-~]{12,}+(?=["'`])""")
PIECE = re.compile(rb"[^=&/.@:,;?+#]{12,}+")
PEM = re.compile(rb"-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY(?: BLOCK)?-----(?:[A-Za-z0-9+/=\s\\:,.\"'()@<>]|-(?!----))*+(?:-----END [A-Z0-9 ]{0,40}PRIVATE KEY(?: BLOCK)?-----)")
#: A block without its end: the lines that follow.
CUT_PEM = re.compile(rb"-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY(?: BLOCK)?-----(?:(?:\s|\\[nr])*+[A-Za-z0-9+/=]{16,}+)++")
CONTEXT_REACH, DIGITS_REACH, SURROUNDINGS, MIN_CANDIDATE = 64, 16, 512, 12
#: Of the bytes, and of the model's bits, that as many random characters of the candidate's alphabet take.
MIN_MARGINAL_SHARE, MIN_MODEL_SHARE = 0.9, 0.95
LOWER_CASE, UPPER_CASE, DIGITS = b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789"

WORD = re.compile(rb"(?<![A-Za-z0-9])[A-Za-z][a-z]{2,11}(?![A-Za-z0-9])")
LEARNED_WORDS, VOCABULARY_WORDS, MIN_WORD_COUNT, COUNTED_AT_ONCE = 4096, 6000, 100, 200_000
#: Placeholders of code and configuration; part of every dictionary.
IDENTIFIERS = (
    b"password passwd secret token api_key apikey access_key private_key client_secret client_id authorization bearer credential "
    b"username user_name account session cookie header request response config settings environment variable default example "
    b"placeholder changeme your_token_here your_password_here xxxxxxxxxxxxxxxx 0000000000000000 1234567890 abcdefghijklmnopqrstuvwxyz "
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789abcdef https http localhost import export function return const class public static void string "
)
#: Symbols of the character model: letters without case, a digit, anything else.
DIGIT, OTHER, SYMBOLS = 26, 27, 28
SYMBOL = np.full(256, OTHER)
SYMBOL[list(LOWER_CASE)] = SYMBOL[list(UPPER_CASE)] = range(26)
SYMBOL[list(DIGITS)] = DIGIT
#: Bits of a letter's case: behind a lower-case letter (kept, raised), otherwise; of a digit behind a digit, behind others; of a joiner, other punctuation.
SAME_CASE, RAISED, FREE_CASE, NEXT_DIGIT, FIRST_DIGIT, JOINER, PUNCTUATION = 0.2, 3.0, 1.0, 1.0, 3.0, 5.0, 8.0
JOINERS = np.isin(np.arange(256), list(b"_-/.="))
#: Literals stay whole bytes: only matches with the dictionary and the surroundings save any.
PRESS = dict(window_log=20, chain_log=16, hash_log=16, search_log=4, min_match=4, target_length=1, strategy=zstandard.STRATEGY_FAST, write_content_size=False, write_checksum=False, write_dict_id=False)
#: Substrings (lower case) one of which every assignment or sensitive context holds.
STEMS = (b"passw", b"pwd", b"secret", b"token", b"apikey", b"api_key", b"api-key", b"key", b"credential", b"bearer", b"authorization")
HEX_BYTE = np.isin(np.arange(256), np.frombuffer(b"0123456789abcdef", dtype=np.uint8))


class Lexicon(NamedTuple):
    """What novelty is measured against: a dictionary for zstandard, and bits of each symbol after two others."""

    dictionary: bytes
    bits: np.ndarray


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@functools.lru_cache(maxsize=4)
def lexicon(learned: tuple[bytes, ...] = (), path: str | None = None) -> Lexicon:
    """From the words of a rank file (a vocabulary's path is a parameter) and words learned from the corpus, most frequent first."""
    with open(path or vocabulary_path(), "rb") as f:
        pieces = (base64.b64decode(line.split()[0]).strip() for line in f)
        known = list(dict.fromkeys(x for x in pieces if re.fullmatch(rb"[A-Za-z]{3,16}", x)))
    seen = np.zeros((SYMBOLS,) * 3)
    for words in (known, learned):
        for rank, word in enumerate(words):
            s = [OTHER, OTHER, *SYMBOL[list(word)], OTHER]
            np.add.at(seen, (s[:-2], s[1:-1], s[2:]), 50 / (50 + rank))
    two = seen.sum(0)
    one = two.sum(0) + 0.5
    pair = (two + 2 * one / one.sum()) / (two.sum(1, keepdims=True) + 2)
    bits = -np.log2((seen + pair) / (seen.sum(2, keepdims=True) + 1))
    return Lexicon(b" ".join([*reversed(known[:VOCABULARY_WORDS]), *reversed(learned), IDENTIFIERS]), bits)


@functools.lru_cache(maxsize=4)
def _press(dictionary: bytes) -> zstandard.ZstdCompressor:
    settings = zstandard.ZstdCompressionParameters(**PRESS)
    primed = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    primed.precompute_compress(compression_params=settings)
    return zstandard.ZstdCompressor(dict_data=primed, compression_params=settings)


def alphabet(candidate: bytes) -> bytes:
    """The characters that a random string like the candidate draws on: whole classes of letters and digits, its own punctuation."""
    found = b""
    for letters, beyond, within in ((LOWER_CASE, rb"[g-z]", rb"[a-f]"), (UPPER_CASE, rb"[G-Z]", rb"[A-F]")):
        found += letters if re.search(beyond, candidate) else letters[:6] if re.search(within, candidate) else b""
    return found + DIGITS * bool(re.search(rb"[0-9]", candidate)) + bytes(sorted(c for c in set(candidate) if SYMBOL[c] == OTHER))


@functools.lru_cache(maxsize=1024)
def _random(of: bytes, length: int) -> bytes:
    return bytes(np.random.default_rng(length).choice(np.frombuffer(of, dtype=np.uint8), length))


def marginal_share(candidate: bytes, surroundings: bytes, known: Lexicon) -> float:
    """Compressed bytes that a candidate adds to its surroundings, less those that random characters add, as a part of its length, plus one."""
    press = _press(known.dictionary)
    plain = _random.__wrapped__ if len(candidate) > 256 else _random
    added, fresh = (len(press.compress(surroundings + x)) for x in (candidate, plain(alphabet(candidate), len(candidate))))
    return 1 + (added - fresh) / len(candidate)


def model_share(candidate: bytes, known: Lexicon) -> float:
    """Bits of a candidate under the character model, as a part of what as many random characters take."""
    raw = np.frombuffer(candidate, dtype=np.uint8)
    symbol = SYMBOL[raw]
    letter, low = symbol < DIGIT, raw >= 97
    behind = np.concatenate(([False], (letter & low)[:-1]))
    hump = letter & ~low & behind  # a capital behind a small letter starts a word
    last = np.concatenate(([OTHER], symbol[:-1]))
    before = np.concatenate(([OTHER], last[:-1]))
    bits = known.bits[np.where(hump | np.concatenate(([False], hump[:-1])), OTHER, before), np.where(hump, OTHER, last), symbol]
    bits = bits + np.where(behind, np.where(low, SAME_CASE, RAISED), FREE_CASE)
    digit = math.log2(10) + np.where(last == DIGIT, NEXT_DIGIT, FIRST_DIGIT)
    cost = np.where(letter, bits, np.where(symbol == DIGIT, digit, np.where(JOINERS[raw], JOINER, PUNCTUATION)))
    of = alphabet(candidate)
    size = len(of) + (0 if re.search(rb"[0-9]", candidate) else 10)
    return float(cost.sum()) / (len(candidate) * math.log2(size))


def base_spans(raw: bytes) -> list[tuple[int, int, int]]:
    """(start, kind number, end) in bytes of the fixed patterns."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(raw) if m.end(2) - m.start(2) >= MIN_ASSIGN]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(raw) if m.end() - m.start() >= MIN_ACCESS]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(raw) if m.end() - m.start() >= MIN_HEX]
    return found


def is_novel(raw: bytes, start: int, end: int, known: Lexicon) -> bool:
    text = raw[start:end]
    if end - start < MIN_CANDIDATE or not re.search(rb"[A-Za-z0-9]", text) or model_share(text, known) < MIN_MODEL_SHARE:
        return False
    reach = SURROUNDINGS + len(text)
    before, after = raw[max(0, start - reach) : start], raw[end : end + reach]
    parts = {text, *(x for x in re.split(rb"[.=]+", text) if len(x) >= MIN_CANDIDATE)}
    for part in sorted(parts, key=lambda x: (-len(x), x)):
        before, after = (x.replace(part, b" " * len(part)) for x in (before, after))
    return marginal_share(text, before[-SURROUNDINGS:] + after[:SURROUNDINGS], known) >= MIN_MARGINAL_SHARE


class Hints:
    """The context words of a text, in order."""

    def __init__(self, raw: bytes):
        spans = [m.span() for m in CONTEXT.finditer(raw)]
        self.starts, self.ends = [a for a, _ in spans], [b for _, b in spans]

    def beside(self, start: int, end: int, digits: bool) -> bool:
        """Whether one stands near enough to a candidate: on either side, for digits alone right before it."""
        last, following = bisect.bisect_right(self.ends, start) - 1, bisect.bisect_left(self.starts, end)
        if last >= 0 and start - self.ends[last] <= (DIGITS_REACH if digits else CONTEXT_REACH):
            return True
        return not digits and following < len(self.starts) and self.starts[following] - end <= CONTEXT_REACH

    def inside(self, start: int, end: int) -> list[tuple[int, int]]:
        """Those that lie in a run and leave something of it behind them."""
        at = slice(bisect.bisect_left(self.starts, start), bisect.bisect_left(self.ends, end))
        return list(zip(self.starts[at], self.ends[at], strict=False))


def novel_spans(raw: bytes, known: Lexicon | None = None) -> list[tuple[int, int, int]]:
    """(start, kind number, end) in bytes of incompressible strings in a sensitive context, and of private key blocks."""
    hints = Hints(raw)
    if not hints.starts:
        return []
    known = known or lexicon()
    found, past = [], 0
    for start, end in sorted({m.start(): m.end() for pattern in (CUT_PEM, PEM) for m in pattern.finditer(raw)}.items()):
        if start >= past:
            found.append((start, end))
            past = end

    def secret(start: int, end: int) -> bool:
        return end - start >= MIN_CANDIDATE and hints.beside(start, end, raw[start:end].isdigit()) and is_novel(raw, start, end, known)

    for pattern in (QUOTED, CANDIDATE):
        covered = iter(sorted(found))
        block = next(covered, None)
        for m in pattern.finditer(raw):
            start, end = m.span()
            while block and block[1] <= start:
                block = next(covered, None)
            if block and end > block[0]:
                continue
            if secret(start, end):
                found.append((start, end))
            elif pattern is CANDIDATE:  # behind the first context word that the run holds, between them, or between separators
                inside = hints.inside(start, end)
                if inside and secret(inside[0][1], end):
                    found.append((inside[0][1], end))
                    continue
                stops = [start, *[x for span in inside for x in span], end]
                for a, b in zip(stops[::2], stops[1::2], strict=True):
                    if a > start and secret(a, b):
                        found.append((a, b))
                    else:
                        found += [x.span() for x in PIECE.finditer(raw, a, b) if x.span() != (start, end) and secret(*x.span())]
    return [(a, 3, b) for a, b in sorted(found)]


def suspects(chunk) -> np.ndarray:
    """Documents of a chunk that can hold a span at all: a stem, AKIA, or a long hexadecimal run."""
    hit = np.zeros(len(chunk), dtype=bool)
    low, raw = LOWER[chunk.data].tobytes(), chunk.data.tobytes()
    for text, stems in ((low, STEMS), (raw, (b"AKIA",))):
        for stem in stems:
            at = text.find(stem)
            while at >= 0:
                doc = int(chunk.doc_of(np.array([at]))[0])
                hit[doc] = True
                at = text.find(stem, int(chunk.offsets[doc + 1]))
    edge = np.flatnonzero(np.diff(np.concatenate(([False], HEX_BYTE[chunk.data], [False])).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    long = end - start >= MIN_HEX  # a run over a document's end is only a reason to look
    for a, b in zip(start[long], end[long], strict=True):
        hit[chunk.doc_of(np.array([a]))[0] : chunk.doc_of(np.array([b - 1]))[0] + 1] = True
    return hit


def scan(raw: bytes, known: Lexicon | None = None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans and all spans, ordered, in code points."""
    base = base_spans(raw)
    spans = sorted(base + novel_spans(raw, known))
    points = {}
    last, count = 0, 0
    for at in sorted({x for s, _, e in spans for x in (s, e)}):
        count += sum(1 for b in raw[last:at] if b & 0xC0 != 0x80) if not raw[last:at].isascii() else at - last
        points[at], last = count, at
    move = lambda rows: [(points[s], k, points[e]) for s, k, e in rows]
    return move(sorted(base)), move(spans)


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


SCANNED = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words and their counts; a word may come more than once, so that a task holds little beyond one text's words."""
    send = lambda c: pa.record_batch([pa.array(list(c), pa.binary()), pa.array(list(c.values()), pa.int64())], names=["word", "n"])
    counts: Counter = Counter()
    for batch in batches:
        for chunk in chunks(batch.column("text")):
            for i in range(len(chunk)):
                counts.update(WORD.findall(chunk.raw(i)))
                if len(counts) >= COUNTED_AT_ONCE:
                    yield send(counts)
                    counts.clear()
    if counts:
        yield send(counts)


def learned_lexicon(docs: DataFrame, text: str = "text") -> Lexicon:
    """The lexicon with the most frequent words of a frame's texts: one pass over them, at most LEARNED_WORDS rows to the driver."""
    words = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(_count_words, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    top = words.filter(F.col("n") >= MIN_WORD_COUNT).orderBy(F.desc("n"), "word").limit(LEARNED_WORDS).collect()
    return lexicon(tuple(bytes(x.word) for x in top))


def _scan(known: Lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            counts, digest, spans = np.zeros((3, n), dtype=np.int64), [EMPTY_SHA] * n, [""] * n
            for chunk in chunks(batch.column("text")):
                for i in np.flatnonzero(suspects(chunk)).tolist():
                    base, every = scan(chunk.raw(i), known)
                    at = chunk.lo + i
                    for _, kind, _ in base:
                        counts[kind, at] += 1
                    digest[at], spans[at] = hashlib.sha256(written(base).encode()).hexdigest(), written(every)
            yield pa.record_batch([batch.column("doc_id"), *map(pa.array, counts), pa.array(digest, pa.string()), pa.array(spans, pa.string())], names=[x.split()[0] for x in SCANNED.split(", ")])

    return run


def secret_spans(docs: DataFrame) -> DataFrame:
    """One row for each document: counts of the fixed patterns, and all spans."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(_scan(learned_lexicon(docs)), SCANNED)


def redacted(raw: bytes, known: Lexicon | None = None, mark: bytes = b"[SECRET]") -> bytes:
    out, at = [], 0
    for s, _, e in sorted(base_spans(raw) + novel_spans(raw, known)):
        if e > at:
            out += [raw[at : max(at, s)], mark] if s >= at else []
            at = e
    return b"".join([*out, raw[at:]])


def _redact(text: str, count: str | None, known: Lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(text)
            values = {}
            for chunk in chunks(column):
                for i in np.flatnonzero(suspects(chunk)).tolist():
                    raw = chunk.raw(i)
                    new = redacted(raw, known)
                    if new != raw:
                        values[chunk.lo + i] = new.decode()
            if values:
                names, columns = batch.schema.names, list(batch.columns)
                changed = column.to_pylist()
                for i, new in values.items():
                    changed[i] = new
                columns[names.index(text)] = pa.array(changed, column.type)
                if count is not None:
                    sizes = batch.column(count).to_pylist()
                    for i, new in values.items():
                        sizes[i] = len(new)
                    columns[names.index(count)] = pa.array(sizes, batch.column(count).type)
                batch = pa.record_batch(columns, names=names)
            yield batch

    return run


def redact_secrets(docs: DataFrame, text: str = "text", count: str | None = None) -> DataFrame:
    """The same rows and columns, every span replaced by [SECRET]; `count` names a column with the text's length, kept right."""
    return docs.mapInArrow(_redact(text, count, learned_lexicon(docs, text)), docs.schema)


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_spans(read_table(spark, sf_dir, "documents"))
