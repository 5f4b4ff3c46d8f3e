"""R2: findings of a review while its JSON is still being written.

A review arrives as chunks of one JSON object with an array `findings`. After
every chunk the partial object counts: findings that are complete, and the one
that is being written with what is known of it so far, cut words included. Its
part in score and counts is taken back and given anew as its category and
severity grow ("hig" deducts what an unknown severity does, "high" 15).

`Partial` is the parser: it reads each character once and keeps a state of
bounded size (depth, lexer, the key and word being read, the open finding, and
counts of the closed ones), which a stream stores between micro-batches.

In batch many reviews are read at once (`progress_batches`); one that goes on
from an earlier batch or range starts behind a text that leads to its state, and
what needs the parser itself is read by it.

In batch a review with a large part of all chunks is cut into ranges. What a
range does to the lexer and the depth is a small table, and tables compose
(`LEXER`); with its entry depth known, a range finds the state it leaves from
the last finding that starts in it, without what came before; then every range
is parsed at once. Only a single finding longer than a range is followed from
range to range.

Defined cases: null chunks are empty; chunks of equal number are taken in order
of their text; text after the object's end changes nothing; a broken object
keeps its last counts; only objects count as findings; null keys are one review.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, LongType, StructField

from siltstone.operators.progress_batches import PADDING, Reviews
from siltstone.operators.ranges import RANGE_ROWS, Fold, Ranges, Seeds
from siltstone.rules import limits as R

OUT, STRING, ESCAPE = range(3)
ARCH, SEC, SCALE = ("architecture", "maintainability", "general"), ("security",), ("scalability", "performance")
#: Raw characters kept of a key or a word; every known one is shorter, also with each character escaped.
LONGEST = 240
STRUCTURE, IN_STRING, CUT_ESCAPE = re.compile(r'["{}\[\],:]'), re.compile(r'["\\]'), re.compile(r"\\(u[0-9a-fA-F]{0,3})?$")
DEDUCTIONS = dict(R.DEDUCTIONS)
MADE = [StructField("n_findings", LongType()), StructField("n_complete", LongType()), StructField("score", IntegerType()), StructField("arch_count", LongType()), StructField("sec_count", LongType()), StructField("scale_count", LongType()), StructField("done", BooleanType())]


def _decoded(raw: str) -> str:
    """The characters of a string as far as they are there."""
    if "\\" not in raw:
        return raw
    whole = raw
    ends = len(raw) - len(raw.rstrip("\\"))
    if ends % 2 or (ends == 0 and (cut := CUT_ESCAPE.search(raw)) and (cut.start() - len(raw[: cut.start()].rstrip("\\"))) % 2 == 0):
        whole = raw[: CUT_ESCAPE.search(raw).start()]
    try:
        return json.loads(f'"{whole}"', strict=False)
    except ValueError:
        return whole


class Partial:
    """A prefix of a review. Depth 1 is the object, 2 one of its members, 3 an element of that."""

    NAMES = ("lexer", "depth", "at_key", "root", "listed", "field", "word", "category", "severity", "n", "deduction", "arch", "sec", "scale", "done")

    def __init__(self, state: str | bytes | None = None):
        given = json.loads(state) if state else (OUT, 0, False, None, False, None, None, None, None, 0, 0, 0, 0, 0, False)
        for name, value in zip(self.NAMES, given, strict=True):
            setattr(self, name, value)

    def state(self) -> str:
        return json.dumps([getattr(self, n) for n in self.NAMES])

    def resumed(self) -> str | None:
        """A text after which a new parser goes on as this one does, counts aside; None if it is not found."""
        text = "{}" if self.done else ""
        if not self.done and self.depth > 0:
            text = "{" if self.root is None else f'{{"{self.root}"'
            if self.depth == 1:
                text += ":" if not self.at_key else "" if self.root is None else ":0,"
            else:
                text += ":[" if self.listed else ":{"
            if self.depth >= 3:
                text += "[" if self.field == "" else "{"
                text += "".join(f'"{name}":"{value}",' for name, value in (("category", self.category), ("severity", self.severity)) if value is not None)
                if self.field:
                    text += f'"{self.field}"' + ("" if self.depth == 3 and self.at_key else ":")
                text += "[" * (self.depth - 3)
        if self.lexer != OUT and not self.done:
            text += '"' + ("\\" * (self.lexer == ESCAPE) if self.word is None else self.word)
        return text if Partial().feed(text)._ahead() == self._ahead() else None

    def _ahead(self) -> tuple:
        """What later text depends on, counts aside."""
        if self.done:
            return (True,)
        object_ = (self.root,) if self.depth >= 1 else ()
        finding = (self.field, self.category, self.severity) if self.depth >= 3 else ()
        return self.lexer, self.depth, self.depth in (1, 3) and self.at_key, object_, self.depth >= 2 and self.listed, finding, self.word

    # --- reading ---

    def feed(self, text: str | None) -> Partial:
        at, end = 0, len(text or "")
        while at < end and not self.done:
            if self.lexer == OUT:
                m = STRUCTURE.search(text, at)
                if not m:
                    break
                at = m.end()
                self._structure(m[0])
                continue
            start = at
            if self.lexer == ESCAPE:
                self.lexer, at = STRING, at + 1
            m = IN_STRING.search(text, at)
            at = m.end() if m else end
            closing = bool(m) and m[0] == '"'
            if self.word is not None and len(self.word) < LONGEST:
                self.word += text[start : at - closing][: LONGEST - len(self.word)]
            if closing:
                self._close_string()
            elif m:
                self.lexer = ESCAPE
        return self

    def _wanted(self) -> bool:
        """Whether the string that opens is a key or a word that counts."""
        return (self.depth in (1, 3) and self.at_key) or (self.depth == 3 and self.field in ("category", "severity"))

    def _close_string(self) -> None:
        self.lexer = OUT
        if self.word is None:
            return
        value, self.word = _decoded(self.word), None
        if not self.at_key:
            setattr(self, self.field, value)
        elif self.depth == 1:
            self.root = value[:20]
        else:
            self.field = value[:20]

    def _structure(self, c: str) -> None:
        if c == '"':
            self.lexer, self.word = STRING, "" if self._wanted() else None
        elif c in "{[":
            self.depth += 1
            if self.depth == 2:
                self.listed = c == "["
            if self.depth in (1, 3):
                self.at_key = c == "{"
            if self.depth == 3:
                self.field, self.category, self.severity = (None, None, None) if c == "{" else ("", None, None)
        elif c in "}]":
            if self.depth == 3 and self.open:
                self._count(1)
            self.depth -= 1
            if self.depth <= 3:
                self.at_key = False
            self.done = self.depth <= 0
        elif self.depth in (1, 3):
            self.at_key = c == "," and self.field != "" if self.depth == 3 else c == ","
            if c == "," and self.depth == 3 and self.field != "":
                self.field = None

    # --- counting ---

    @property
    def open(self) -> bool:
        """Whether an object of the findings is being written; within an array of arrays the field is an empty text."""
        return self.depth >= 3 and self.listed and self.root == "findings" and self.field != ""

    def _count(self, by: int) -> None:
        self.n += by
        self.deduction += by * DEDUCTIONS.get(self.severity, R.DEFAULT_DEDUCTION)
        self.arch += by * (self.category in ARCH)
        self.sec += by * (self.category in SEC)
        self.scale += by * (self.category in SCALE)

    def counts(self) -> tuple:
        """n_findings, n_complete, score, the three counts, done; with the open finding as it stands."""
        if not self.open:
            return self._told(self.n)
        known = self.category, self.severity
        if self.word is not None and self.depth == 3 and not self.at_key:
            setattr(self, self.field, _decoded(self.word))
        complete = self.n
        self._count(1)
        told = self._told(complete)
        self._count(-1)
        self.category, self.severity = known
        return told

    def _told(self, complete: int) -> tuple:
        score = max(R.LEAST_SCORE, 100 - self.deduction) if self.n else 100
        return self.n, complete, score, self.arch, self.sec, self.scale, self.done


# --- ranges of a hot review --------------------------------------------------


class Lexer:
    """What text does to each of the three lexer states: where it leaves, and by how much the depth has changed."""

    def __init__(self, seed: bytes | None = None):
        self.table = json.loads(seed) if seed else [[x, 0] for x in (OUT, STRING, ESCAPE)]

    def feed(self, text: str | None) -> None:
        self.table = [_moved(text or "", *row) for row in self.table]

    def done(self) -> bytes:
        return json.dumps(self.table).encode()


def _moved(text: str, lexer: int, depth: int) -> list[int]:
    at, end = 0, len(text)
    while at < end:
        m = (STRUCTURE if lexer == OUT else IN_STRING).search(text, at + (lexer == ESCAPE))
        if lexer == ESCAPE:
            lexer = STRING
        if not m:
            break
        at, c = m.end(), m[0]
        if c == '"':
            lexer = STRING if lexer == OUT else OUT
        elif c == "\\":
            lexer = ESCAPE
        else:
            depth += (c in "{[") - (c in "}]")
    return [lexer, depth]


def compose(first: bytes, then: bytes) -> bytes:
    a, b = json.loads(first), json.loads(then)
    return json.dumps([[b[x][0], d + b[x][1]] for x, d in a]).encode()


INHERITED = "\0"


class Tail:
    """The state that a range leaves, found from the last place in it that needs no earlier text: a root member's end, or a finding's start."""

    def __init__(self, seed: bytes | None):
        lexer, depth = json.loads(seed)
        self.lexer, self.depth, self.parser = lexer, depth, None

    def feed(self, text: str | None) -> None:
        if self.parser is not None:
            self.parser.feed(text)
            return
        at, text = 0, text or ""
        while at < len(text):
            m = (STRUCTURE if self.lexer == OUT else IN_STRING).search(text, at + (self.lexer == ESCAPE))
            if self.lexer == ESCAPE:
                self.lexer = STRING
            if not m:
                return
            at, c = m.end(), m[0]
            if c in '"\\':
                self.lexer = ESCAPE if c == "\\" else STRING if self.lexer == OUT else OUT
                continue
            self.depth += (c in "{[") - (c in "}]")
            if (c == "{" and self.depth in (1, 3)) or (c == "," and self.depth == 1) or self.depth <= 0:
                self.parser = Partial()
                self.parser.depth, self.parser.at_key, self.parser.done = self.depth, True, self.depth <= 0
                if self.depth == 3:
                    self.parser.root, self.parser.listed = INHERITED, True
                self.parser.feed(text[at:])
                return

    def done(self) -> bytes:
        return self.parser.state().encode() if self.parser is not None else b""


def _member(before: Partial, after: Partial) -> Partial:
    """A left state whose root member began in an earlier range gets it from there."""
    if after.root == INHERITED:
        after.root, after.listed = before.root, before.listed
    return after


def _without_counts(state: Partial) -> Partial:
    state.n = state.deduction = state.arch = state.sec = state.scale = 0
    return state


def _entries(ranges: Ranges) -> Seeds:
    """The parser's state at the start of every range of the hot reviews, counts of closed findings included."""
    order, reads = ["at", "text"], ["text"]

    def feed(state, text) -> None:
        state.feed(text)

    before = ranges.prefixes(Fold(order, reads, [], Lexer, feed, Lexer.done), compose)
    tables = {place: json.loads(before[place])[OUT] if place in before else [OUT, 0] for place in ranges.places()}
    left = ranges.summaries(Fold(order, reads, [], Tail, feed, Tail.done), {p: json.dumps(t).encode() for p, t in tables.items()})
    follow = Fold(order, reads, [], Partial, feed, lambda s: s.state().encode())
    entry: dict = {}
    todo = ranges.places()
    while todo:
        ready = []
        for key, r in todo:
            if r == 0:
                entry[key, r] = Partial()
            elif (key, r - 1) in entry and left.get((key, r - 1)) != b"":
                came = entry[key, r - 1]
                entry[key, r] = _without_counts(_member(came, Partial(left[key, r - 1]))) if (key, r - 1) in left else Partial(came.state())
            if (key, r) in entry and left.get((key, r)) == b"":
                ready.append((key, r))
        todo = [p for p in todo if p not in entry]
        if ready:  # ranges within one finding: followed from the state that is now known
            left |= ranges.summaries(follow, {p: entry[p].state().encode() for p in ready}, set(ready))
    sums = ranges.summaries(follow, {p: s.state().encode() for p, s in entry.items()})
    seeds, so_far = {}, {}
    for key, r in ranges.places():
        have = so_far.setdefault(key, [0] * 5)
        start = entry[key, r]
        start.n, start.deduction, start.arch, start.sec, start.scale = have
        seeds[key, r] = start.state().encode()
        if (key, r) in sums:
            end = Partial(sums[key, r])
            so_far[key] = [a + b for a, b in zip(have, (end.n, end.deduction, end.arch, end.sec, end.scale), strict=True)]
    return seeds


def _told(state: Partial, text: str | None) -> tuple:
    return state.feed(text).counts()


#: Text from which on chunks are read one by one, in little memory.
LARGEST = 16_000_000
CATEGORIES = {name: code for code, names in enumerate((ARCH, SEC, SCALE), 1) for name in names}


def _told_all(opened: dict[int, Partial], first: np.ndarray, texts: pa.Array) -> tuple[list[np.ndarray], Partial]:
    """`_told` for all chunks of a batch of reviews, with the state that the last one leaves. `first`: the first chunk of each review; `opened`: the states of those that go on."""
    if texts.nbytes > LARGEST:
        return _told_each(opened, first, texts)
    given = {g: state.resumed() for g, state in opened.items()}
    data, offsets = _bytes(texts, {int(first[g]): (text or "").encode() for g, text in given.items()})
    reviews = Reviews(data, offsets, first, CATEGORIES, DEDUCTIONS, R.DEFAULT_DEDUCTION)
    n, complete, deduction, arch, sec, scale, done = reviews.told()
    stops = np.append(first[1:], len(texts))
    for g, state in opened.items():
        for column, more in ((n, state.n), (complete, state.n), (deduction, state.deduction), (arch, state.arch), (sec, state.sec), (scale, state.scale)):
            column[first[g] : stops[g]] += more
    score = np.where(n > 0, np.maximum(R.LEAST_SCORE, 100 - deduction), 100)
    columns = [n, complete, score, arch, sec, scale, done]
    left, last = None, len(first) - 1
    if not reviews.special[last] and given.get(last, "") is not None and len(reviews.f) and reviews.f_review[-1] == last:
        left = _from_finding(reviews, opened.get(last))
    for g in {*np.flatnonzero(reviews.special), *(g for g, text in given.items() if text is None)}:
        state = opened.get(g) or Partial()
        for i, text in enumerate(texts[first[g] : stops[g]].to_pylist(), first[g]):
            for column, value in zip(columns, _told(state, text), strict=True):
                column[i] = value
        left = state if g == last else left
    if left is None:
        left = opened.get(last) or Partial()
        for text in texts[first[last] :].to_pylist():
            left.feed(text)
    return columns, left


def _told_each(opened: dict[int, Partial], first: np.ndarray, texts: pa.Array) -> tuple[list[np.ndarray], Partial]:
    rows, state, starts = [], None, {int(row): g for g, row in enumerate(first)}
    for i in range(len(texts)):
        state = (opened.get(starts[i]) or Partial()) if i in starts else state
        rows.append(_told(state, texts[i].as_py()))
    return [np.array(c) for c in zip(*rows, strict=True)], state


def _bytes(texts: pa.Array, before: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all chunks with padding behind them, and their offsets; some chunks with a text before them."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    _, places, raw = texts.buffers()
    offsets = np.frombuffer(places, np.int64)[texts.offset : texts.offset + len(texts) + 1].copy()
    raw = np.frombuffer(raw or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets -= offsets[0]
    parts, at = [], 0
    starts = offsets.copy()
    for row in sorted(before):
        parts += [raw[at : starts[row]], np.frombuffer(before[row], np.uint8)]
        at = starts[row]
        offsets[row + 1 :] += len(before[row])
    return np.concatenate([*parts, raw[at:], np.zeros(PADDING, np.uint8)]), offsets


def _from_finding(reviews: Reviews, given: Partial | None) -> Partial:
    """The state that the last review leaves, from its last finding on: what is before it counts as closed."""
    state, own = Partial(), reviews.f_review == reviews.f_review[-1]
    own[-1] = False
    state.depth, state.at_key, state.root, state.listed = 3, True, "findings", True
    category = reviews.final["category"][own]
    closed = own.sum(), reviews.final["severity"][own].sum(), *((category == c).sum() for c in (1, 2, 3))
    before = (given.n, given.deduction, given.arch, given.sec, given.scale) if given else (0,) * 5
    state.n, state.deduction, state.arch, state.sec, state.scale = (int(a + b) for a, b in zip(closed, before, strict=True))
    return state.feed(bytes(reviews.data[reviews.f_pos[-1] + 1 : reviews.ends[-1]]).decode())


TOLD = Fold(["at", "text"], ["text"], ["at"], Partial, _told, many=_told_all)


def progressive_findings(chunks: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """R2 in batch over (key, at, text): after every chunk, findings so far, complete ones, score, category counts, and whether the review is done."""
    rows = chunks.select("key", "at", F.col("text").cast("string").alias("text"))
    ranges = Ranges(rows, range_rows)
    seeds = _entries(ranges) if ranges.hot else None
    return ranges.walk(TOLD, MADE, seeds)
