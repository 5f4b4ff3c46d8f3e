"""Patterns written in JavaScript's dialect, for Java (Spark) and RE2 (DuckDB).

What differs between the dialects is spelled out: white space is the explicit
Unicode class JavaScript uses, a dot stops at the four line ends, anchors mean
the same places, and in Java a word boundary is ASCII. Documented residue: RE2
has no look-behind, so its multi-line anchors know the line feed only, and its
case-insensitive matching folds Unicode.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"\t-\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
LINE_END = r"\n\r\x{2028}\x{2029}"
WORD = set("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_")


def _boundary(before: str | None, after: str | None) -> str:
    """Java's \\b knows Unicode; this one is ASCII, and shorter where a neighbour is a known word character."""
    if after in WORD:
        return r"(?<!\w)"
    if before in WORD:
        return r"(?!\w)"
    return r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"


def translate(source: str, flags: str = "", java: bool = True) -> str:
    out, i, literal = [], 0, None
    while i < len(source):
        c = source[i]
        if c == "\\":
            e = source[i + 1]
            i += 2
            if e == "b":
                following = source[i] if i < len(source) and source[i + 1 : i + 2] not in ("?", "*", "{") else None
                out.append(_boundary(literal, following) if java else r"\b")
            elif e in "sS":
                out.append(f"[{'^' if e == 'S' else ''}{SPACE}]")
            else:
                out.append("/" if e == "/" else "\\" + e)
            literal = None
            continue
        if c == "[":
            end, body = i + 1, []
            while source[end] != "]":
                if source[end] == "\\":
                    body.append(source[end : end + 2])
                    end += 2
                else:
                    body.append(source[end])
                    end += 1
            i = end + 1
            literal = None
            if body == [r"\s", r"\S"]:
                out.append(r"(?s:.)")
                continue
            inner = "".join(SPACE if b == r"\s" else "/" if b == r"\/" else r"\[" if b == "[" else b for b in body)
            out.append(f"[{inner}]")
            continue
        i += 1
        if c == ".":
            out.append(f"[^{LINE_END}]")
        elif c == "^":
            out.append(rf"(?:\A|(?<=[{LINE_END}]))" if "m" in flags and java else "(?m:^)" if "m" in flags else r"\A")
        elif c == "$":
            out.append(rf"(?=[{LINE_END}]|\z)" if "m" in flags and java else "(?m:$)" if "m" in flags else r"\z")
        else:
            out.append(c)
        literal = c if c in WORD and source[i : i + 1] not in ("?", "*", "{") else None
    return ("(?i)" if "i" in flags else "") + "".join(out)


def _closing(source: str, i: int) -> int:
    """Where the group or class that opens at i closes."""
    depth, j = 0, i
    while True:
        c = source[j]
        if c == "\\":
            j += 2
            continue
        if c == "[":
            j += 1
            while source[j] != "]":
                j += 2 if source[j] == "\\" else 1
            if depth == 0:
                return j
        elif c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
            if depth == 0:
                return j
        j += 1


def _branches(source: str) -> list[str]:
    out, i, start = [], 0, 0
    while i < len(source):
        if source[i] == "\\":
            i += 2
        elif source[i] in "([":
            i = _closing(source, i) + 1
        elif source[i] == "|":
            out.append(source[start:i])
            i = start = i + 1
        else:
            i += 1
    return [*out, source[start:]]


def _sequence(source: str) -> list[set[str]]:
    """Sets of texts, from each of which every match of this branch holds one."""
    found, run, i = [], "", 0

    def flush():
        nonlocal run
        if run:
            found.append({run})
        run = ""

    while i < len(source):
        c, inner = source[i], None
        if c == "\\":
            letter, j = source[i + 1], i + 2
            text = None if letter.isalnum() else letter
            if letter == "b":
                i = j
                continue
        elif c in "([":
            j = _closing(source, i) + 1
            text = None
            if c == "(" and source[i + 1 : i + 3] in ("?=", "?!", "?<"):
                raise ValueError(f"look-around is not used in rules: {source}")
            if c == "(":
                inner = source[i + 1 : j - 1].removeprefix("?:")
        else:
            j, text = i + 1, None if c in ".^$" else c
        optional = source[j : j + 1] in ("?", "*")
        repeated = source[j : j + 1] in ("+", "{")
        if source[j : j + 1] == "{":
            optional, j = source[j + 1] == "0", source.index("}", j)
        if optional or repeated:
            j += 2 if source[j + 1 : j + 2] == "?" else 1
        if text is not None and not optional and not repeated:
            run += text
        else:
            if text is not None and repeated and not optional:
                run += text
            flush()
            if inner is not None and not optional:
                found.append(needles(inner))
        i = j
    flush()
    return [x for x in found if x]


def needles(source: str) -> set[str]:
    """Texts of which every match of the pattern holds at least one; empty if there is no such set.

    Of the sets that a branch offers the one whose shortest text is longest is taken.
    """
    out: set[str] = set()
    for branch in _branches(source):
        offered = _sequence(branch)
        if not offered:
            return set()
        out |= max(offered, key=lambda x: (min(map(len, x)), -len(x)))
    return out


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


@dataclass(frozen=True)
class Pattern:
    source: str
    flags: str = ""

    @property
    def java(self) -> str:
        return translate(self.source, self.flags, True)

    @property
    def re2(self) -> str:
        return translate(self.source, self.flags, False)

    def condition(self, name: str = "t") -> str:
        """SQL that tests the text called `name`; plain searches for the needles come first, as most texts hold none."""
        some, hay = needles(self.source), f"lower({name})" if "i" in self.flags else name
        found = f"{name} RLIKE {quoted(self.java)}"
        if not some or len(some) > 12:
            return f"({found})"
        gate = " OR ".join(f"contains({hay}, {quoted(x)})" for x in sorted({x.lower() for x in some} if "i" in self.flags else some))
        return f"(({gate}) AND {found})"

    def test(self, text: Column) -> Column:
        return within(text, self.condition())

    def groups(self, text: Column) -> Column:
        """The first group of every match, in order."""
        return F.regexp_extract_all(text, F.lit(self.java), F.lit(1))


def quoted(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _constant(value) -> str:
    if value is None:
        return "CAST(NULL AS STRING)"
    return quoted(value) if isinstance(value, str) else f"{value!r}D" if isinstance(value, float) else str(value)


def constants(values: list) -> Column:
    """A fixed array of texts or numbers, parsed at once."""
    return F.expr(f"array({', '.join(map(_constant, values))})")


def constant_rows(names: list[str], rows: list[tuple]) -> Column:
    """A fixed array of structs, parsed at once."""
    each = [f"named_struct({', '.join(f'{quoted(n)}, {_constant(v)}' for n, v in zip(names, row, strict=True))})" for row in rows]
    return F.expr(f"array({', '.join(each)})")


def within(text: Column, sql: str) -> Column:
    """SQL over the name t, bound to the text: large rule tables are parsed at once and evaluate the text once."""
    return F.get(F.call_function("transform", F.array(text), F.expr(f"t -> {sql}")), F.lit(0))


def hits(text: Column, patterns: list[Pattern]) -> Column:
    """The numbers of the patterns that occur, ascending; each is evaluated once. Bind it with let()."""
    cases = ", ".join(f"CASE WHEN {p.condition()} THEN {i} END" for i, p in enumerate(patterns))
    return within(text, f"filter(array({cases}), x -> x IS NOT NULL)")


def first_hits(text: Column, groups: list[list[Pattern]]) -> Column:
    """For each group the number of its first pattern that occurs, or null; later ones of the group are not evaluated."""
    cases = ", ".join("CASE " + " ".join(f"WHEN {p.condition()} THEN {i}" for i, p in enumerate(g)) + " END" for g in groups)
    return within(text, f"array({cases})")


def escape(text: str) -> str:
    return "".join("\\" + c if c in r".*+?^${}()|[]\\" else c for c in text)


#: The characters of SPACE.
SPACES = "\t\n\v\f\r \xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"


def trim(text: Column) -> Column:
    """Without white space at both ends, in one pass from each end: a pattern would start anew at every blank."""
    return F.trim(text, F.lit(SPACES))


def trim_end(text: Column) -> Column:
    return F.rtrim(text, F.lit(SPACES))
