"""Capability signals, dependencies, and segments of a chat text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siltstone.functions.regex import SPACE, SPACES, Pattern, constants, first_hits, let, trim, trim_end
from siltstone.rules import signals as S

FENCE = Pattern(r"```(\w*)\n?([\s\S]*?)```")
SPAN = Pattern(r"\*\*[^*]+\*\*|`[^`]+`")


def extract_signals(content: Column) -> Column:
    """Array of struct(name, evidence), in rule order, the first matching evidence of each name."""
    most = max(len(patterns) for _, patterns in S.RULES)
    labels = constants([label for _, patterns in S.RULES for label in [*(p[2] for p in patterns), *[""] * (most - len(patterns))]])
    names = constants([name for name, _ in S.RULES])
    found = first_hits(content, [[Pattern(p, flags) for p, flags, _ in patterns] for _, patterns in S.RULES])
    signals = lambda first: F.transform(first, lambda x, i: F.struct(F.get(names, i).alias("name"), F.get(labels, i * most + x).alias("evidence")))
    return F.filter(let(found, signals), lambda s: s["evidence"].isNotNull())


#: What stands between the word import and the quote: word characters, these, and white space.
CLAUSE = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_*{}," + SPACES
#: Patterns that scan a run of blank lines once for each of its lines, and the same matches from the run's last line.
_BLANK = r"[ \t\x0B\f\u00a0\u1680\u2000-\u200a\u202f\u205f\u3000\ufeff]"
ONCE = {r"^\s+\"([^\"]+)\"\s*$": rf"^(?:{_BLANK}+|{_BLANK}*[\n\r\u2028\u2029])\"([^\"]+)\"\s*$"}
IMPORT = r"(?:\A|(?<!\w))import"


def _imported(content: Column) -> Column:
    """What the first dependency pattern finds, in time proportional to the text.

    The text is split at quotes. A piece announces the quoted piece after it if
    it ends in `import`, blanks and perhaps `type`, or in `import ... from`; only
    its end of characters that may stand there is looked at. A quoted piece that
    is used announces nothing itself.
    """
    pieces = F.split(content, "['\"]", -1)

    def announces(piece: Column) -> Column:
        end = F.substring(piece, F.length(F.rtrim(piece, F.lit(CLAUSE))) + 1, F.length(piece))
        before = F.length(F.regexp_replace(end, rf"(?<=[{SPACE}])from[{SPACE}]++\z", ""))
        listed = (before < F.length(end)) & F.substring(end, F.lit(1), F.greatest(before - 2, F.lit(0))).rlike(rf"{IMPORT}[{SPACE}]")
        return piece.contains("import") & (listed | end.rlike(rf"{IMPORT}[{SPACE}]++(?:type[{SPACE}]++)?\z"))

    def build(all_: Column) -> Column:
        last = F.size(all_) - 2  # pieces with a quote on both sides end before it
        tests = F.transform(all_, lambda x, i: (i < last) & announces(x) & (F.get(all_, i + 1) != ""))
        zero = F.struct(F.array().cast("array<string>").alias("found"), F.lit(-1).alias("used"))
        hits = F.filter(F.transform(tests, lambda t, i: F.when(t, i)), lambda i: i.isNotNull())
        step = lambda a, i: F.when(i == a["used"], a).otherwise(F.struct(F.concat(a["found"], F.array(F.get(all_, i + 1))).alias("found"), (i + 1).alias("used")))
        return F.aggregate(hits, zero, step)["found"]

    return F.when(content.contains("import"), let(pieces, build)).otherwise(F.when(content.isNotNull(), F.array().cast("array<string>")))


def extract_dependencies(content: Column, language: Column) -> Column:
    """Ordered by rule, then by place; first occurrences. A rule limited to Java also meets JavaScript."""
    low, none, lists = F.lower(language), F.array().cast("array<string>"), []
    for i, (source, flags, languages) in enumerate(S.DEPENDENCIES):
        values = F.transform(Pattern(ONCE.get(source, source), flags).groups(content) if i else _imported(content), trim)
        if languages:
            meets = F.lit(False)
            for name in languages:
                meets |= low.contains(name.lower())
            values = F.when(meets, values).otherwise(none)
        lists.append(values)
    return F.array_distinct(F.filter(F.concat(*lists), lambda x: x != ""))


def external_dependencies(dependencies: Column) -> Column:
    """E3."""

    def outside(d: Column) -> Column:
        keep = F.lit(True)
        for prefix in S.INTERNAL_PREFIXES:
            keep &= ~d.startswith(prefix)
        return keep

    return F.filter(dependencies, outside)


def _interleave(between: Column, at: Column) -> Column:
    """between[0], at[0], between[1], ... as one array."""
    return F.flatten(F.transform(between, lambda x, i: F.array(x, F.get(at, i))))


def content_segments(text: Column) -> Column:
    """Array of struct(type, content, lang); an unclosed fence is text. Fences are found by one split: every second piece is code, if a fence closes it."""
    none = F.lit(None).cast("string")

    def build(pieces: Column) -> Column:
        codes = F.floor((F.size(pieces) - 1) / 2).cast("int")
        at = lambda i: F.get(pieces, i)

        def pair(j: Column) -> Column:
            plain = F.when((j == codes) & (F.size(pieces) % 2 == 0), F.concat(at(2 * j), F.lit("```"), at(2 * j + 1))).otherwise(at(2 * j))
            lang = F.regexp_extract(at(2 * j + 1), r"\A\w*", 0)
            code = trim_end(F.regexp_replace(F.substring(at(2 * j + 1), F.length(lang) + 1, F.length(at(2 * j + 1))), r"\A\n", ""))
            return F.array(
                F.when(plain != "", F.struct(F.lit("text").alias("type"), plain.alias("content"), none.alias("lang"))),
                F.when(j < codes, F.struct(F.lit("code").alias("type"), code.alias("content"), F.coalesce(F.nullif(lang, F.lit("")), F.lit("text")).alias("lang"))),
            )

        return F.filter(F.flatten(F.transform(F.sequence(F.lit(0), codes), pair)), lambda s: s.isNotNull())

    return let(F.split(text, "```", -1), build)


def inline_spans(text: Column) -> Column:
    """E5: array of struct(kind, text); empty plain parts are kept as the split gives them."""
    parts = F.filter(_interleave(F.split(text, SPAN.java, -1), F.regexp_extract_all(text, F.lit(SPAN.java), F.lit(0))), lambda p: p.isNotNull())

    def span(p: Column) -> Column:
        bold = p.startswith("**") & p.endswith("**")
        code = p.startswith("`") & p.endswith("`")
        inner = lambda n: F.substring(p, F.lit(n + 1), F.greatest(F.length(p) - 2 * n, F.lit(0)))
        return F.struct(F.when(bold, "bold").when(code, "code").otherwise("text").alias("kind"), F.when(bold, inner(2)).when(code, inner(1)).otherwise(p).alias("text"))

    return F.transform(parts, span)
