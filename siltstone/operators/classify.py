"""Language, framework, runtime and role of a source text.

Each classifier is one expression over a text and its file name: no join, no
shuffle. Rules score, the best score wins, and the earlier rule wins a tie.
Every pattern is evaluated once: the numbers of those that match are bound, and
scores and signals are read off the numbers.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siltstone.functions.regex import Pattern, constant_rows, constants, hits, let, within
from siltstone.functions.text import extension
from siltstone.rules import artifact as A
from siltstone.rules import framework as W
from siltstone.rules import language as L
from siltstone.rules import runtime as R


def sample(text: Column, chars: int) -> Column:
    """P13."""
    return F.substring(text, 1, chars)


def detect_language(content: Column, filename: Column) -> Column:
    """struct(name, confidence, detected_via)."""
    name, ext, low = F.coalesce(filename, F.lit("")), extension(filename), F.lower(filename)
    found = [(n, c, "extension") for _, n, c in L.EXTENSIONS]
    by_extension = F.when(name != "", F.array_position(constants([e for e, *_ in L.EXTENSIONS]), ext).cast("int") - 1)
    docker = (low == "dockerfile") | low.endswith("/dockerfile")
    place = F.when(by_extension >= 0, by_extension).when(docker, len(found)).otherwise(_language_of_text(sample(content, L.SAMPLE), len(found) + 1))
    found += [("Dockerfile", L.DOCKERFILE_CONFIDENCE, "extension")] + [(n, L.SHEBANG_CONFIDENCE, "shebang") for _, n in L.SHEBANGS]
    for n, c, _, _ in L.HEURISTICS:
        found += [(n, c, "syntax-heuristic"), (n, c * L.WEAK_FACTOR, "keyword")]
    return F.get(constant_rows(["name", "confidence", "detected_via"], [*found, ("Unknown", L.UNKNOWN_CONFIDENCE, "fallback")]), place)


def _language_of_text(text: Column, first: int) -> Column:
    """The number of the first rule that the text meets, from `first` on; past the last one without any."""
    rules = [f"startswith(t, '#!') AND {Pattern(source).condition()}" for source, _ in L.SHEBANGS]
    for _, _, strong, weak in L.HEURISTICS:
        rules += [" AND ".join(Pattern(*p).condition() for p in strong), " OR ".join(Pattern(*p).condition() for p in weak)]
    return within(text, "CASE " + " ".join(f"WHEN {r} THEN {first + i}" for i, r in enumerate(rules)) + f" ELSE {first + len(rules)} END")


def _spans(counts: list[int]) -> list[tuple[int, int]]:
    """For each rule the numbers of its patterns, first and past the last."""
    out, at = [], 0
    for n in counts:
        out.append((at, at + n))
        at += n
    return out


def _within(found: Column, span: tuple[int, int]) -> Column:
    return F.filter(found, lambda x: (x >= span[0]) & (x < span[1]))


def _best(scores: list[Column]) -> Column:
    """struct(score, order) of the greatest score, the first of them on a tie; null without any."""
    return F.array_max(F.array(*[F.when(s.isNotNull(), F.struct(s.alias("score"), F.lit(-i).alias("order"))) for i, s in enumerate(scores)]))


def _stepped(count: Column, base: float, step: float, most: float) -> Column:
    return F.when(count > 0, F.least(F.lit(most), F.lit(base) + (count - 1) * F.lit(step)))


def _named_by(order: Column, names: list[str]) -> Column:
    return F.get(constants(names), -order)


def _ruled(text: Column, rules: list[tuple], kind: str, adjust) -> Column:
    """struct(kind, confidence, signals) of the best rule, or null; adjust(name, most, score) is the score with what the file name adds."""
    spans = _spans([len(r[4]) for r in rules])
    labels = [label for r in rules for _, label in r[4]]

    def choose(found: Column) -> Column:
        scores = [adjust(name, most, _stepped(F.size(_within(found, span)), base, step, most)) for (name, base, step, most, _), span in zip(rules, spans, strict=True)]

        def describe(best: Column) -> Column:
            low, high = (F.get(constants([s[i] for s in spans]), -best["order"]) for i in (0, 1))
            signals = F.transform(F.filter(found, lambda x: (x >= low) & (x < high)), lambda x: F.get(constants(labels), x))
            return F.when(best.isNotNull(), F.struct(_named_by(best["order"], [r[0] for r in rules]).alias(kind), best["score"].alias("confidence"), signals.alias("signals")))

        return let(_best(scores), describe)

    return let(hits(text, [Pattern(p) for r in rules for p, _ in r[4]]), choose)


def detect_framework(content: Column, filename: Column) -> Column:
    """struct(name, confidence, signals) or null."""
    route = F.lower(filename).isin(W.NEXT_ROUTE_FILES)

    def adjust(name: str, most: float, score: Column) -> Column:
        return F.when(route, F.least(F.lit(W.NEXT_ROUTE_CAP), score + W.NEXT_ROUTE_BONUS)).otherwise(score) if name == "Next.js" else score

    def choose(text: Column) -> Column:
        # least() skips nulls, so a rule without a match must stay without a score
        return _ruled(text, W.RULES, "name", lambda name, most, score: F.when(score.isNotNull(), adjust(name, most, score)))

    return let(sample(content, W.SAMPLE), choose)


def detect_runtime(content: Column, filename: Column) -> Column:
    """struct(type, confidence, signals) or null."""
    low = F.lower(filename)

    def adjust(name: str, most: float, plain: Column) -> Column:
        score = plain
        for runtime, how, part, bonus in reversed(R.FILENAME_BONUS):
            if runtime == name:
                hit = low.contains(part) if how == "contains" else low.endswith(part)
                score = F.when(hit, F.least(F.lit(R.BONUS_CAP), plain + bonus)).otherwise(score)
        return F.when(plain.isNotNull(), F.least(F.lit(most), score))

    return let(sample(content, R.SAMPLE), lambda text: _ruled(text, R.RULES, "type", adjust))


def classify_artifact(content: Column, filename: Column) -> Column:
    """C4: struct(type, confidence) or null."""
    name = F.coalesce(filename, F.lit(""))
    by_name, by_text = (_spans([len(r[i]) for r in A.RULES]) for i in (4, 5))

    def choose(named: Column, found: Column) -> Column:
        scores = []
        for (_, base, step, most, *_), n, t in zip(A.RULES, by_name, by_text, strict=True):
            from_name = F.when((F.size(_within(named, n)) > 0) & (name != ""), F.lit(base + A.FILENAME_BONUS))
            scores.append(F.greatest(from_name, _stepped(F.size(_within(found, t)), base, step, most)))
        kinds = [r[0] for r in A.RULES]
        return let(_best(scores), lambda b: F.when(b["score"] >= A.LEAST, F.struct(_named_by(b["order"], kinds).alias("type"), F.least(F.lit(A.FINAL_CAP), b["score"]).alias("confidence"))))

    names = hits(name, [Pattern(*p) for r in A.RULES for p in r[4]])
    texts = let(sample(content, A.SAMPLE), lambda text: hits(text, [Pattern(*p) for r in A.RULES for p in r[5]]))
    return let(F.struct(names.alias("named"), texts.alias("found")), lambda x: choose(x["named"], x["found"]))
