"""Findings: scores, category counts, places in the source, pins and snippets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.regex import Pattern, let
from siltstone.functions.text import escape_html, lookup, unescape_html
from siltstone.rules import limits as R

LINE_WORD, LINE_NUMBER = Pattern(r"(?:line|L)\s*(\d+)", "i"), Pattern(r"^(\d+)$")


def deduction(severity: Column) -> Column:
    return lookup(severity, R.DEDUCTIONS, F.lit(R.DEFAULT_DEDUCTION))


def bucket(category: Column) -> Column:
    """A4: sec, scale, and arch for everything else."""
    return F.when(category == "security", "sec").when(category.isin("scalability", "performance"), "scale").otherwise("arch")


def bar_width(count: Column) -> Column:
    """A3, in percent."""
    return F.least(F.lit(100.0), count / F.lit(5.0) * 100)


def scores(artifacts: DataFrame, findings: DataFrame, key: str = "artifact_id", reasoning: bool = False) -> DataFrame:
    """A1 and A2 for every artifact, those without findings too. One shuffle, summed before it."""
    kinds = lambda *names: F.count_if(F.col("category").isin(*names))
    summed = findings.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_findings"), F.sum(deduction(F.col("severity"))).alias("deduction"),
        kinds("architecture", "maintainability", "general").alias("arch_count"), kinds("security").alias("sec_count"), kinds("scalability", "performance").alias("scale_count"),
    )
    out = artifacts.select(key).distinct().join(summed, key, "left").na.fill(0, ["n_findings", "deduction", "arch_count", "sec_count", "scale_count"])
    none = F.col("n_findings") == 0
    score = F.when(none, 100).otherwise(F.greatest(F.lit(R.LEAST_SCORE), 100 - F.col("deduction"))).cast("int")
    grade, status = None, None
    for least, g, s in R.GRADES:
        grade = F.when(score >= least, g) if grade is None else grade.when(score >= least, g)
        status = F.when(score >= least, s) if status is None else status.when(score >= least, s)
    return out.select(
        key, "n_findings", score.alias("score"), F.when(none, R.NO_GRADE).otherwise(grade).alias("grade"),
        F.when(none, R.ANALYZING if reasoning else R.WAITING).otherwise(status).alias("status"), "arch_count", "sec_count", "scale_count",
        *[bar_width(F.col(f"{b}_count")).alias(f"{b}_width") for b in ("arch", "sec", "scale")],
    )


def source_lines(content: Column) -> Column:
    """The escaped lines of a source text as an array."""
    return F.transform(F.split(content, "\r?\n", -1), escape_html)


def plain_text(content: Column) -> Column:
    """What evidence is looked for in, lines and all: lower case, quotes as they are escaped on the page."""
    return F.lower(unescape_html(escape_html(content), quotes=False))


def evidence_line(evidence: Column, lines: Column) -> Column:
    """A line named in the evidence, else the first line that holds one of its texts; null if neither."""

    def named(e: Column) -> Column:
        number = lambda p: F.nullif(F.regexp_extract(e, p.java, 1), F.lit(""))
        return F.coalesce(number(LINE_WORD), number(LINE_NUMBER)).try_cast("bigint")

    def held(e: Column, plain: Column) -> Column:
        hit = F.array_position(F.transform(plain, lambda x: x.contains(F.lower(e))), F.lit(True))
        return F.when((F.length(e) > 5) & (hit > 0), hit)

    first = lambda rows: F.get(F.filter(rows, lambda x: x.isNotNull()), F.lit(0))
    normal = F.transform(lines, lambda x: F.lower(unescape_html(x, quotes=False)))
    return F.coalesce(first(F.transform(evidence, named)), let(normal, lambda plain: first(F.transform(evidence, lambda e: held(e, plain)))))


def code_snippet(line: Column, evidence: Column, lines: Column) -> Column:
    """The line with its neighbours, else the evidence."""
    known = F.coalesce(line.between(1, F.size(lines)), F.lit(False))
    start = F.greatest(line - 1, F.lit(1)).cast("int")
    around = F.transform(F.slice(lines, start, (F.least(line + 1, F.size(lines)) - start + 1).cast("int")), lambda x: unescape_html(x))
    return F.when(known, F.array_join(around, "\n")).otherwise(F.array_join(evidence, "\n"))


def pins(findings: DataFrame, key: str = "artifact_id", line: str = "line") -> DataFrame:
    """For each artifact a map from line to its last finding; of two with one number, the later severity by name."""
    last = F.struct("severity", F.concat(F.lit("f-"), F.col("idx").cast("string")).alias("id"))
    rows = findings.filter(F.col(line).isNotNull() & (F.col(line) != 0)).groupBy(key, line).agg(F.max_by(last, F.struct("idx", "severity")).alias("pin"))
    return rows.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(line), F.col("pin"))))).alias("pins"))
