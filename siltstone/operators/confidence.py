"""Overall confidence, clarification questions and the summary line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.text import lookup, percent, three_decimals
from siltstone.operators.classify import classify_artifact, detect_framework, detect_language, detect_runtime
from siltstone.operators.extract import extract_dependencies, extract_signals
from siltstone.rules import artifact as A
from siltstone.rules import questions as Q
from siltstone.rules import runtime as R


def raw_confidence(language: Column, framework: Column, runtime: Column, artifact: Column) -> Column:
    """The weighted sum, left to right; what is absent counts as 0.35."""
    parts = [language, *[F.coalesce(c, F.lit(Q.ABSENT)) for c in (framework, runtime, artifact)]]
    total = parts[0] * F.lit(Q.WEIGHTS[0][1])
    for part, (_, weight) in zip(parts[1:], Q.WEIGHTS[1:], strict=True):
        total = total + part * F.lit(weight)
    return total


def clarification_questions() -> Column:
    """K3, over the columns of understand()."""
    language, framework, runtime = F.col("language"), F.col("framework"), F.col("runtime")
    has = lambda name: F.exists("signals", lambda s: s["name"] == name)
    scripted = language["name"].contains("TypeScript") | language["name"].contains("JavaScript") | language["name"].contains("Python")
    asked = {
        1: language["confidence"] < 0.55,
        2: framework.isNull() & (language["confidence"] > 0.50) & scripted,
        3: runtime.isNull() | ((runtime["confidence"] < 0.65) & (runtime["type"] != "edge")),
        4: has("authentication") & framework.isNull(),
        5: has("database") & ~F.coalesce(framework["name"].isin("Prisma", "Mongoose"), F.lit(False)),
        6: F.col("artifact_type").isNull() & (F.col("overall_confidence") < 0.70),
        7: F.col("overall_confidence") < 0.50,
    }
    rows = [F.when(asked[p], F.struct(F.lit(p).alias("priority"), F.lit(q).alias("question"), F.lit(r).alias("reason"))) for p, q, r in Q.QUESTIONS]
    some = F.slice(F.array_sort(F.filter(F.array(*rows), lambda x: x.isNotNull())), 1, Q.MOST)
    some = F.transform(some, lambda x: F.struct(x["question"].alias("question"), x["reason"].alias("reason")))
    return F.when(F.col("requires_clarification"), some).otherwise(F.array().cast("array<struct<question:string,reason:string>>"))


def summary() -> Column:
    """P11, over the columns of understand()."""
    kind, runtime = F.col("artifact_type")["type"], F.col("runtime")["type"]
    note = F.when(F.col("requires_clarification"), " — clarification needed").otherwise("")
    return F.concat_ws(
        " ", F.coalesce(lookup(kind, A.LABELS, kind), F.lit("Code file")), F.concat(F.lit("in "), F.col("language")["name"]), F.concat(F.lit("using "), F.col("framework")["name"]),
        F.concat(F.lit("("), lookup(runtime, R.LABELS, runtime), F.lit(" runtime)")), F.concat(F.lit("· "), percent(F.col("overall_confidence")), F.lit(" confidence"), note),
    )


def understand(df: DataFrame, content: str = "content", filename: str = "filename") -> DataFrame:
    """The understanding row: every classifier and extractor beside the input's columns, without a shuffle."""
    text, name = F.coalesce(F.col(content), F.lit("")), F.col(filename)
    out = df.withColumns({"language": detect_language(text, name), "framework": detect_framework(text, name), "runtime": detect_runtime(text, name), "artifact_type": classify_artifact(text, name), "signals": extract_signals(text)})
    out = out.withColumn("dependencies", extract_dependencies(text, F.col("language.name")))
    out = out.withColumn("raw_confidence", raw_confidence(*[F.col(f"{c}.confidence") for c in ("language", "framework", "runtime", "artifact_type")]))
    out = out.withColumns({"overall_confidence": F.least(F.lit(1.0), three_decimals("raw_confidence")), "requires_clarification": F.col("raw_confidence") < Q.CLARIFY_BELOW})
    return out.withColumns({"questions": clarification_questions(), "summary": summary()}).drop("raw_confidence")
