"""Chat messages and prompt texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.functions.regex import trim
from siltstone.functions.text import fill
from siltstone.rules import texts as T


def message_text(parts: Column, content: Column) -> Column:
    """M1: the text parts if there are parts, else the content, else nothing."""
    texts = F.transform(F.filter(parts, lambda p: (p["type"] == "text") & p["text"].isNotNull()), lambda p: p["text"])
    return F.when(F.size(parts) > 0, F.array_join(texts, "")).otherwise(F.coalesce(content, F.lit("")))


def normalise_chat(messages: DataFrame, text: str = "text") -> DataFrame:
    """M2: user and assistant turns that are not blank."""
    return messages.filter(F.col("role").isin("user", "assistant") & (F.length(trim(F.coalesce(F.col(text), F.lit("")))) > 0))


def finding_block(finding: dict[str, Column]) -> Column:
    """M4. Keys: id, title, category, severity, explanation, recommendation, evidence (array), snippet."""
    bullets = F.array_join(F.transform(finding["evidence"], lambda e: F.concat(F.lit("  - "), e)), "\n")
    snippet = F.when(F.coalesce(finding["snippet"], F.lit("")) != "", fill(T.SNIPPET, snippet=finding["snippet"])).otherwise("")
    plain = {k: v for k, v in finding.items() if k not in ("evidence", "snippet")}
    return fill(T.FINDING_CONTEXT, **plain, evidence=F.when(F.size(finding["evidence"]) > 0, bullets).otherwise(T.NO_EVIDENCE), snippet=snippet)


def inject_context(messages: DataFrame, block: Column, key: str = "conv_id", order: str = "turn", text: str = "text") -> DataFrame:
    """M3: the block goes before the first turn, and only if that turn is the user's."""
    first = F.row_number().over(Window.partitionBy(key).orderBy(order)) == 1
    prefix = F.when(first & (F.col("role") == "user") & (block != ""), fill(T.BEFORE_TURN, block=block)).otherwise("")
    return messages.withColumn(text, F.concat(prefix, F.col(text)))


def reasoning_context(df: DataFrame) -> DataFrame:
    """M5, over ground()'s columns: signals, versions, APIs and sources as lines of text."""
    each = lambda c, f: F.transform(F.col(c), f)
    old = lambda a: F.when(a["deprecated"].isNotNull(), F.concat(F.lit(" (DEPRECATED in "), a["deprecated"], F.lit(")"))).otherwise("")
    return df.withColumns({
        "signal_lines": each("signals", lambda s: F.concat(s["name"], F.lit(" (Evidence: "), s["evidence"], F.lit(")"))),
        "version_lines": each("groundings", lambda g: F.concat(g["framework"], F.lit(": "), g["inference"]["label"])),
        "api_lines": each("detected_apis", lambda a: F.concat(F.lit("["), a["framework"], F.lit("] "), a["api"], F.lit(" (Introduced: "), a["introduced"], F.lit(")"), old(a), F.lit(" - "), a["description"])),
        "source_lines": each("grounding_sources", lambda s: F.concat(s["label"], F.lit(" - "), s["url"], F.lit(" ("), s["purpose"], F.lit(")"))),
    })


def context_text() -> Column:
    """M6, over reasoning_context()'s columns."""
    listed = lambda c: F.when(F.size(c) > 0, F.array_join(F.transform(F.col(c), lambda x: F.concat(F.lit("- "), x)), "\n")).otherwise("- None")
    return fill(
        T.UNDERSTANDING, summary=F.col("summary"), framework=F.coalesce(F.col("framework")["name"], F.lit("None/Unknown")), runtime=F.coalesce(F.col("runtime")["type"], F.lit("Unknown")),
        artifact=F.coalesce(F.col("artifact_type")["type"], F.lit("Unknown")), dependencies=F.when(F.size("dependencies") > 0, F.array_join("dependencies", ", ")).otherwise("None"),
        signals=F.when(F.size("signal_lines") > 0, F.array_join("signal_lines", "\n")).otherwise("None"), versions=listed("version_lines"), apis=listed("api_lines"), sources=listed("source_lines"),
    )


def confirmation_card(task: Column) -> Column:
    """M11, over understand()'s columns: struct(frameworks, architecture, prompt) with signals by name."""
    named = F.transform("signals", lambda s: s["name"])
    return F.struct(
        F.when(F.size("dependencies") > 0, F.array_join("dependencies", ", ")).otherwise(T.NO_FRAMEWORKS).alias("frameworks"),
        F.when(F.size(named) > 0, F.array_join(named, ", ")).otherwise(T.NO_SIGNALS).alias("architecture"),
        F.when(F.coalesce(task, F.lit("")) != "", F.concat(F.lit('"'), task, F.lit('"'))).otherwise(T.NO_PROMPT).alias("prompt"),
    )


def fence_language(summary: Column) -> Column:
    """The first word after the first "in " of the summary, lower case; text if there is none."""
    after = F.get(F.split(summary, "in ", -1), F.lit(1))
    return F.coalesce(F.nullif(F.lower(F.get(F.split(after, " ", -1), F.lit(0))), F.lit("")), F.lit("text"))


def review_task(task: Column, correction: Column) -> Column:
    """M8."""
    given = F.coalesce(F.nullif(task, F.lit("")), F.lit(T.TASK))
    insist = fill(T.INSISTED, correction=correction, task=given)
    return F.when(F.coalesce(correction, F.lit("")) != "", insist).otherwise(given)


def prompt_parts(df: DataFrame, task: Column, content: str = "content") -> DataFrame:
    """M7's data: the task line, the context text, and the fenced source."""
    fence = F.concat(F.lit("```"), fence_language(F.col("summary")), F.lit("\n"), F.col(content), F.lit("\n```"))
    return df.withColumns({"task_line": fill(T.TASK_LINE, task=task), "context": context_text(), "fenced_source": fence})
