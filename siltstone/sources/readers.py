"""Files and JSON requests as tables, settings, and streaming sinks. Uploads and pasted texts go on through operators.ingest."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.rules import limits as R


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """One row for each file, whole text; the id is a hash of the path."""
    out = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
    return out.select(F.xxhash64("path").alias("artifact_id"), F.element_at(F.split("path", "/"), -1).alias("filename"), "content")


def read_uploads(spark: SparkSession, path: str, most_bytes: int = R.MAX_UPLOAD_BYTES) -> DataFrame:
    """S1 with V1: (path, filename, size, content) for each file. The size is checked before a file is opened: larger ones have a null content and are never read. Bytes that are no UTF-8 become the replacement character; empty files give no row, as Spark deals none to a task."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    named = lambda df, content: df.select("path", F.element_at(F.split("path", "/"), -1).alias("filename"), F.col("length").alias("size"), content.alias("content"))
    small, large = F.col("length") <= most_bytes, F.col("length") > most_bytes
    return named(files.filter(small), F.make_valid_utf8(F.col("content").cast("string"))).unionAll(named(files.filter(large), F.lit(None).cast("string")))


def _kind(path: str) -> str:
    return f"schema_of_variant(try_variant_get(v, '$.{path}', 'variant'))"


def _text(path: str) -> str:
    return f"coalesce({_kind(path)} = 'STRING', false)"


def _optional_text(path: str) -> str:
    return f"coalesce({_kind(path)}, 'STRING') = 'STRING'"


def _number(path: str) -> str:
    return f"coalesce({_kind(path)} IN ('BIGINT', 'DOUBLE', 'FLOAT') OR {_kind(path)} LIKE 'DECIMAL%', false)"


def _each(path: str, condition: str) -> str:
    """An array whose every element x meets the condition."""
    return f"coalesce(forall(try_variant_get(v, '$.{path}', 'array<variant>'), x -> {condition}), false)"


def _member(name: str, kinds: str = "= 'STRING'", needed: bool = True) -> str:
    kind = f"schema_of_variant(try_variant_get(x, '$.{name}', 'variant'))"
    return f"coalesce({kind} {kinds}, {'false' if needed else f'{kind} IS NULL'})"


def _nullable(path: str, member: str) -> str:
    """Null, or an object with a text of this name; it must be there."""
    return f"coalesce({_kind(path)} = 'VOID' OR {_text(f'{path}.{member}')}, false)"


_UNDERSTOOD = [
    _text("understanding.language.name"), _number("understanding.language.confidence"), _nullable("understanding.framework", "name"), _nullable("understanding.runtime", "type"),
    _nullable("understanding.artifactType", "type"), _each("understanding.dependencies", "schema_of_variant(x) = 'STRING'"),
    _each("understanding.architecturalSignals", f"{_member('name')} AND {_member('evidence')}"), _number("understanding.overallConfidence"),
    f"coalesce({_kind('understanding.requiresClarification')} = 'BOOLEAN', false)", _each("understanding.clarificationQuestions", f"{_member('question')} AND {_member('reason')}"),
    _text("understanding.summary"),
]
_REVIEW = [
    f"coalesce(try_variant_get(v, '$.mode', 'string') = 'review' AND {_kind('mode')} = 'STRING', {_kind('mode')} IS NULL)", _text("content"),
    f"coalesce(octet_length(encode(try_variant_get(v, '$.content', 'string'), 'UTF-16BE')) / 2 BETWEEN 1 AND {R.MAX_CONTENT_CHARS}, false)",
    _optional_text("task"), _optional_text("correction"), *_UNDERSTOOD,
]
_PARTS = "coalesce(forall(try_variant_get(x, '$.parts', 'array<variant>'), y -> coalesce(schema_of_variant(try_variant_get(y, '$.type', 'variant')) = 'STRING', false) AND coalesce(schema_of_variant(try_variant_get(y, '$.text', 'variant')), 'STRING') = 'STRING'), schema_of_variant(try_variant_get(x, '$.parts', 'variant')) IS NULL)"
_TURN = f"{_member('role')} AND try_variant_get(x, '$.role', 'string') IN ({', '.join(map(repr, R.ROLES))}) AND {_member('id', needed=False)} AND {_member('content', needed=False)} AND {_PARTS}"
_ABOUT = " AND ".join([*[_text(f"findingContext.{x}") for x in R.FINDING_TEXTS], _each("findingContext.evidence", "schema_of_variant(x) = 'STRING'"), _optional_text("findingContext.codeSnippet")])
_CHAT = [
    f"coalesce(size(try_variant_get(v, '$.messages', 'array<variant>')) BETWEEN {R.MIN_TURNS} AND {R.MAX_TURNS}, false)", _each("messages", _TURN),
    f"({_kind('findingContext')} IS NULL OR ({_ABOUT}))",
]
_TURNS = "array<struct<role:string,content:string,parts:array<struct<type:string,text:string>>>>"


def read_requests(lines: DataFrame, body: str = "value", into: str = "request") -> DataFrame:
    """Each JSON body as struct(mode, valid, content, task, correction, messages) beside the input's columns.

    A body in chat mode must hold 1 to 50 turns of known roles, any other one a
    review: content of bounded length and the whole understanding. Types are
    checked as they stand, numbers are no texts; members that are not listed are
    allowed. A malformed, null or invalid body is kept with valid = false. An
    input column of the name `into` is replaced.
    """
    chat = f"coalesce(try_variant_get(v, '$.mode', 'string') = 'chat' AND {_kind('mode')} = 'STRING', false)"
    texts = ", ".join(f"'{c}', try_variant_get(v, '$.{c}', 'string')" for c in ("content", "task", "correction"))
    good = f"coalesce(CASE WHEN {chat} THEN {' AND '.join(_CHAT)} ELSE {' AND '.join(_REVIEW)} END, false)"
    built = f"named_struct('mode', CASE WHEN {chat} THEN 'chat' ELSE 'review' END, 'valid', {good}, {texts}, 'messages', try_variant_get(v, '$.messages', '{_TURNS}'))"
    parsed = F.try_parse_json(F.col(body))
    return lines.withColumn(into, F.get(F.call_function("transform", F.array(parsed), F.expr(f"v -> {built}")), F.lit(0)))


def required_env(names: list[str]) -> dict[str, str]:
    """V8: configuration values, all of which must be set and not blank."""
    missing = [n for n in names if not os.environ.get(n, "").strip()]
    if missing:
        raise ValueError("Missing required environment variables: " + ", ".join(missing))
    return {n: os.environ[n] for n in names}


def write_stream(df: DataFrame, name: str, mode: str = "append"):
    """An incremental sink; the memory table serves subscribers in tests."""
    return df.writeStream.format("memory").queryName(name).outputMode(mode)


def notify(df: DataFrame, listeners: list[Callable[[DataFrame, int], None]], mode: str = "update"):
    """Every micro-batch goes to all listeners, in order."""

    def each(batch: DataFrame, number: int) -> None:
        for listener in listeners:
            listener(batch, number)

    return df.writeStream.outputMode(mode).foreachBatch(each)


def write_batches(df: DataFrame, path: str, checkpoint: str, every: str = "1 second"):
    """A started sink of Parquet files. The folder's log names the files of each batch, so a batch that is given again after a restart leaves no repeated rows.

    Streams with timers or expiring state run a batch at every interval, also without new rows.
    """
    return df.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
