"""Validation and normalisation of uploaded, pasted and posted text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.text import byte_size, escape_html, extension, fill, human_size, line_count, lookup, one_decimal
from siltstone.rules import language as L
from siltstone.rules import limits as R
from siltstone.rules import texts as T


def _verdict(error: Column) -> Column:
    return F.struct(error.isNull().alias("valid"), error.alias("error"))


def _too_large(size: Column, limit: int, what: str) -> Column:
    mb = lambda x: one_decimal(x / F.lit(1024.0 * 1024.0))
    return F.when(size > limit, fill(T.TOO_LARGE, what=F.lit(what), size=mb(size), limit=mb(F.lit(limit))))


def upload_size(size: Column) -> Column:
    """V1."""
    return _verdict(_too_large(size, R.MAX_UPLOAD_BYTES, "File"))


def upload_type(name: Column, mime: Column) -> Column:
    """V2. Without a dot the whole name counts as the extension."""
    low, kind = F.lower(name), F.coalesce(mime, F.lit(""))
    ext = F.regexp_extract(low, r"(?s)(\.?[^.]*)\z", 1)
    media = F.lit(False)
    for prefix in R.MEDIA_PREFIXES:
        media |= kind.startswith(prefix)
    allowed = ext.isin(R.UPLOAD_EXTENSIONS) | F.concat(F.lit("."), low).isin(R.UPLOAD_EXTENSIONS) | kind.isin(R.UPLOAD_MIME_TYPES)
    shown = F.coalesce(F.nullif(ext, F.lit("")), F.lit("unknown"))
    return _verdict(F.when(media, T.MULTIMEDIA).when(~allowed, fill(T.UNSUPPORTED, extension=shown)))


def paste_size(text: Column) -> Column:
    """V3."""
    return _verdict(_too_large(byte_size(text), R.MAX_PASTE_BYTES, "Input"))


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units, as posted bodies are measured."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("long")


def request_size(content_length: Column) -> Column:
    """V4: true when the request passes; a missing or unreadable header does."""
    return F.coalesce(content_length.try_cast("double") <= R.MAX_REQUEST_BYTES, F.lit(True))


def review_body(content: Column) -> Column:
    """V5: between one character and the limit."""
    return F.coalesce(utf16_length(content).between(1, R.MAX_CONTENT_CHARS), F.lit(False))


def chat_body(messages: DataFrame) -> DataFrame:
    """V6: one verdict for each conversation."""
    turns = F.count(F.lit(1))
    known = F.coalesce(F.min(F.col("role").isin(R.ROLES)), F.lit(False))
    return messages.groupBy("conv_id").agg(turns.alias("turns"), (turns.between(R.MIN_TURNS, R.MAX_TURNS) & known).alias("valid"))


def finding_valid(category: Column, severity: Column, confidence: Column) -> Column:
    """V7."""
    known = category.isin(R.CATEGORIES) & severity.isin([s for s, _ in R.DEDUCTIONS])
    return F.coalesce(known & confidence.between(0, 1), F.lit(False))


def route(staged: Column, text: Column, supported: Column, unsupported: Column) -> Column:
    """V9: where a sent text goes; long is counted in UTF-16 units."""
    long = utf16_length(text) >= R.CODE_CHARS
    return F.when(staged, "review_staged").when(long & unsupported, "reject").when(long & supported, "review_paste").otherwise("chat")


def paste_name(language: Column, relevance: Column) -> Column:
    """X1's mapping: the guess itself is an input."""
    plain = F.coalesce((relevance < R.LEAST_RELEVANCE) | language.isNull() | (language == ""), F.lit(True))
    pick = lambda i, default: lookup(language, [(r[0], r[i]) for r in R.PASTE_NAMES], default)
    name, label, ext = R.PLAIN_PASTE
    friendly = F.concat(F.upper(F.substring(language, 1, 1)), F.substring(language, 2, 1_000_000))
    known = language.isin([r[0] for r in R.PASTE_NAMES])
    return F.struct(
        F.when(plain, name).otherwise(pick(1, F.lit(name))).alias("filename"), F.when(plain, label).otherwise(pick(2, friendly)).alias("language"),
        F.when(plain, ext).otherwise(pick(3, F.lit(ext))).alias("extension"), (~plain & known).alias("supported"), (~plain & ~known).alias("unsupported"),
    )


def display_language(ext: Column) -> Column:
    """P2."""
    return lookup(F.lower(ext), L.DISPLAY, F.lit("Unknown"))


def normalise(df: DataFrame, source: str, name: str = "filename", content: str = "content", at: str | None = None) -> DataFrame:
    """Extension, language, line_count, byte_size, formatted_size, source and ingested_at beside the input's columns."""
    ext, text = extension(F.col(name)), F.col(content)
    out = df.withColumns({"extension": ext, "language": display_language(ext), "line_count": line_count(text), "byte_size": byte_size(text), "formatted_size": human_size(byte_size(text)), "source": F.lit(source)})
    return out.withColumn("ingested_at", F.col(at) if at else F.lit(None).cast("timestamp"))


def stage_upload(df: DataFrame, name: str = "filename", mime: str = "mime", size: str = "size", content: str = "content") -> DataFrame:
    """S3: size, type and readability in this order, the first failure as error; what passes is normalised and staged.

    A file without content could not be read. Rows with an error keep their place with staged = false.
    """
    unread = F.when(F.col(content).isNull(), fill(T.UNREADABLE, name=F.coalesce(F.col(name), F.lit(""))))
    error = F.coalesce(upload_size(F.col(size))["error"], upload_type(F.coalesce(F.col(name), F.lit("")), F.col(mime))["error"], unread)
    return normalise(df, "file-upload", name, content).withColumns({"error": error, "staged": error.isNull()})


def stage_paste(df: DataFrame, language: str = "guess", relevance: str = "relevance", explicit: str | None = None, content: str = "content") -> DataFrame:
    """Size, then the guessed language; a text that passes is normalised under its virtual name, or the explicit one if given, and staged."""
    text = F.coalesce(F.col(content), F.lit(""))
    virtual = paste_name(F.col(language), F.col(relevance))
    error = F.coalesce(paste_size(text)["error"], F.when(virtual["extension"] == R.PLAIN_PASTE[2], F.lit(T.NOT_CODE)))
    name = F.coalesce(F.col(explicit), virtual["filename"]) if explicit else virtual["filename"]
    rows = df.withColumns({"error": error, "filename": name})
    return normalise(rows, "paste", "filename", content).withColumn("staged", F.col("error").isNull())


def code_lines(df: DataFrame, key: str = "artifact_id", content: str = "content", shown: int | None = None) -> DataFrame:
    """Numbered, escaped lines."""
    out = df.select(key, F.posexplode(F.split(F.col(content), "\r?\n", -1)).alias("pos", "raw"))
    out = out.select(key, (F.col("pos") + 1).alias("num"), escape_html(F.col("raw")).alias("code"))
    return out if shown is None else out.filter(F.col("num") <= shown)
