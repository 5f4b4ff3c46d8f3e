"""Scalar text and number functions with exact, documented rounding."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def parts_of(template: str) -> list[str]:
    """Plain text and names in braces in turn, plain text first and last."""
    return re.split(r"\{(\w+)\}", template)


def fill(template: str, **columns: Column) -> Column:
    """The template with columns in place of the names in braces; null if one of them is."""
    return F.concat(*[columns[x] if i % 2 else F.lit(x) for i, x in enumerate(parts_of(template)) if i % 2 or x])


def lookup(key: Column, pairs: list[tuple], default: Column | None = None) -> Column:
    """A small fixed table as a CASE on exact keys; a miss gives the default."""
    out = None
    for k, v in pairs:
        out = F.when(key == k, F.lit(v)) if out is None else out.when(key == k, F.lit(v))
    return out.otherwise(default) if default is not None else out


def extension(name: Column) -> Column:
    """From the last dot, lower case, dot included; empty without a dot or with a trailing one."""
    return F.lower(F.regexp_extract(name, r"(?s)(\.[^.]+)\z", 1))


def byte_size(text: Column) -> Column:
    return F.octet_length(text)


def line_count(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1


def one_decimal(value: Column) -> Column:
    return F.format_string("%.1f", value)


def human_size(size: Column) -> Column:
    return (
        F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B")))
        .when(size < 1024 * 1024, F.concat(one_decimal(size / F.lit(1024.0)), F.lit(" KB")))
        .otherwise(F.concat(one_decimal(size / F.lit(1024.0 * 1024.0)), F.lit(" MB")))
    )


def escape_html(text: Column) -> Column:
    for plain, written in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(plain), F.lit(written))
    return text


def unescape_html(text: Column, quotes: bool = True) -> Column:
    """Ampersands first, so that a written-out entity is decoded twice, as on the page."""
    pairs = [("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")] + ([("&quot;", '"'), ("&#39;", "'")] if quotes else [])
    for written, plain in pairs:
        text = F.replace(text, F.lit(written), F.lit(plain))
    return text


def percent(value: Column) -> Column:
    return F.concat(F.floor(value * 100 + 0.5).cast("string"), F.lit("%"))


def three_decimals(value: str) -> Column:
    """The double rounded to three decimals by its exact binary value, ties up, for values in [0, 4)."""
    return F.expr(
        f"CAST((CAST(CAST(({value}) * 1152921504606846976D AS BIGINT) AS DECIMAL(20,0)) * 1000BD + 576460752303423488BD) div 1152921504606846976BD AS DOUBLE) / 1000D"
    )


def severity_label(severity: Column) -> Column:
    return F.upper(F.coalesce(F.nullif(severity, F.lit("")), F.lit("info")))
