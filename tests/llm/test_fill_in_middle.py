"""op11 against a plain version: every cut, every form, the exact round trip."""

import hashlib
import re

from pyspark.sql import functions as F

from siltstone.llm.fill_in_middle import fill_in_middle, restored

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plainly(key, text, seed=42, rate=50, spm=80):
    text = text or ""
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, text
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < spm:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


TEXTS = ["a b  c\n", None, "", "   ", "word", "é 你好 \U0001f600\x1c x\x0b", "< <P <P> x", "ends with <", "<S", "a\x00b c", "P> S> M> <P S>x <", " lead and trail \t", "x" * 70_000, "one two three four five six seven"]


def rows(n=400):
    return [(i, TEXTS[i % len(TEXTS)]) for i in range(n)] + [(None, "null id here"), (None, "null id here"), (-5, "minus five is the id"), (7, "seven again"), (7, "seven again")]


def test_against_plain_version(spark):
    df = spark.createDataFrame(rows(), "doc_id long, text string").repartition(3)
    out = fill_in_middle(df).withColumn("back", restored(F.col("output"), F.col("form"))).collect()
    found = sorted((str(r.doc_id), r.text or "", r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in out)
    assert found == sorted((str(k), t or "", *plainly(k, t)) for k, t in rows())
    assert all(r.back == (r.text or "") for r in out)
    assert {r.form for r in out} == {"plain", "psm", "spm"}


def test_rates_and_other_columns(spark):
    """Rates and seed are parameters; input columns stay, one named as a new one is replaced."""
    df = spark.createDataFrame([(str(k), t, "old", k) for k, t in rows(60)], "name string, body string, form string, bucket long")
    out = fill_in_middle(df, key="name", text="body", seed=7, fim_percent=100, spm_percent=0)
    assert out.columns == ["name", "body", "bucket", "n", "form", "prefix_chars", "middle_chars", "output"]
    for r in out.collect():
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plainly(r.name, r.body, 7, 100, 0)


def test_very_long_text(spark):
    """Ten megabytes in one text, cut and rebuilt whole."""
    df = spark.range(1, 9).select(F.col("id").alias("doc_id"), F.repeat(F.lit("some words\tof é text \n"), F.lit(450_000)).alias("text"))
    out = fill_in_middle(df, fim_percent=100).select("n", "form", (restored(F.col("output"), F.col("form")) == F.col("text")).alias("same")).collect()
    assert all(r.n == 5 * 450_000 + 1 and r.same for r in out) and {r.form for r in out} <= {"psm", "spm"}
