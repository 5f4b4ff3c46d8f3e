"""Operators of the reference's side held against values written by hand, also where a query's SQL shares its tables."""

import json
import re

import pytest
from conftest import drained
from pyspark.sql import functions as F

from siltstone.functions.regex import Pattern, needles
from siltstone.operators import classify, confidence, conversation, extract, grounding, ingest, limits
from siltstone.rules import artifact, framework, language, registry, runtime, signals
from siltstone.sources import readers
from siltstone.streaming import live


def one(spark, rows, schema, *columns):
    return spark.createDataFrame(rows, schema).select(*columns).collect()


# --- versions ----------------------------------------------------------------

VERSIONS = [
    ("React", "const [x] = use(p); useOptimistic(a)", "React 19.x", 0.65), ("React", "createRoot(el); const [p, s] = useTransition();", "React 18.x", 0.72),
    ("React", "const [a, b] = useState(0); React.memo(x)", "React 16–17.x", 0.65), ("React", "nothing", "React (version undetermined from code)", 0.30),
    ("Next.js", "'use client'\nexport const metadata = {}\nimport x from 'next/server'", "Next.js 13–14.x (App Router)", 0.77), ("Next.js", "'use client'", "Next.js 13–14.x (App Router)", 0.67),
    ("Next.js", '"use server"', "Next.js 13–14.x (App Router)", 0.67), ("Next.js", "'use cache'", "Next.js 15.x", 0.65), ("Next.js", "export async function getServerSideProps() {}", "Next.js 12.x (Pages Router)", 0.63),
    ("Express", "const e = require('express'); app.get('/')", "Express 4.x", 0.68), ("Prisma", "new PrismaClient()", "Prisma 4.x", 0.62), ("Prisma", "typedSql", "Prisma 5.x", 0.65),
    ("Vue", "defineComponent({})", "Vue 3.x (Composition API)", 0.67), ("Vue", "new Vue({})", "Vue 2.x (Options API)", 0.62), ("NestJS", "@Injectable()", "NestJS 10.x", 0.63), ("FastAPI", "import fastapi", "FastAPI 0.100+", 0.63),
]


def test_versions(spark):
    rows = [(f, t) for f, t, _, _ in VERSIONS]
    own = F.filter(grounding.inferences(F.col("content")), lambda x: x["framework"] == F.col("f"))[0]["inference"]
    found = one(spark, rows, "f string, content string", own["label"].alias("label"), own["confidence"].alias("confidence"))
    assert [(r.label, round(r.confidence, 9)) for r in found] == [(label, c) for _, _, label, c in VERSIONS]


def test_signals_show_the_pattern_as_written(spark):
    (r,) = one(spark, [("'use client'",)], "content string", F.filter(grounding.inferences(F.col("content")), lambda x: x["framework"] == "Next.js")[0]["inference"]["signals"].alias("s"))
    assert r.s == ["""['"']use client['"']|['"']use server['"'] → Next.js 13–14.x (App Router)"""]


def test_unknown_framework(spark):
    (r,) = one(spark, [("Mongoose",)], "f string", grounding.unknown_version(F.col("f")).alias("x"))
    assert (r.x.label, r.x.confidence, r.x.min_version, r.x.max_version, r.x.signals) == ("Mongoose (version unknown)", 0.2, None, None, [])


def test_deprecated_apis(spark):
    rows = one(spark, [("ReactDOM.render(a, b)",), ("new Vue({})",), ("createRoot(a)",)], "content string", grounding.deprecated_apis(grounding.api_matches(F.col("content"))).alias("x"))
    assert [[a.api for a in r.x] for r in rows] == [["ReactDOM.render()"], ["new Vue()"], []]


# --- classifiers -------------------------------------------------------------

LANGUAGES = [
    ("a.ts", "x", "TypeScript", 0.98, "extension"), ("x/Dockerfile", "FROM a", "Dockerfile", 0.99, "extension"), (None, "#!/usr/bin/env python3\n", "Python", 0.92, "shebang"), (None, "#!/bin/bash\n", "Shell", 0.92, "shebang"),
    (None, "interface A { a: string }\nconst b = x as const", "TypeScript", 0.82, "syntax-heuristic"), (None, "def f(a):\n  pass\nimport os", "Python", 0.88, "syntax-heuristic"), (None, "package main\nfunc A() {}", "Go", 0.90, "syntax-heuristic"),
    (None, "select a, b from t", "SQL", 0.88, "syntax-heuristic"), (None, "<!doctype html><html>", "HTML", 0.92, "syntax-heuristic"), (None, "gibberish and nothing else", "Unknown", 0.10, "fallback"), ("", "", "Unknown", 0.10, "fallback"),
    (None, "caféinterface x", "TypeScript", 0.82 * 0.65, "keyword"), (None, "lambda x", "Python", 0.88 * 0.65, "keyword"), ("noext.", "x", "Unknown", 0.10, "fallback"),
]


def test_languages(spark):
    """An accented letter before a keyword is no word character to a JavaScript \\b, so 'caféinterface' starts a word there."""
    rows = one(spark, [x[:2] for x in LANGUAGES], "filename string, content string", classify.detect_language(F.col("content"), F.col("filename")).alias("x"))
    assert [(r.x.name, r.x.confidence, r.x.detected_via) for r in rows] == [x[2:] for x in LANGUAGES]


def test_frameworks_and_runtimes(spark):
    text = [
        ("page.tsx", "import a from 'next/link'", ("Next.js", 0.80), None), ("a.ts", "import a from 'next/link'\nNextRequest", ("Next.js", 0.78), None), ("a.tsx", "import R from 'react'\nuseState(", ("React", 0.67), None),
        ("s.js", "require('express')", ("Express", 0.65), ("node", 0.70)), ("x.cjs", "require('fs')", None, ("node", 0.82)), ("middleware.ts", "NextResponse.next()", ("Next.js", 0.70), ("middleware", 0.75)),
        ("a", "nothing", None, None), ("handler.js", "exports.handler = 1", None, ("serverless", 0.83)), ("lambda-handler.js", "exports.handler = 1", None, ("serverless", 0.83)),
    ]
    name, content = F.col("filename"), F.col("content")
    rows = one(spark, [x[:2] for x in text], "filename string, content string", classify.detect_framework(content, name).alias("f"), classify.detect_runtime(content, name).alias("r"))
    shown = lambda x, field: x and (x[field], round(x.confidence, 9))
    assert [(shown(r.f, "name"), shown(r.r, "type")) for r in rows] == [x[2:] for x in text]


def test_roles(spark):
    text = [("a.test.ts", "x", ("test-file", 0.92)), ("useA.ts", "export function useAb() {}", ("hook", 0.86)), ("x.ts", "z.object({})", ("schema-model", 0.68)), ("x.ts", "hello", None), (None, "createContext()", ("context-provider", 0.78))]
    rows = one(spark, [x[:2] for x in text], "filename string, content string", classify.classify_artifact(F.col("content"), F.col("filename")).alias("x"))
    assert [r.x and (r.x.type, round(r.x.confidence, 9)) for r in rows] == [x[2] for x in text]


def test_signal_is_named_once_with_its_first_evidence(spark):
    (r,) = one(spark, [("jwt.sign(); signIn(); fetch('https://a')",)], "content string", extract.extract_signals(F.col("content")).alias("x"))
    assert [tuple(x) for x in r.x] == [("authentication", "auth library (jwt/bcrypt/passport)"), ("api-call", "fetch() external URL call")]


def every_pattern():
    out = [(p, f) for _, _, strong, weak in language.HEURISTICS for p, f in strong + weak] + [(p, "") for p, _ in language.SHEBANGS]
    out += [(p, "") for rules in (framework.RULES, runtime.RULES) for r in rules for p, _ in r[4]] + [p for r in artifact.RULES for p in r[4] + r[5]]
    return out + [(p, f) for _, x in signals.RULES for p, f, _ in x] + [p for b in registry.BRACKETS for p in b[5]] + [(grounding.api_pattern(a[1]).source, "") for a in registry.APIS]


def test_needles():
    assert needles(r"\b(interface|type\s+\w+)\b") == {"interface", "type"}
    assert needles(r"from ['\"]react['\"]|React\.memo\s*\(") == {"from ", "React.memo"}
    assert needles(r"a?bc*d") in ({"b"}, {"d"}) and needles(r"^\s*[{\[]") == set() and needles(r"(x|[yz])+") == set()
    assert needles(r"ab{2,3}c(?:de)?") == {"ab"} and needles(r"x{0,2}yy") == {"yy"}


def test_needles_never_hide_a_match():
    """Every snippet in which a pattern matches (by Python's engine) holds one of its needles."""
    from siltstone.plans.corpus import SNIPPETS

    texts = [c for _, c in SNIPPETS] + [t for _, t, _, _ in VERSIONS] + [t for _, t, *_ in LANGUAGES]
    for source, flags in every_pattern():
        some = needles(source)
        kind = (re.I if "i" in flags else 0) | (re.M if "m" in flags else 0) | re.A
        for text in texts:
            if some and re.search(source.replace(r"\/", "/"), text, kind):
                low = text.lower() if "i" in flags else text
                assert any((x.lower() if "i" in flags else x) in low for x in some), (source, text)


@pytest.mark.parametrize("name, patterns", [("c1_language", 16 * 2 + 6 + 8), ("c2_framework", 30), ("c3_runtime", 37)])
def test_each_pattern_is_evaluated_once(spark, name, patterns):
    from siltstone.plans.queries import QUERIES

    spark.conf.set("spark.sql.debug.maxToStringFields", "100000")
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    spark.conf.unset("spark.sql.debug.maxToStringFields")
    count = sum(len(s) + len(w) for _, _, s, w in language.HEURISTICS) + len(language.SHEBANGS) if name == "c1_language" else patterns
    assert plan.count("RLIKE") == count


# --- confidence and conversations ---------------------------------------------


def test_confidence_of_gibberish(spark):
    (r,) = confidence.understand(spark.createDataFrame([(None, "zzz qqq")], "filename string, content string")).collect()
    assert r.overall_confidence == 0.263 and r.requires_clarification and 1 <= len(r.questions) <= 3
    assert r.questions[0].question == "What programming language is this code written in?"


def test_confirmation_card(spark):
    rows = confidence.understand(spark.createDataFrame([("a.js", "require('pg'); jwt"), ("b", "")], "filename string, content string"))
    found = [tuple(r.x) for r in rows.select(conversation.confirmation_card(F.when(F.col("filename") == "a.js", "t")).alias("x")).collect()]
    assert found == [("pg", "authentication", '"t"'), ("None detected", "Standard", "(No extra context provided)")]


def test_context_goes_only_before_a_users_first_turn(spark):
    rows = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "user", "b"), (2, 0, "assistant", "c"), (2, 1, "user", "d")], "conv_id int, turn int, role string, text string")
    found = {(r.conv_id, r.turn): r.text for r in conversation.inject_context(rows, F.lit("B")).collect()}
    assert found == {(1, 0): "B\n\n---\n\na", (1, 1): "b", (2, 0): "c", (2, 1): "d"}


# --- ingest and sources --------------------------------------------------------


def test_sizes_and_lines(spark):
    from siltstone.functions.text import human_size, line_count

    sizes = [0, 1023, 1024, 1536, 51200, 1024 * 1024, 2621440]
    assert [r.x for r in one(spark, [(s,) for s in sizes], "s long", human_size(F.col("s")).alias("x"))] == ["0 B", "1023 B", "1.0 KB", "1.5 KB", "50.0 KB", "1.0 MB", "2.5 MB"]
    assert [r.x for r in one(spark, [("",), ("a\nb\n",), ("a\rb",)], "s string", line_count(F.col("s")).alias("x"))] == [1, 3, 1]
    lines = ingest.code_lines(spark.createDataFrame([(1, "a\r\n\n<b> && c\rd")], "artifact_id int, content string")).collect()
    assert [(r.num, r.code) for r in lines] == [(1, "a"), (2, ""), (3, "&lt;b&gt; &amp;&amp; c\rd")]


def test_stage_upload(spark):
    big = 5 * 1024 * 1024
    rows = [("a.ts", "", big, "x"), ("a.ts", "", big + 1, None), ("a.py", "image/png", 1, None), ("a.py", "", 1, None), ("a.ts", "", 1, None), (None, None, 1, "x")]
    found = ingest.stage_upload(spark.createDataFrame(rows, "filename string, mime string, size long, content string")).collect()
    assert [r.error and r.error.split(" ")[0] for r in found] == [None, "File", "Multimedia", "File", "Could", "File"]
    assert [r.staged for r in found] == [True] + [False] * 5 and found[0].source == "file-upload"


def test_read_files(spark, tmp_path):
    (tmp_path / "a.ts").write_text("one\ntwo\n")
    (tmp_path / "b.py").write_text("")
    rows = {r.filename: r.content for r in readers.read_files(spark, str(tmp_path)).collect()}
    assert rows["a.ts"] == "one\ntwo\n" and set(rows) <= {"a.ts", "b.py"}


def test_requests(spark):
    turns = [{"role": "user", "content": "a"}, {"role": "assistant", "parts": [{"type": "text", "text": "b"}]}]
    rows = spark.createDataFrame([(json.dumps({"mode": "chat", "messages": turns}), 7), ("", 8)], "value string, mode int")
    found = readers.read_requests(rows).collect()
    assert [r.request.valid for r in found] == [True, False] and [r.mode for r in found] == [7, 8]
    assert [(m.role, m.content, m.parts and m.parts[0].text) for m in found[0].request.messages] == [("user", "a", None), ("assistant", None, "b")]


def test_required_env(monkeypatch):
    monkeypatch.setenv("SILT_A", "x")
    monkeypatch.setenv("SILT_B", "  ")
    assert readers.required_env(["SILT_A"]) == {"SILT_A": "x"}
    with pytest.raises(ValueError, match="SILT_B, SILT_C"):
        readers.required_env(["SILT_A", "SILT_B", "SILT_C"])


# --- limiter and streams -------------------------------------------------------

REQUESTS = [
    ("a", 0, 1, True, 1, 0), ("a", 10, 2, True, 0, 0), ("a", 20, 3, False, 0, 80), ("a", 99, 4, False, 0, 1), ("a", 100, 5, True, 1, 0), ("a", 150, 6, True, 0, 0), ("a", 199, 7, False, 0, 1), ("a", 200, 8, True, 1, 0),
    (None, 5, 9, True, 1, 0), (None, 6, 10, True, 0, 0), (None, 7, 11, False, 0, 98), ("b", 50, 12, True, 1, 0), ("b", None, 13, None, None, None),
]
REQUEST = "key string, at_ms long, request_id long"


def test_limiter(spark):
    """A window ends exactly at its length, and denied requests neither count nor extend it; null keys are one key."""
    found = limits.rate_limit(spark.createDataFrame([r[:3] for r in REQUESTS], REQUEST).repartition(4), 100, 2).collect()
    assert sorted(map(tuple, found), key=lambda r: r[2]) == REQUESTS


def test_limiter_keeps_large_keys(spark):
    rows = [(2**53 + 1, 0, 1), (2**53, 0, 2), (None, 0, 3), (None, 1, 4)]
    found = limits.rate_limit(spark.createDataFrame(rows, "key long, at_ms long, request_id long"), 100, 1).collect()
    assert {(r.key, r.request_id, r.allowed) for r in found} == {(2**53 + 1, 1, True), (2**53, 2, True), (None, 3, True), (None, 4, False)}


def run_stream(spark, df, tmp_path, name, mode):
    query = readers.write_stream(df, name, mode).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return spark.table(name).collect()


def test_limiter_on_a_stream_equals_the_batch(spark, tmp_path):
    rows = [r for r in REQUESTS if r[0] is not None]
    for i, part in enumerate((rows[:3], rows[3:6], rows[6:])):
        spark.createDataFrame([r[:3] for r in part], REQUEST).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/{i}"))
    stream = spark.readStream.schema(REQUEST).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    found = drained(spark, lambda: readers.write_batches(live.limit_stream(stream, 100, 2), f"{tmp_path}/out", f"{tmp_path}/state"), f"{tmp_path}/out", len(rows))
    assert sorted(map(tuple, found), key=lambda r: r[2]) == rows


def kept_rows(spark, df, tmp_path, until, seconds=60):
    """Numbers of state rows that a stream's progress tells, until one satisfies."""
    import time

    query, seen, end = readers.write_batches(df, f"{tmp_path}/out", f"{tmp_path}/state"), [], time.time() + seconds
    try:
        while time.time() < end and not until(seen):
            time.sleep(0.5)
            seen = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    finally:
        query.stop()
    return seen


def test_limiter_forgets_windows_that_are_over(spark, tmp_path):
    spark.createDataFrame([(f"k{i}", i, i) for i in range(20)], REQUEST).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(REQUEST).parquet(str(tmp_path / "in"))
    seen = kept_rows(spark, live.limit_stream(stream, 1000, 2, late_ms=3000), tmp_path, lambda n: n and max(n) >= 20 and n[-1] == 0)
    assert max(seen) >= 20 and seen[-1] == 0


def test_run_once_forgets_reviews_of_long_ago(spark, tmp_path):
    import datetime

    day = lambda d: datetime.datetime(2024, 1, d)
    schema = "artifact_id int, at timestamp"
    for i, rows in enumerate(([(k, day(1)) for k in range(20)] + [(3, day(1))], [(99, day(20))], [(98, day(21))])):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    seen = kept_rows(spark, live.run_once(stream, "at"), tmp_path, lambda n: n and max(n) >= 20 and n[-1] <= 2)
    assert max(seen) >= 20 and seen[-1] <= 2
    assert spark.read.parquet(f"{tmp_path}/out").count() == 22


def test_live_scores_and_run_once(spark, tmp_path):
    spark.createDataFrame([(1, "critical", "security"), (1, "low", "performance"), (2, "odd", "general")], "artifact_id int, severity string, category string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("artifact_id int, severity string, category string").parquet(str(tmp_path / "in"))
    found = {tuple(r) for r in run_stream(spark, live.live_scores(stream), tmp_path / "a", "scores", "complete")}
    assert found == {(1, 2, 72, 0, 1, 1), (2, 1, 97, 1, 0, 0)}
    assert len(run_stream(spark, live.run_once(stream), tmp_path / "b", "once", "append")) == 2


def test_every_listener_hears_every_batch(spark, tmp_path):
    spark.createDataFrame([(1,), (2,)], "x int").coalesce(1).write.parquet(str(tmp_path / "in"))
    heard = []
    stream = spark.readStream.schema("x int").parquet(str(tmp_path / "in"))
    query = readers.notify(stream, [lambda df, n: heard.append(("a", df.count())), lambda df, n: heard.append(("b", df.count()))], "append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert heard == [("a", 2), ("b", 2)]


def test_states(spark):
    states = live.STATES
    assert [r.x for r in one(spark, [(s,) for s in states], "s string", live.next_state(F.col("s")).alias("x"))] == ["reading", "normalizing", "understanding", "grounding", "reasoning", "done", "done", "error"]


def test_patterns_mean_the_same_in_both_dialects():
    assert Pattern(r"\bfoo\b").java == r"(?<!\w)foo(?!\w)" and Pattern(r"\bfoo\b").re2 == r"\bfoo\b"


def test_routing_counts_utf16_units(spark):
    """30 emoji are 60 units."""
    texts = ["\U0001f600" * 30, "\U0001f600" * 24 + "x", "\U0001f600" * 25, "x" * 50, "x" * 49, None]
    rows = one(spark, [(t,) for t in texts], "t string", ingest.route(F.lit(False), F.col("t"), F.lit(True), F.lit(False)).alias("x"))
    assert [r.x for r in rows] == ["review_paste", "chat", "review_paste", "review_paste", "chat", "chat"]


def test_places_and_pins(spark):
    from siltstone.operators import findings

    lines = [r"const a = &quot;x&quot;;", "if (a &lt; b) return", "Return HTML5 page", "last"]
    cases = [(["see line 3"], 3), (["html5 page"], 5), (["12"], 12), (["zzzzzz", "a < b) ret"], 2), (["return"], 2), (['a = "x"'], None), (["last"], None), (["LAST l", "x"], None), ([], None)]
    rows = one(spark, [(e, lines) for e, _ in cases], "e array<string>, lines array<string>", findings.evidence_line(F.col("e"), F.col("lines")).alias("x"))
    assert [r.x for r in rows] == [x for _, x in cases]
    df = spark.createDataFrame([(1, 2, 0, "low"), (1, 2, 3, "high"), (1, 0, 4, "low"), (1, None, 5, "low"), (1, 7, 1, "medium")], "artifact_id int, line long, idx int, severity string")
    (r,) = findings.pins(df).collect()
    assert {k: tuple(v) for k, v in r.pins.items()} == {2: ("high", "f-3"), 7: ("medium", "f-1")}


def test_registry_from_rows(spark):
    kind = "ord int, framework string, api string, introduced string, deprecated string, description string"
    rules = spark.createDataFrame([(2, "A", "go()", "1", None, "d"), (1, "B", '"use x"', "1", "2", "d"), (3, "A", "never()", "1", None, "d")], kind)
    texts = spark.createDataFrame([("go (1)",), ("'use x'; go()",), (None,), ("",)], "content string")
    assert [(r.ord, r.api, r.n_artifacts) for r in sorted(grounding.registry_usage(texts, rules).collect())] == [(1, '"use x"', 1), (2, "go()", 2), (3, "never()", 0)]
    for bad in ([(1, None, "a", "", "", "")], [(1, "A", "a", "", "", ""), (1, "A", "b", "", "", "")], [(1, "A", "a", "", "", ""), (2, "A", "a", "", "", "")]):
        with pytest.raises(ValueError):
            grounding.registry_usage(texts, spark.createDataFrame(bad, kind))
    assert grounding.registry_usage(texts, spark.createDataFrame([], kind)).collect() == []


def test_uploads_over_the_limit_are_never_read(spark, tmp_path):
    for name, raw in (("a.ts", b"caf\xc3\xa9"), ("b.ts", b"x" * 11), ("c.ts", b"bad \xff!"), ("d.ts", b"")):
        (tmp_path / name).write_bytes(raw)
    df = readers.read_uploads(spark, str(tmp_path), 10)
    assert sorted((r.filename, r["size"], r.content) for r in df.collect()) == [("a.ts", 5, "caf\u00e9"), ("b.ts", 11, None), ("c.ts", 6, "bad \ufffd!")]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(length,10)" in plan and "GreaterThan(length,10)" in plan
    scans = [line for line in plan.splitlines() if "binaryFile" in line]
    assert len(scans) == 2 and sum("content" in line.split("Batched")[0] for line in scans) == 1
