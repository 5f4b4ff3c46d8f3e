"""R2: the resumable parser against a parse of every prefix from its start, and ranges against a single walk."""

import json
import random

import pytest
from conftest import drained

from siltstone.operators import progress
from siltstone.operators.progress import ARCH, DEDUCTIONS, SCALE, SEC, Partial, progressive_findings


def partial_json(text):
    """What a prefix of a JSON object holds, by closing what is open at every earlier cut until it parses."""
    for cut in range(len(text), -1, -1):
        part, stack, inside, escaped = text[:cut], [], False, False
        for c in part:
            if inside:
                escaped, inside = (False, True) if escaped else (c == "\\", c != '"')
            elif c == '"':
                inside = True
            elif c in "{[":
                stack.append("}" if c == "{" else "]")
            elif c in "}]":
                stack.pop()
        for tail in ('"' if inside and not escaped else "", '":null' if inside and not escaped else ":null", "null"):
            try:
                return json.loads(part + tail + "".join(reversed(stack)), strict=False)
            except ValueError:
                pass
    return {}


def plainly(text):
    """n_findings, n_complete, score and counts of a prefix."""
    try:
        got = json.JSONDecoder(strict=False).raw_decode(text)[0]
        done = True
    except ValueError:
        got, done = partial_json(text), False
    found = [f for f in (got.get("findings") if isinstance(got.get("findings"), list) else []) if isinstance(f, dict)]
    deduction = sum(DEDUCTIONS.get(f.get("severity"), 3) if isinstance(f.get("severity"), str) else 3 for f in found)
    kinds = [f.get("category") for f in found]
    return len(found), max(10, 100 - deduction) if found else 100, *(sum(k in names for k in kinds) for names in (ARCH, SEC, SCALE)), done


def review(pick, n):
    text = lambda: pick.choice(["plain", 'with "quotes" and \\ bars', "{[,:]}", '"severity":"low"', "é你\U0001f600\n", ""])
    findings = [{"id": i, "title": text(), "category": pick.choice([*ARCH, *SEC, *SCALE, "other", None]), "evidence": [text(), {"severity": "critical"}], "severity": pick.choice(["critical", "high", "medium", "low", "odd", 5])} for i in range(n)]
    for f in findings:
        if pick.random() < 0.2:
            f.pop(pick.choice(list(f)))
    whole = {"summary": text(), "notes": [{"severity": "critical", "category": "security"}], "findings": findings, "clarificationQuestions": [text()], "more": {"findings": [{"severity": "high"}]}}
    return json.dumps(dict(pick.sample(list(whole.items()), len(whole))), ensure_ascii=pick.random() < 0.5)


@pytest.mark.parametrize("seed", range(6))
def test_every_prefix(seed):
    text = review(random.Random(seed), 3)
    state = Partial()
    for i, c in enumerate(text, 1):
        n, complete, *rest = Partial(state.feed(c).state()).counts()
        assert (n, *rest) == plainly(text[:i]), text[:i]
        assert 0 <= n - complete <= 1


def chunked(pick, text, longest):
    out = []
    while text:
        size = pick.randrange(1, longest)
        out.append(text[:size])
        text = text[size:]
    return out


def told(parts):
    state = Partial()
    return [state.feed(x).counts() for x in parts]


@pytest.mark.parametrize("range_rows", [1_000_000, 40])
def test_batch(spark, monkeypatch, range_rows):
    """A review with most of the chunks, cut into ranges or not; in it a finding longer than several ranges, chunks of one character, and null chunks."""
    pick = random.Random(3)
    giant = json.dumps({"findings": [{"category": "security", "title": "x" * 900, "severity": "high"}, {"severity": "low", "category": "general", "evidence": ["\\" * 60]}] + json.loads(review(random.Random(9), 8))["findings"]})
    talks = {1: chunked(pick, review(pick, 30), 12), 2: chunked(pick, giant, 4), None: chunked(pick, review(pick, 2), 30), 4: [None, "", '{"findings":[{"severity":"hi', None, 'gh"}]} trailing {"findings":[{'], 5: ["[1,2]"], 6: ["{}"]}
    rows = [(key, i, text) for key, parts in talks.items() for i, text in enumerate(parts)]
    pick.shuffle(rows)
    df = spark.createDataFrame(rows, "key long, at long, text string").repartition(3)
    out = progressive_findings(df, range_rows).collect()
    found = {(r.key, r.at): tuple(r)[2:] for r in out}
    assert len(out) == len(rows)
    for key, parts in talks.items():
        assert [found[key, i] for i in range(len(parts))] == told(parts), key
    assert found[4, 2][:3] == (1, 0, 97) and found[4, 4][:3] == (1, 1, 85) and found[4, 4][-1]


def test_ranges_are_bounded(spark):
    """A key with nearly all rows: no range holds much more than it should, and equal rows stay together."""
    from pyspark.sql import functions as F

    from siltstone.operators.ranges import Ranges

    df = spark.range(20_000).select(F.when(F.col("id") % 50 == 0, F.col("id")).alias("key"), (F.col("id") / 3).cast("long").alias("at"))
    sizes = Ranges(df, 500).rows.groupBy("key", "range").count().collect()
    assert max(r["count"] for r in sizes) <= 800 and len({r.range for r in sizes if r.key is None}) >= 30
    assert Ranges(df, 500).rows.filter("key is null").groupBy("at").agg(F.count_distinct("range").alias("n")).filter("n > 1").count() == 0


def test_lexer_tables_compose():
    text = review(random.Random(8), 4)
    whole = progress.Lexer()
    whole.feed(text)
    for cut in range(0, len(text), 7):
        a, b = progress.Lexer(), progress.Lexer()
        a.feed(text[:cut])
        b.feed(text[cut:])
        assert progress.compose(a.done(), b.done()) == whole.done()


def test_stream_reads_every_chunk_once(spark, tmp_path):
    """Chunks over several micro-batches give what one walk gives; state is one bounded value for each review."""
    from siltstone.sources.readers import write_batches
    from siltstone.streaming import live

    pick = random.Random(4)
    talks = {k: chunked(pick, review(pick, 4), 25) for k in (1, 2, None)}
    for batch in range(3):
        rows = [(k, i, t) for k, parts in talks.items() for i, t in enumerate(parts) if i * 3 // len(parts) == batch]
        spark.createDataFrame(rows, "key long, at long, text string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("key long, at long, text string").parquet(f"{tmp_path}/in")
        n = sum(i * 3 // len(parts) <= batch for parts in talks.values() for i in range(len(parts)))
        rows = drained(spark, lambda s=stream: write_batches(live.progressive_stream(s), f"{tmp_path}/out", f"{tmp_path}/state"), f"{tmp_path}/out", n)
    found = {(r.key, r.at): tuple(r)[2:] for r in rows}
    for key, parts in talks.items():
        assert [found[key, i] for i in range(len(parts))] == told(parts)
